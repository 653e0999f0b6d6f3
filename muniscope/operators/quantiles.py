"""Exact ranks and medians without a task that holds a whole group.

Values are counted, the counts are dealt by ranges of (keys, value), and each range learns how
many rows lie before it from a table with one row per range and key. A group with a third of all
rows spreads over as many ranges as its values need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import shared_table


def ranks(counts: DataFrame, value: str, n: str, keys: list[str]) -> DataFrame:
    """(keys, value, n, upto, total): upto is the rank of the last row with the value, total the group's rows.

    counts: one row per (keys, value) with its number of rows n. Groups with a null key are left out."""
    known = counts.where(F.col(value).isNotNull()).na.drop(subset=keys) if keys else counts.where(F.col(value).isNotNull())
    # Written once: both uses below must see the same ranges.
    part = known.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id())
    part = shared_table(part.select(*keys, value, n, "_p"), "ranks")
    sums = part.groupBy(*keys, "_p").agg(F.sum(n).alias("_s"))
    order = Window.partitionBy(*keys).orderBy("_p")
    before = F.coalesce(F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.select(*keys, "_p", before.alias("_before"), F.sum("_s").over(Window.partitionBy(*keys)).alias("total"))
    run = F.sum(n).over(Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("_run", run).join(ranges, [*keys, "_p"]).select(
        *keys, value, n, (F.col("_before") + F.col("_run")).alias("upto"), "total"
    )


def medians(counts: DataFrame, value: str, n: str, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the middle value of each group, the mean of the two middle ones for an even number."""
    r = ranks(counts, value, n, keys)

    def at(rank):
        return F.max(F.when((F.col("upto") - F.col(n) < rank) & (rank <= F.col("upto")), F.col(value)))

    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    return r.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))


def percentiles(counts: DataFrame, value: str, n: str, keys: list[str], levels: dict[str, float]) -> DataFrame:
    """(keys, a column per level): exact percentiles, between two values in proportion, as SQL's percentile_cont."""
    r = ranks(counts, value, n, keys)
    out = []
    for name, level in levels.items():
        place = (F.col("total") - 1) * F.lit(level) + 1  # ranks from 1
        low = F.floor(place)

        def at(rank):
            return F.max(F.when((F.col("upto") - F.col(n) < rank) & (rank <= F.col("upto")), F.col(value)))

        a, b = at(low), at(F.least(low + 1, F.col("total")))
        out.append((a + F.max(place - low) * (b - a)).alias(name))
    return r.groupBy(*keys).agg(*out)


def grouped_medians(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """(keys, name): exact medians of a column of type double."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return medians(counts, value, "_c", keys, name)


def grouped_percentiles(df: DataFrame, value: str, keys: list[str], levels: dict[str, float]) -> DataFrame:
    counts = df.groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("_c"))
    return percentiles(counts, value, "_c", keys, levels)


def upper_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """(name): the middle value of a column, of two the larger; no row for a column without values."""
    r = ranks(df.groupBy(value).agg(F.count(F.lit(1)).alias("_c")), value, "_c", [])
    rank = F.floor(F.col("total") / 2) + 1
    return r.where((F.col("upto") - F.col("_c") < rank) & (rank <= F.col("upto"))).select(F.col(value).alias(name))
