"""Profiles of tables and attachments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import quantiles

LEVELS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def describe(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles."""
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most")
    )
    names = {f"p{round(q * 100)}": q for q in LEVELS}
    p = quantiles.grouped_percentiles(df, value, list(keys), names)
    met = out.join(p, list(keys), "left") if keys else out.join(p, F.lit(True), "left")  # one row each
    return met.select(*keys, "n", "mean", "std", "least", "most", *names)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, null_rate, distinct) of every column from one aggregate."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns),
        *(F.count_distinct(c).alias(f"d_{c}") for c in columns),
    )
    parts = [
        F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.try_divide(F.col(f"n_{c}"), "rows").alias("null_rate"), F.col(f"d_{c}").alias("distinct"))
        for c in columns
    ]
    return one.select(F.inline(F.array(*parts)))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(column, value, n): the k most frequent values of every column, null among them."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def date_failures(df: DataFrame, value: str, pattern: str) -> DataFrame:
    """(rows, blank, failed, failure_rate, first, last): how a text column parses as dates."""
    parsed = F.to_date(F.try_to_timestamp(F.col(value), F.lit(pattern)))
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    failed = F.count_if(~blank & parsed.isNull())
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("blank"), failed.alias("failed"),
        F.try_divide(failed, F.count_if(~blank)).alias("failure_rate"), F.min(parsed).alias("first"), F.max(parsed).alias("last"),
    )


def first_digits(df: DataFrame, value: str, *keys: str, least: int = 30) -> DataFrame:
    """(keys, n, chi_square) of leading digits against Benford's law, for groups of ``least`` values or more."""
    digit = F.substring(F.regexp_replace(F.format_string("%.6e", F.abs(value)), "^[^1-9]*", ""), 1, 1).cast("int")
    d = df.where(F.abs(value) > 0).select(*keys, digit.alias("d"))
    counts = d.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.collect_list(F.struct("d", "c")).alias("found")).where(F.col("n") >= least)
    have = F.map_from_entries("found")
    chi = F.lit(0.0)
    for k in range(1, 10):
        expected = F.col("n") * F.lit(math.log10(1 + 1 / k))
        seen = F.coalesce(F.try_element_at(have, F.lit(k)), F.lit(0))
        chi = chi + (seen - expected) * (seen - expected) / expected
    return total.select(*keys, "n", chi.alias("chi_square"))
