"""Peer statistics: robust z on a ladder of groups, and the rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared_table
from .quantiles import medians, ranks

MIN_PEERS = 10
MAD_SCALE = 1.4826
FLAG_Z = 2.5


def robust_scale(median: Column, mad: Column) -> Column:
    """The spread a deviation is measured by; a tenth of the median where the MAD is zero."""
    return F.when(mad > 0, mad * MAD_SCALE).otherwise(F.greatest(F.abs(median) * 0.1, F.lit(1.0)))


def ladder_z(df: DataFrame, value: str, category: str, place: str, min_peers: int = MIN_PEERS) -> DataFrame:
    """df with peer_level, peer_group, peer_size, peer_median, peer_scale and z.

    A row's peers are its category in its place if these are min_peers at least, else its
    category everywhere, else all rows. Sizes count rows, medians skip nulls, and a wider
    group holds every row of the category. A null value has z 0; a null category or place has no
    group of its own. Values are counted once by (category, place); the wider rungs add these counts
    up, and the medians of all rungs come from one table of ranks, so no task holds a group."""
    rungs = [("place", [category, place]), ("category", [category]), ("all", [])]
    df = shared_table(df, "ladder")  # what it was made from is not computed again
    cells = df.groupBy(category, place, value).agg(F.count(F.lit(1)).alias("_k"))
    steps = F.array(
        *(
            F.struct(F.lit(name).alias("_rung"), *(F.col(k) if k in keys else F.lit("").alias(k) for k in (category, place)))
            for name, keys in rungs
        )
    )
    by = ["_rung", category, place]
    stacked = cells.select(F.inline(steps), F.col(value), "_k").na.drop(subset=by)
    counts = shared_table(stacked.groupBy(*by, value).agg(F.sum("_k").alias("_k")), "counts")
    middle = shared_table(medians(counts, value, "_k", by, "_m"), "medians")  # a row per group, used twice
    away = counts.join(middle, by).withColumn("_away", F.abs(F.col(value) - F.col("_m"))).groupBy(*by, "_away")
    mad = medians(away.agg(F.sum("_k").alias("_k")), "_away", "_k", by, "_d")
    size = counts.groupBy(*by).agg(F.sum("_k").alias("_n"))
    stats = shared_table(size.join(middle, by, "left").join(mad, by, "left"), "ladder-stats")
    out = df
    for name, keys in rungs[:2]:
        mine = stats.where(F.col("_rung") == name).select(*keys, *(F.col(c).alias(f"{c}_{name}") for c in ("_n", "_m", "_d")))
        out = out.join(mine, keys, "left")
    total = stats.where("_rung = 'all'")
    out = out.withColumns({f"{c}_all": total.select(c).scalar() for c in ("_n", "_m", "_d")})

    def pick(prefix: str) -> Column:
        a, b, c = (F.col(f"{prefix}{name}") for name, _ in rungs)
        return (
            F.when(F.col("_n_place") >= min_peers, a).when(F.col("_n_category") >= min_peers, b).otherwise(c)
        )

    level = (
        F.when(F.col("_n_place") >= min_peers, "place").when(F.col("_n_category") >= min_peers, "category").otherwise("all")
    )
    out = out.withColumns(
        {
            "peer_level": level,
            "peer_size": pick("_n_"),
            "peer_median": pick("_m_"),
            "peer_scale": robust_scale(pick("_m_"), pick("_d_")),
        }
    )
    group = (
        F.when(F.col("peer_level") == "place", F.concat_ws(" | ", category, place))
        .when(F.col("peer_level") == "category", F.col(category))
        .otherwise(F.lit("all"))
    )
    z = F.coalesce((F.col(value) - F.col("peer_median")) / F.col("peer_scale"), F.lit(0.0))
    made = [f"_{s}_{name}" for name, _ in rungs for s in "nmd"]
    return out.withColumn("peer_group", group).withColumn("z", z).drop(*made)


def group_threshold(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, median, mad, threshold) of the rows assigned to a group."""
    by = list(keys)
    counts = shared_table(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k")), "counts")
    size = counts.groupBy(*by).agg(F.sum("_k").alias("n"))
    middle = shared_table(medians(counts, value, "_k", by, "median"), "medians")
    away = counts.join(middle, by).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    mad = medians(away.groupBy(*by, "_away").agg(F.sum("_k").alias("_k")), "_away", "_k", by, "mad")
    out = size.join(middle, by).join(mad, by)
    return out.withColumn("threshold", F.col("median") + FLAG_Z * robust_scale(F.col("median"), F.col("mad")))


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """df with pct_rank: the mean rank of ties over the number of rows.

    Ranks come from counts per distinct value, summed over ranges of values, so no task holds all rows."""
    r = ranks(df.groupBy(value).agg(F.count(F.lit(1)).alias("_k")), value, "_k", [])
    pct = (F.col("upto") - (F.col("_k") - 1) / 2.0) / F.col("total")
    return df.join(r.select(value, pct.alias("pct_rank")), value)


def mean_std_z(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """df with z against the group's mean and sample deviation, 0 where that is 0 or null."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    z = F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    return df.join(stats, list(keys)).withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_mean", "_std")


def top_feature(deviations: dict[str, Column]) -> Column:
    """Name of the largest absolute deviation; ties go to the first."""
    most = F.greatest(*(F.abs(d) for d in deviations.values()))
    out = F.lit(None).cast("string")
    for name, d in reversed(deviations.items()):
        out = F.when(F.abs(d) == most, name).otherwise(out)
    return out
