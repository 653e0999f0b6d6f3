"""Funds an official is about to spend, and thresholds that follow the outcomes of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How fast level and trend follow new months.
ALPHA, BETA = 0.5, 0.3


def monthly(df: DataFrame, key: str, at: str, amount: str) -> DataFrame:
    """(key, month, amount): sums by month, month a number that grows by one each month."""
    month = F.year(at) * 12 + F.month(at) - 1
    return df.groupBy(key, month.cast("int").alias("month")).agg(F.sum(amount).alias("amount"))


def smoothed(series: DataFrame, key: str, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """(key, months, last, level, trend): double exponential smoothing of (key, month, amount), a month without rows is 0.

    An ordered fold over the months of a key, of which there are as many as the data spans, whatever its rows: sums by
    month come first. The first month is the level, the second less the first the trend."""
    span = series.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("month", "amount"))).alias("m"), F.min("month").alias("low"), F.max("month").alias("last"))
    filled = span.withColumn("x", F.transform(F.sequence("low", "last"), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))))
    first = F.get("x", F.lit(0))
    start = F.struct(first.alias("level"), (F.coalesce(F.get("x", F.lit(1)), first) - first).alias("trend"))

    def step(s: Column, x: Column) -> Column:
        level = alpha * x + (1 - alpha) * (s.level + s.trend)
        return F.struct(level.alias("level"), (beta * (level - s.level) + (1 - beta) * s.trend).alias("trend"))

    state = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), start, step)
    return filled.select(key, F.size("x").alias("months"), "last", state.alias("s")).select(key, "months", "last", "s.level", "s.trend")


def fund_forecast(spent: DataFrame, granted: DataFrame, key: str, ahead: int = 6) -> DataFrame:
    """(key, level, trend, forecast, balance, absorbed): what ``ahead`` months are expected to take of what is left.

    spent: (key, month, amount); granted: (key, amount). forecast sums the months ahead, none below 0; absorbed is its
    share of the balance, at most 1, null where nothing is left."""
    s = smoothed(spent, key)
    ahead_of = lambda h: F.greatest(F.lit(0.0), F.col("level") + h * F.col("trend"))
    total = sum((ahead_of(h) for h in range(1, ahead + 1)), F.lit(0.0))
    paid = spent.groupBy(key).agg(F.sum("amount").alias("_paid"))
    given = granted.groupBy(key).agg(F.sum("amount").alias("_given"))
    met = s.join(paid, key).join(given, key, "left").withColumn("balance", F.coalesce("_given", F.lit(0.0)) - F.col("_paid")).withColumn("forecast", total)
    share = F.when(F.col("balance") > 0, F.least(F.lit(1.0), F.col("forecast") / F.col("balance")))
    return met.select(key, "level", "trend", "forecast", "balance", share.alias("absorbed"))


def calibrated(reviews: DataFrame, weights: dict[str, float], threshold: float, target: float = 0.7, least: int = 10, most: float = 0.1) -> DataFrame:
    """(signal, reviewed, precision, threshold, weight): where each signal should be raised, and what it should weigh.

    reviews: (signal, score 0..1, confirmed boolean; null is open). The wanted threshold is the least hundredth from which on at
    least ``target`` of ``least`` or more reviewed alerts were confirmed; without one it stays. A round moves a threshold by ``most`` at
    most, and a weight by the share confirmed against that of all signals, between half and twice; weights keep their sum.
    Scores are counted by hundredths first, so no task holds more than a hundred rows of a signal."""
    spark = reviews.sparkSession
    known = spark.createDataFrame(list(weights.items()), "signal string, old double")
    bin_ = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("score") * 100 + 1e-9))).cast("int")
    binned = reviews.where("confirmed IS NOT NULL AND score IS NOT NULL").groupBy("signal", bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if("confirmed").alias("k"))
    up = Window.partitionBy("signal").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    above = binned.withColumns({"n_up": F.sum("n").over(up), "k_up": F.sum("k").over(up)})
    wanted = above.groupBy("signal").agg(
        F.sum("n").alias("reviewed"), F.sum("k").alias("k"), F.min(F.when((F.col("n_up") >= least) & (F.col("k_up") >= target * F.col("n_up")), F.col("b"))).alias("b")
    )
    total = wanted.agg((F.sum("k") / F.sum("reviewed")).alias("all"))
    met = known.join(wanted, "signal", "left").withColumn("precision", F.col("k") / F.col("reviewed"))
    moved = F.when(F.col("b").isNotNull(), F.least(F.lit(threshold + most), F.greatest(F.lit(threshold - most), F.col("b") / 100)))
    factor = F.coalesce(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("precision") / total.scalar())), F.lit(1.0))
    raw = met.withColumns({"threshold": F.coalesce(moved, F.lit(threshold)), "_raw": F.col("old") * factor})
    scale = raw.agg((F.sum("old") / F.sum("_raw")).alias("s"))
    return raw.select("signal", F.coalesce("reviewed", F.lit(0).cast("long")).alias("reviewed"), "precision", "threshold", (F.col("_raw") * scale.scalar()).alias("weight"))
