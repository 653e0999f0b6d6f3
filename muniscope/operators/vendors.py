"""Vendor-network rules, each as a relation of suspicious vendors found in the data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def concentration(works: DataFrame, share: float = 0.7, least: int = 1) -> DataFrame:
    """(mp, vendor, works, share): vendors with at least ``share`` of an official's works."""
    by = works.groupBy("mp", "vendor").agg(F.count(F.lit(1)).alias("works"))
    total = by.groupBy("mp").agg(F.sum("works").alias("total"))
    out = by.join(total, "mp").where(F.col("total") >= least)
    return out.withColumn("share", F.col("works") / F.col("total")).where(F.col("share") >= share).drop("total")


def shell(works: DataFrame, registered: DataFrame, days: int = 30) -> DataFrame:
    """(vendor, gap): vendors registered at most ``days`` before their first win."""
    first = works.groupBy("vendor").agg(F.min("day").alias("first_win"))
    gap = F.datediff("first_win", "registered")
    return first.join(registered, "vendor").withColumn("gap", gap).where(gap.between(0, days)).select("vendor", "gap")


def neighbouring_bids(works: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(mp, day, vendor, other): bids of two vendors next to each other in order of amount, same official and day, within
    ``tolerance``. A quick look: a bid between two others hides that these are near; collusion_pairs has them all."""
    w = Window.partitionBy("mp", "day").orderBy("amount", "vendor")
    near = works.withColumn("other", F.lead("vendor").over(w)).withColumn("next", F.lead("amount").over(w))
    close = (F.col("next") - F.col("amount")) <= tolerance * F.col("next")
    return near.where((F.col("vendor") != F.col("other")) & close).select("mp", "day", "vendor", "other")


def collusion_pairs(works: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(mp, day, vendor, other): all pairs of vendors with bids within ``tolerance`` of the higher one, same official and day.

    Bids meet in geometric buckets of amounts a little wider than the tolerance, their own and the
    next one, then by the exact test. Only a bid of zero is near one of zero; none is near a negative one."""
    width = -math.log(1 - tolerance) * 1.0001
    bucket = F.when(F.col("amount") > 0, F.floor(F.log("amount") / width)).when(F.col("amount") == 0, F.lit(-(1 << 40)))
    bids = works.select("mp", "day", "vendor", "amount", bucket.alias("_b")).where("_b IS NOT NULL").distinct()
    low = bids.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") + 1)))
    high = bids.select("mp", "day", "_b", F.col("vendor").alias("other"), F.col("amount").alias("next"))
    near = (F.col("next") >= F.col("amount")) & (F.col("next") - F.col("amount") <= tolerance * F.col("next"))
    met = low.join(high, ["mp", "day", "_b"]).where(near & (F.col("vendor") != F.col("other")))
    return met.select("mp", "day", F.least("vendor", "other").alias("vendor"), F.greatest("vendor", "other").alias("other")).distinct()


def split_invoicing(works: DataFrame, limit: float, under: float = 0.1, days: int = 7) -> DataFrame:
    """(vendor, mp, invoices, total): amounts just under a limit, some days apart at most, above it together."""
    low = works.where((F.col("amount") < limit) & (F.col("amount") >= limit * (1 - under)))
    order = Window.partitionBy("vendor", "mp").orderBy("day", "id")
    fresh = F.coalesce(F.datediff("day", F.lag("day").over(order)) > days, F.lit(True)).cast("int")
    runs = low.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("vendor", "mp", "_run").agg(F.count(F.lit(1)).alias("invoices"), F.sum("amount").alias("total"))
    return found.where((F.col("invoices") > 1) & (F.col("total") > limit)).drop("_run")


def round_trips(awards: DataFrame, payments: DataFrame, first: int = 2, last: int = 10, low: float = 0.90, high: float = 0.98) -> DataFrame:
    """(award, payment): a payment of 90-98 % of an award 2-10 days later by the same party.

    The interval becomes an equi-join: each award meets payments of the week it reaches into."""
    days = last - first + 1
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    a = awards.withColumn("_b", F.explode(F.array(bucket(F.date_add("day", first)), bucket(F.date_add("day", first)) + 1)))
    p = payments.select(F.col("id").alias("payment"), F.col("party").alias("_p"), F.col("day").alias("_d"), F.col("amount").alias("_a"), bucket(F.col("day")).alias("_b"))
    gap = F.datediff("_d", "day")
    met = a.join(p, (a["party"] == p["_p"]) & (a["_b"] == p["_b"]))
    share = F.col("_a") / F.col("amount")
    return met.where(gap.between(first, last) & share.between(low, high)).select(F.col("id").alias("award"), "payment").distinct()


def rollup(works: DataFrame, centrality: DataFrame, patterns: DataFrame) -> DataFrame:
    """A vendor's works, number of officials, total, patterns and score; officials_of lists who they are."""
    by = works.groupBy("vendor", "mp").agg(F.count(F.lit(1)).alias("_n"), F.sum("amount").alias("_sum"))
    base = by.groupBy("vendor").agg(F.sum("_n").alias("works"), F.count("mp").alias("officials"), F.sum("_sum").alias("total"))
    found = patterns.groupBy("vendor").agg(F.count_distinct("pattern").alias("patterns"))
    out = base.join(centrality, "vendor", "left").join(found, "vendor", "left").na.fill({"centrality": 0.0, "patterns": 0})
    score = F.least(F.least(0.3 * F.col("patterns"), F.lit(1.0)) + 0.2 * F.col("centrality"), F.lit(1.0))
    return out.withColumn("score", score)


def officials_of(works: DataFrame, vendors: DataFrame) -> DataFrame:
    """(vendor, mps): the officials of the given vendors, for a page of them, as one text each."""
    mine = works.join(vendors.select("vendor").distinct(), "vendor", "left_semi").select("vendor", F.col("mp").cast("string").alias("mp")).distinct()
    return mine.groupBy("vendor").agg(F.array_join(F.array_sort(F.collect_list("mp")), ";").alias("mps"))
