"""How many planted irregularities the rules of either branch find: assets seen from above (A), and all other works (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below this an amount is parked under a threshold; above this sum an official is ahead of the entitlement.
STRUCTURING_BELOW, PACE_ABOVE, COST_Z = 1_000_000.0, 50_000_000.0, 2.5
UNCHANGED = ("phantom_work", "coordinate_reuse", "backdated_completion")
GENUINE = ("genuine", "genuine_unverified")


def branch_report(works: DataFrame, truth: DataFrame, change: DataFrame, below: float = STRUCTURING_BELOW, pace: float = PACE_ABOVE, z: float = COST_Z) -> DataFrame:
    """(branch, pattern, hits, total): for each planted pattern how many of its works its rule flags.

    works: (id, branch, mp, category, amount, description, has_images); truth: (id, branch, pattern, asset, cluster), cluster a list of
    ids or null for the one; change: (asset, changed). In branch A an invented work shows no change; genuine ones must show it,
    counted among assets that were looked at. In branch B ids that are no works count in the total and are not found."""
    a = truth.where("branch = 'A'").join(change.groupBy("asset").agg(F.min("changed").alias("changed")), "asset", "left")
    invented = a.where(F.col("pattern").isin(*UNCHANGED)).groupBy("pattern").agg(F.count_if(~F.col("changed")).alias("hits"), F.count(F.lit(1)).alias("total"))
    genuine = a.where(F.col("pattern").isin(*GENUINE) & F.col("changed").isNotNull()).agg(F.count_if("changed").alias("hits"), F.count(F.lit(1)).alias("total"))
    genuine = genuine.select(F.lit("genuine_correctly_not_flagged").alias("pattern"), "hits", "total")

    b = works.where("branch = 'B'")
    peers = b.groupBy("category").agg(F.avg("amount").alias("_mean"), F.stddev_samp("amount").alias("_std"))
    texts = b.groupBy("description", "mp").agg(F.count(F.lit(1)).alias("_same"))
    totals = b.groupBy("mp").agg(F.sum("amount").alias("_total"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("description", "mp")]
    judged = b.alias("b").join(texts.alias("t"), same).select("b.*", "_same").join(peers, "category", "left").join(totals, "mp", "left")
    judged = judged.select(
        "id", "mp", (F.col("amount") < below).alias("structuring"), (~F.col("has_images")).alias("missing_evidence"),
        ((F.col("_std") > 0) & ((F.col("amount") - F.col("_mean")) / F.col("_std") > z)).alias("cost_outlier"),
        (F.col("_same") > 1).alias("cross_year_text_duplicate"), (F.col("_total") > pace).alias("entitlement_pace_cluster"),
    )
    planted = truth.where("branch = 'B'").select("pattern", F.explode(F.coalesce("cluster", F.array("id"))).alias("id")).distinct()
    met = planted.join(judged, "id", "left")
    rules = ["structuring", "missing_evidence", "cost_outlier", "cross_year_text_duplicate", "entitlement_pace_cluster"]
    flag = F.lit(None).cast("boolean")
    for name in rules:
        flag = F.when(F.col("pattern") == name, F.col(name)).otherwise(flag)
    works_found = met.where(F.col("pattern").isin(*rules[:-1])).groupBy("pattern").agg(F.count_if(flag).alias("hits"), F.count(F.lit(1)).alias("total"))
    # Pace is a matter of officials, not of works.
    officials = met.where((F.col("pattern") == rules[-1]) & F.col("mp").isNotNull()).select("pattern", "mp", flag.alias("f")).distinct()
    officials = officials.groupBy("pattern").agg(F.count_if("f").alias("hits"), F.count(F.lit(1)).alias("total"))
    side = lambda d, name: d.select(F.lit(name).alias("branch"), "pattern", "hits", "total")
    return side(invented, "A").unionByName(side(genuine, "A")).unionByName(side(works_found, "B")).unionByName(side(officials, "B"))
