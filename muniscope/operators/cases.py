"""Standard signals and the cases they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import strength
from ..functions.text import case_id

VERSION = "cases-v1"
SEVERE_DAYS = 225

#: Signals that measure one thing form a cluster; clusters feed one dimension.
CLUSTERS = {
    "cost_peer": "cost_anomaly",
    "anomaly": "cost_anomaly",
    "missing_evidence": "evidence_gap",
    "photo_identical": "photo_duplication",
    "photo_similar": "photo_duplication",
    "text_exact": "text_duplication",
    "text_similar": "text_duplication",
    "entitlement_pace": "entitlement",
    "late_sanction": "late_sanction",
    "long_open_work": "long_open_work",
}
INEFFICIENCY = ("late_sanction", "long_open_work")


def cluster_of(code: Column) -> Column:
    known = F.create_map(*(F.lit(v) for kv in CLUSTERS.items() for v in kv))
    return F.coalesce(F.try_element_at(known, code), code)


def standard_signals(df: DataFrame, work: str, signals: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Unpivot: (work, signal_code, signal_family, status, score, strength, available, cluster) per signal.

    signals: code -> (score or null where it could not run, fired)."""
    entries = [
        F.struct(F.lit(code).alias("signal_code"), score.cast("double").alias("score"), F.coalesce(fired, F.lit(False)).alias("fired"))
        for code, (score, fired) in signals.items()
    ]
    long = df.select(F.col(work).alias("work"), F.inline(F.array(*entries)))
    available = F.col("score").isNotNull()
    family = F.when(F.col("signal_code").isin(*INEFFICIENCY), "inefficiency").otherwise("anomaly")
    status = F.when(~available, "unavailable").when(F.col("fired"), "fired").otherwise("clear")
    return long.select(
        "work", "signal_code", family.alias("signal_family"), status.alias("status"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        strength(F.col("score"), available & F.col("fired")).alias("strength"),
        available.alias("available"), cluster_of(F.col("signal_code")).alias("cluster"),
    )


def consolidate(signals: DataFrame, severities: DataFrame | None = None, days_over: DataFrame | None = None) -> DataFrame:
    """At most one case per work.

    A case needs a strong fired signal, or medium ones in two clusters. Priorities add the best
    score of each fired cluster; completeness is the share of signals that could run.
    severities: (work, severity) of open alerts. days_over: (work, days_over) of late sanctions.
    Everything is an aggregate by (work, cluster), then by work: no list of rows is collected
    beyond a work's ten clusters."""
    fired = F.col("status") == "fired"
    told = F.col("status").isin("fired", "candidate_only")
    state = F.concat_ws(":", "signal_code", "status", F.coalesce("strength", F.lit("")))
    by_cluster = signals.groupBy("work", "cluster").agg(
        F.max(F.when(fired, F.col("score"))).alias("best"),
        F.count_if(fired & (F.col("strength") == "strong")).alias("strong"),
        F.count_if(fired & (F.col("strength") == "medium")).alias("medium"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("available")).alias("available"),
        F.collect_set(F.when(fired, F.col("signal_code"))).alias("codes"),
        F.collect_set(F.when(told, state)).alias("states"),
    )
    slow = F.col("cluster").isin(*INEFFICIENCY)
    cases = by_cluster.groupBy("work").agg(
        F.sum("strong").alias("strong"),
        F.count_if(F.col("medium") > 0).alias("medium_clusters"),
        F.sum(F.when(~slow, F.col("best"))).alias("anomaly"),
        F.sum(F.when(slow, F.col("best"))).alias("inefficiency"),
        (F.sum("available") / F.sum("n")).alias("share"),
        F.array_sort(F.collect_set(F.when(F.col("best").isNotNull(), F.col("cluster")))).alias("clusters_fired"),
        F.array_sort(F.flatten(F.collect_list("codes"))).alias("signal_codes"),
        F.array_sort(F.flatten(F.collect_list("states"))).alias("states"),
    ).where("strong > 0 OR medium_clusters >= 2")
    confidence = F.lit(1.0)
    if severities is not None:
        worst = severities.groupBy(F.col("work").alias("_w")).agg(
            F.bool_or(F.col("severity") == "critical").alias("_critical"), F.bool_or(F.col("severity") == "warning").alias("_warning")
        )
        cases = cases.join(worst, cases["work"] == worst["_w"], "left")
        confidence = F.when(F.col("_critical"), 0.2).when(F.col("_warning"), 0.5).otherwise(1.0)
    over = F.lit(None).cast("long")
    if days_over is not None:
        most = days_over.groupBy(F.col("work").alias("_d")).agg(F.max("days_over").alias("_over"))
        cases = cases.join(most, cases["work"] == most["_d"], "left")
        over = F.col("_over")
    late_only = F.col("clusters_fired") == F.array(F.lit("late_sanction"))
    cohort = late_only & F.coalesce(over < SEVERE_DAYS, F.lit(True))
    state_id = F.substring(F.sha1(F.array_join("states", ";")), 1, 12)
    return cases.select(
        case_id(F.col("work"), F.col("clusters_fired"), state_id, VERSION).alias("case_id"),
        "work", "clusters_fired", "signal_codes",
        F.round(F.least(F.coalesce("anomaly", F.lit(0.0)), F.lit(1.0)), 3).alias("anomaly_priority"),
        F.round(F.least(F.coalesce("inefficiency", F.lit(0.0)), F.lit(1.0)), 3).alias("inefficiency_priority"),
        F.round("share", 3).alias("evidence_completeness"),
        confidence.alias("source_data_confidence"),
        F.when(cohort, "systemic_cohort").otherwise("actionable").alias("review_tier"),
    )
