"""Queries on risk, standard signals, cases and their workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import cases, graph, quantiles
from ..sources import views
from .registry import query

_SIG = f"""{views.WORKS_SQL}, m AS (SELECT activity, median(actual_amount) AS med FROM works GROUP BY activity),
g AS (SELECT record_id AS work, CASE WHEN image_count = 1 THEN 1.0 ELSE 0.0 END AS missing, least(greatest((actual_amount - med) / med, 0) / 6, 1) AS cost,
  (actual_amount - med) / med > 1.0 AS cost_fired, date_diff('day', sanction_date, end_date) AS lag,
  CASE WHEN image_count >= 7 THEN 1.0 ELSE 0.0 END AS exact, least(image_count / 7.0, 1.0) AS anomaly FROM works JOIN m USING (activity))"""


def _signals(spark, sf):
    w = views.works(spark, sf)
    w = w.join(quantiles.grouped_medians(w, "actual_amount", ["activity"], "med"), "activity")
    over = (F.col("actual_amount") - F.col("med")) / F.col("med")
    images = F.col("image_count")
    return w.select(
        F.col("record_id").alias("work"), F.when(images == 1, 1.0).otherwise(0.0).alias("missing"), scores.cost_score(over).alias("cost"),
        (over > 1.0).alias("cost_fired"), F.datediff("end_date", "sanction_date").cast("long").alias("lag"),
        F.when(images >= 7, 1.0).otherwise(0.0).alias("exact"), F.least(images / 7.0, F.lit(1.0)).alias("anomaly"),
    )


@query(f"""WITH {_SIG}, r AS (SELECT work, exact, round(least(15 * cost + 5 * missing + 15 * anomaly + 20 * exact, 100), 2) AS risk FROM g)
SELECT work, risk, CASE WHEN exact > 0 OR risk > 80 THEN 'Critical' WHEN risk > 60 THEN 'High' WHEN risk > 30 THEN 'Moderate' ELSE 'Low' END AS band FROM r""")
def risk_score_bands(spark, sf):
    """Weighted risk with floors for strong matches; scores count even where no flag is set."""
    w = scores.WEIGHTS
    risk = w["cost_peer"] * F.col("cost") + w["missing_evidence"] * F.col("missing") + w["anomaly"] * F.col("anomaly") + w["text_exact"] * F.col("exact")
    s = _signals(spark, sf).withColumn("risk", F.round(F.least(risk, F.lit(100.0)), 2))
    return s.select("work", "risk", scores.band(F.col("risk"), F.col("exact") > 0).alias("band"))


@query(f"""WITH {_SIG}, a AS (SELECT work, 15 * cost + 5 * missing + CASE WHEN lag >= 0 THEN 15 * anomaly ELSE 0 END AS s, 20 + CASE WHEN lag >= 0 THEN 15 ELSE 0 END AS w FROM g),
r AS (SELECT work, round(100 * s / w, 2) AS risk FROM a)
SELECT work, risk, CASE WHEN risk > 80 THEN 'Critical' WHEN risk > 60 THEN 'High' WHEN risk > 30 THEN 'Moderate' ELSE 'Low' END AS band FROM r""")
def risk_applicable_only(spark, sf):
    """Signals that could not run leave the sum and the weight."""
    parts = [(15, F.col("cost")), (5, F.col("missing")), (15, F.when(F.col("lag") >= 0, F.col("anomaly")))]
    total = sum((F.coalesce(w * x, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0) for w, x in parts), F.lit(0))
    s = _signals(spark, sf).withColumn("risk", F.round(F.coalesce(F.try_divide(100 * total, weight), F.lit(0.0)), 2))
    return s.select("work", "risk", scores.band(F.col("risk")).alias("band"))


def _standard(spark, sf, s=None):
    s = s or _signals(spark, sf)
    lag = F.col("lag")
    late = F.when(lag >= 0, F.when(lag > 45, scores.excess_ratio(lag, F.lit(45.0))).otherwise(0.0))
    return cases.standard_signals(s, "work", {
        "cost_peer": (scores.importance("cost_peer", F.col("cost")), F.col("cost_fired")),
        "missing_evidence": (scores.importance("missing_evidence", F.col("missing")), F.col("missing") > 0),
        "anomaly": (scores.importance("anomaly", F.col("anomaly")), F.col("anomaly") >= 0.9),
        "text_exact": (scores.importance("text_exact", F.col("exact")), F.col("exact") > 0),
        "late_sanction": (late, lag > 45),
    })


_STD = f"""{_SIG}, std AS (
  SELECT work, 'cost_peer' AS code, 'cost_anomaly' AS cluster, cost * 0.6 AS score, cost_fired AS fired FROM g
  UNION ALL SELECT work, 'missing_evidence', 'evidence_gap', missing * 0.2, missing > 0 FROM g
  UNION ALL SELECT work, 'anomaly', 'cost_anomaly', anomaly * 0.6, anomaly >= 0.9 FROM g
  UNION ALL SELECT work, 'text_exact', 'text_duplication', exact * 0.8, exact > 0 FROM g
  UNION ALL SELECT work, 'late_sanction', 'late_sanction', CASE WHEN lag > 45 THEN least((lag - 45) / 45.0, 1) WHEN lag >= 0 THEN 0 END, lag > 45 FROM g),
sig AS (SELECT *, score IS NOT NULL AS available, CASE WHEN score IS NULL THEN 'unavailable' WHEN fired THEN 'fired' ELSE 'clear' END AS status,
  CASE WHEN score IS NOT NULL AND fired THEN CASE WHEN score >= 0.67 THEN 'strong' WHEN score >= 0.34 THEN 'medium' ELSE 'weak' END END AS strength FROM std)"""


@query(f"WITH {_STD} SELECT work, code AS signal_code, status, round(coalesce(score, 0), 5) AS score, strength, available, cluster FROM sig")
def signal_unpivot(spark, sf):
    """A typed row per work and signal."""
    return _standard(spark, sf).select("work", "signal_code", "status", F.round("score", 5).alias("score"), "strength", "available", "cluster")


@query(f"WITH {_STD} SELECT code AS signal_code, count(*) FILTER (status = 'fired') AS fired, count(*) FILTER (status = 'clear') AS clear, count(*) FILTER (status = 'unavailable') AS unavailable FROM sig GROUP BY code")
def signal_counts(spark, sf):
    """Statuses per signal."""
    s = _standard(spark, sf)
    return s.groupBy("signal_code").agg(*(F.count_if(F.col("status") == k).alias(k) for k in ("fired", "clear", "unavailable")))


@query(f"WITH {_STD} SELECT coalesce(strength, 'none') AS strength, count(*) AS n, round(avg(coalesce(score, 0)), 5) AS mean FROM sig GROUP BY 1")
def strength_buckets(spark, sf):
    """Strengths with a bucket for none."""
    s = _standard(spark, sf)
    return s.groupBy(F.coalesce("strength", F.lit("none")).alias("strength")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean"))


_CASES = f"""{_STD}, bc AS (SELECT work, cluster, max(score) FILTER (status = 'fired') AS best, count(*) FILTER (strength = 'strong') AS strong,
  count(*) FILTER (strength = 'medium') AS medium FROM sig GROUP BY work, cluster),
bw AS (SELECT work, round(count(*) FILTER (available) / count(*), 3) AS completeness, array_to_string(list_sort(list(code) FILTER (status = 'fired')), ',') AS codes FROM sig GROUP BY work),
c AS (SELECT work, sum(strong) AS strong, count(*) FILTER (medium > 0) AS mediums, sum(best) FILTER (cluster <> 'late_sanction') AS anomaly,
  sum(best) FILTER (cluster = 'late_sanction') AS slow, array_to_string(list_sort(list(cluster) FILTER (best IS NOT NULL)), ',') AS clusters FROM bc GROUP BY work),
cases AS (SELECT c.work, clusters, codes, round(least(coalesce(c.anomaly, 0), 1), 3) AS anomaly_priority, round(least(coalesce(slow, 0), 1), 3) AS inefficiency_priority, completeness,
  CAST(CASE WHEN lag < 0 THEN 0.2 WHEN missing > 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS confidence,
  CASE WHEN clusters = 'late_sanction' AND lag - 45 < 225 THEN 'systemic_cohort' ELSE 'actionable' END AS tier
  FROM c JOIN bw USING (work) JOIN g USING (work) WHERE strong > 0 OR mediums >= 2)"""


def _cases(spark, sf):
    s = graph.shared_table(_signals(spark, sf), "signals")  # three inputs of one operator
    severities = s.where("lag < 0").select("work", F.lit("critical").alias("severity")).unionByName(
        s.where("missing > 0").select("work", F.lit("warning").alias("severity"))
    )
    over = s.where("lag > 45").select("work", (F.col("lag") - 45).alias("days_over"))
    return cases.consolidate(_standard(spark, sf, s), severities, over)


@query(f"WITH {_CASES} SELECT work, clusters, codes, anomaly_priority, inefficiency_priority, completeness, confidence, tier FROM cases")
def case_candidates(spark, sf):
    """Signals consolidated into at most one case per work."""
    return _cases(spark, sf).select(
        "work", F.array_join("clusters_fired", ",").alias("clusters"), F.array_join("signal_codes", ",").alias("codes"), "anomaly_priority",
        "inefficiency_priority", F.col("evidence_completeness").alias("completeness"), F.col("source_data_confidence").alias("confidence"), F.col("review_tier").alias("tier"),
    )


@query(f"""WITH {_CASES} SELECT tier, CASE WHEN anomaly_priority + inefficiency_priority >= 0.8 THEN 'critical' ELSE 'other' END AS priority, count(*) AS n,
  round(avg(completeness), 5) AS completeness FROM cases GROUP BY 1, 2""")
def case_calibration(spark, sf):
    """Cases by tier and priority band."""
    high = F.col("anomaly_priority") + F.col("inefficiency_priority") >= 0.8
    return _cases(spark, sf).groupBy(F.col("review_tier").alias("tier"), F.when(high, "critical").otherwise("other").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("evidence_completeness"), 5).alias("completeness")
    )


@query(f"""WITH {_CASES} SELECT work, anomaly_priority, inefficiency_priority FROM cases WHERE tier = 'actionable'
ORDER BY anomaly_priority + inefficiency_priority DESC, work LIMIT 40 OFFSET 20""")
def case_priority_page(spark, sf):
    """The second page of actionable cases."""
    c = _cases(spark, sf).where("review_tier = 'actionable'").select("work", "anomaly_priority", "inefficiency_priority")
    return c.orderBy((F.col("anomaly_priority") + F.col("inefficiency_priority")).desc(), "work").offset(20).limit(40)


@query(f"""WITH {_CASES}, old AS (SELECT work FROM cases WHERE anomaly_priority >= 0.6) SELECT work, 'NEW' AS status FROM cases WHERE work NOT IN (SELECT work FROM old)""")
def case_insert_if_new(spark, sf):
    """Cases not yet on record enter as NEW."""
    c = _cases(spark, sf)
    return c.join(c.where("anomaly_priority >= 0.6").select("case_id"), "case_id", "left_anti").select("work", F.lit("NEW").alias("status"))
