"""Data-quality alerts: one row per broken rule, kept apart from every risk score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import alert_id, blank, work_key
from ..sources import sinks
from .graph import shared_table

VERSION = "quality-checks-v2"

#: Each code's severity and the signals it touches.
SEVERITY = {
    "work_id_missing": "critical",
    "work_id_duplicate": "critical",
    "amount_parsing_failed": "critical",
    "amount_unit_ambiguous": "warning",
    "amount_missing": "warning",
    "amount_negative": "critical",
    "amount_zero": "warning",
    "date_missing_or_invalid": "warning",
    "date_sequence_invalid": "critical",
    "location_missing_or_invalid": "warning",
    "category_unknown": "info",
    "record_malformed": "critical",
    "image_expected_missing": "info",
    "sanctioned_stage_incomplete": "info",
}
_ALL = "cost_peer missing_evidence anomaly photo_identical photo_similar text_exact text_similar entitlement_pace".split()
_COST = ["cost_peer", "anomaly", "entitlement_pace"]
AFFECTED = {
    "work_id_missing": _ALL,
    "work_id_duplicate": _ALL,
    "amount_parsing_failed": _COST,
    "amount_unit_ambiguous": _COST,
    "amount_missing": _COST,
    "amount_negative": _COST,
    "amount_zero": _COST,
    "date_missing_or_invalid": ["anomaly"],
    "date_sequence_invalid": ["anomaly"],
    "location_missing_or_invalid": ["cost_peer", "anomaly"],
    "category_unknown": ["cost_peer"],
    "record_malformed": _ALL,
    "image_expected_missing": ["missing_evidence", "photo_identical", "photo_similar"],
    "sanctioned_stage_incomplete": [],
}


@dataclass
class Rule:
    code: str
    field: str
    holds: Column
    raw: Column


def standard_rules(known_categories: list[str] | None = None) -> list[Rule]:
    """The rules over a canonical frame with its usual column names."""
    c = F.col
    rules = [
        Rule("work_id_missing", "work_id", c("has_first") & blank(c("work_id")), c("work_id")),
        Rule("record_malformed", "record", blank(c("work_description")) & blank(c("mp_name")) & blank(c("state_name")), c("record_id")),
    ]
    for field, expected in (("actual_amount", "has_first"), ("sanction_amount", "has_second")):
        status, raw, value = c(f"{field}_status"), c(f"{field}_raw"), c(field)
        rules += [
            Rule("amount_parsing_failed", field, status == "unparseable", raw),
            Rule("amount_unit_ambiguous", field, status == "ambiguous_unit", raw),
            Rule("amount_missing", field, c(expected) & (status == "missing"), raw),
            Rule("amount_negative", field, value < 0, raw),
            Rule("amount_zero", field, value == 0, raw),
        ]
    for field, expected in (("actual_end_date", "has_first"), ("sanction_date", "has_second"), ("recommendation_date", "has_second")):
        rules.append(Rule("date_missing_or_invalid", field, c(expected) & c(field).isNull(), c(f"{field}_raw")))
    for later, earlier in (("actual_end_date", "sanction_date"), ("sanction_date", "recommendation_date")):
        raw = F.concat_ws(" before ", c(f"{later}_raw"), c(f"{earlier}_raw"))
        rules.append(Rule("date_sequence_invalid", later, c(later) < c(earlier), raw))
    place = F.concat(F.lit("state="), F.coalesce("state_name", F.lit("")), F.lit(" constituency="), F.coalesce("constituency", F.lit("")))
    rules.append(Rule("location_missing_or_invalid", "state_name/constituency", blank(c("state_name")) | blank(c("constituency")), place))
    unknown = blank(c("work_category"))
    if known_categories is not None:
        unknown = unknown | ~F.upper(F.trim("work_category")).isin(*known_categories)
    rules += [
        Rule("category_unknown", "work_category", unknown, c("work_category")),
        Rule("image_expected_missing", "attachment_filenames", F.array_contains("issues", "attachment_missing"), c("attachment_filenames")),
        Rule("sanctioned_stage_incomplete", "work_stage", c("has_first") & c("has_second") & (c("sanctioned_work_stage") != "Work Completed"), c("sanctioned_work_stage")),
    ]
    return rules


def alerts(df: DataFrame, rules: list[Rule], *carry: str) -> DataFrame:
    """(id, work_id, quality_code, severity, field, raw_value, affected_analyses, status, ..., group_key).

    All rules are structs of one array, filtered and exploded: one pass over the rows."""
    severity = F.create_map(*(F.lit(v) for kv in SEVERITY.items() for v in kv))
    affected = F.create_map(*(x for k, v in AFFECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    entries = F.array(
        *(
            F.struct(
                F.coalesce(r.holds, F.lit(False)).alias("holds"),
                F.lit(r.code).alias("quality_code"),
                F.lit(r.field).alias("field"),
                r.raw.cast("string").alias("raw_value"),
            )
            for r in rules
        )
    )
    work = work_key(F.col("work_id"), F.col("record_id")).alias("work_id")
    hits = df.select(work, *carry, F.explode(F.filter(entries, lambda e: e.holds)).alias("e"))
    return hits.select(
        alert_id(F.col("work_id"), F.col("e.quality_code"), F.col("e.field"), F.col("e.raw_value")).alias("id"),
        "work_id",
        "e.quality_code",
        severity[F.col("e.quality_code")].alias("severity"),
        "e.field",
        "e.raw_value",
        affected[F.col("e.quality_code")].alias("affected_analyses"),
        F.lit("open").alias("status"),
        F.lit(VERSION).alias("detector_version"),
        F.concat_ws("|", "e.quality_code", "e.field").alias("group_key"),
        *carry,
    )


def duplicated(df: DataFrame, key: str, record: str) -> DataFrame:
    """(key, records, n): keys that stand on more than one record."""
    spread = df.where(~blank(F.col(key))).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.col(record).cast("string"))).alias("records")
    )
    return spread.where("n > 1")


def alert_groups(found: DataFrame) -> DataFrame:
    """Root causes, the most frequent first, each with its least alert as a sample."""
    return found.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("status") == "open").alias("open"), F.min("id").alias("sample")
    ).orderBy(F.desc("alerts"), "group_key")


def resolve_alerts(alerts: DataFrame, requests: DataFrame, log: str, audit: str) -> None:
    """Take requests (alert_id, status, reason, actor, in_scope, at) to settle alerts: those that may are appended to ``log``,
    and every one, taken or not, to ``audit`` with the state before and after it.

    An alert that nobody knows is not_found, one outside of the actor's scope forbidden; the log keeps all that was
    decided, of which the latest counts (see alert_states)."""
    spark = alerts.sparkSession
    known = alerts.select(F.col("id").alias("alert_id"), F.lit(True).alias("_known"))
    verdict = F.when(F.col("_known").isNull(), "not_found").when(~F.col("in_scope"), "forbidden").otherwise("ok")
    judged = requests.join(known, "alert_id", "left").withColumn("verdict", verdict).drop("_known")
    before = spark.createDataFrame([], "alert_id string, _was string")
    if sinks.exists(spark, log):
        before = sinks.upsert_view(spark.read.parquet(log), ["alert_id"], "at").select("alert_id", F.col("status").alias("_was"))
    judged = shared_table(judged.join(before, "alert_id", "left"), "resolutions")
    order = Window.partitionBy("alert_id").orderBy("at", "status").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.when(F.col("verdict") == "ok", F.col("status"))
    was = F.coalesce(F.last(taken, ignorenulls=True).over(order), "_was", F.lit("open"))
    lines = judged.withColumn("before", was).withColumn("after", F.coalesce(taken, "before"))
    sinks.append(judged.where("verdict = 'ok'").select("alert_id", "status", "reason", "actor", "at"), log)
    sinks.append(lines.select("alert_id", "actor", "at", "verdict", "before", "after"), audit)


def alert_states(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """alerts with status (open, or the latest decision), reason, actor and at of that decision."""
    latest = sinks.upsert_view(log, ["alert_id"], "at").select(F.col("alert_id").alias("id"), "status", "reason", "actor", "at")
    return alerts.join(latest, "id", "left").withColumn("status", F.coalesce("status", F.lit("open")))
