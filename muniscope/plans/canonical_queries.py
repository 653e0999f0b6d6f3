"""Queries on scanning, normalising, merging, validating and tracing records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts, letters, scores, text
from ..operators import canonical, graph, quality
from ..sources import views
from .registry import query

_FY = "(year({0}) - CASE WHEN month({0}) < 4 THEN 1 ELSE 0 END)"


@query("SELECT o_orderkey AS id, o_totalprice AS amount, o_orderpriority AS activity FROM orders WHERE o_totalprice > 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate IS NOT NULL")
def scan_project_filter(spark, sf):
    """A pruned scan with pushed predicates."""
    o = views.load(spark, sf, "orders")
    o = o.where((F.col("o_totalprice") > 300000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).na.drop(subset=["o_orderdate"])
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("activity"))


@query("SELECT count(*) AS n FROM lineitem")
def metadata_row_count(spark, sf):
    """A count the footers answer."""
    return views.load(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT r_name AS state, n_name AS constituency FROM nation JOIN region ON n_regionkey = r_regionkey")
def distinct_states(spark, sf):
    """Distinct pairs of a jurisdiction."""
    n = views.load(spark, sf, "nation").join(views.load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("r_name").alias("state"), F.col("n_name").alias("constituency")).distinct()


#: How an order's price is written, by its key: a bare number, lakhs, crores, grouped digits, two units, words.
_STYLES = 6


@query(f"""WITH o AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey % {_STYLES} AS s FROM orders)
SELECT id, CASE WHEN s = 4 THEN 'ambiguous_unit' WHEN s = 5 THEN 'unparseable' ELSE 'ok' END AS status,
  CASE s WHEN 0 THEN CAST(v AS DOUBLE) WHEN 1 THEN v * 100000.0 WHEN 2 THEN v * 10000000.0 WHEN 3 THEN CAST(v AS DOUBLE) END AS amount,
  CASE s WHEN 1 THEN 'lakh' WHEN 2 THEN 'cr' WHEN 4 THEN 'crore,lakh' END AS unit FROM o""")
def amount_normalize_cases(spark, sf):
    """Text written in six ways is read back exactly."""
    v = F.floor("o_totalprice").cast("long")
    digits = v.cast("string")
    head = F.reverse(F.regexp_replace(F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 3)), r"(\d{2})(?=\d)", "$1,"))
    grouped = F.when(F.length(digits) > 3, F.concat(head, F.lit(","), F.substring(digits, -3, 3))).otherwise(digits)
    s = F.col("o_orderkey") % _STYLES
    written = (
        F.when(s == 0, F.concat(digits, F.lit("/-"))).when(s == 1, F.concat(F.lit("Rs. "), digits, F.lit(" Lakh")))
        .when(s == 2, F.concat(F.lit("₹"), digits, F.lit("Cr"))).when(s == 3, grouped)
        .when(s == 4, F.concat(digits, F.lit(" lakh crore"))).otherwise(F.lit("N/A"))
    )
    o = views.load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), amounts.normalise_amount(written).alias("a"))
    return o.select("id", "a.status", F.col("a.amount").cast("double").alias("amount"), "a.unit")


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, {_FY.format('o_orderdate')} AS fy FROM orders)
SELECT id, CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE c END AS INTEGER) AS mp_code, CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE fy END AS INTEGER) AS fy_start_year,
  CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE fy + 1 END AS INTEGER) AS fy_end_year, CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS INTEGER) AS letter_seq FROM o""")
def letter_no_parse(spark, sf):
    """Letter numbers with white space inside, one in seven not in the format."""
    fy = letters.fiscal_year(F.col("o_orderdate"))
    k = F.col("o_orderkey")
    good = F.concat(F.lit(" LN/MP"), "o_custkey", F.lit("/\t"), fy, F.lit("-"), fy + 1, F.lit(" /"), k)
    letter = F.when(k % 7 == 0, F.concat(F.lit("REF-LN/MP"), "o_custkey")).otherwise(good)
    return views.load(spark, sf, "orders").select(k.alias("id"), letters.parse_letter(letter).alias("p")).select("id", "p.*")


@query(f"""WITH d AS (SELECT event_id AS id, CAST(ts AS DATE) AS d FROM events)
SELECT id, {_FY.format('d')} AS fy, make_date({_FY.format('d')}, 4, 1) AS first, make_date({_FY.format('d')} + 1, 3, 31) AS close,
  date_diff('day', d, make_date({_FY.format('d')} + 1, 3, 31)) AS days_left FROM d""")
def fiscal_year_features(spark, sf):
    """Bounds of the fiscal year and days to its end."""
    d = F.to_date("ts")
    fy = letters.fiscal_year(d)
    return views.load(spark, sf, "events").select(
        F.col("event_id").alias("id"), fy.cast("long").alias("fy"), letters.fiscal_bounds(fy).first.alias("first"),
        letters.fiscal_close(d).alias("close"), letters.days_to_close(d).cast("long").alias("days_left"),
    )


@query(r"""SELECT p_partkey AS id, upper(regexp_replace('  ' || p_name || chr(9), '^\s+|\s+$', '', 'g')) AS upper_norm,
  regexp_replace(lower(regexp_replace(p_name || '   x ', '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS description,
  p_type AS activity, p_brand || ' | ' || p_type AS key, 'record:' || p_partkey AS work FROM part""")
def text_normalize(spark, sf):
    """Normal forms of names, descriptions, activities and keys."""
    padded = F.concat(F.lit("  "), "p_name", F.lit("\t"))
    activity = F.concat(F.lit("WS/MP"), "p_partkey", F.lit("/2023-2024/7- "), "p_type")
    return views.load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), text.upper_norm(padded).alias("upper_norm"),
        text.description_norm(F.concat("p_name", F.lit("   x "))).alias("description"),
        text.activity_norm(activity).alias("activity"), text.composite_key(F.col("p_brand"), F.col("p_type")).alias("key"),
        text.work_key(F.lit("  "), F.col("p_partkey")).alias("work"),
    )


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'odisha' WHEN 1 THEN NULL WHEN 2 THEN 'delhi' ELSE lower(n_name) END AS place FROM nation""")
def jurisdiction_normalize(spark, sf):
    """Aliases, blanks and case of place names."""
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, " Orissa ").when(k == 1, "   ").when(k == 2, "NCT of Delhi").otherwise(F.col("n_name"))
    return views.load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), text.jurisdiction(raw).alias("place"))


@query(f"""WITH {views.SANCTIONED_SQL}, {views.COMPLETED_SQL}
SELECT coalesce(c.record_id, s.record_id) AS record_id, c.record_id IS NOT NULL AS has_first, s.record_id IS NOT NULL AS has_second,
  coalesce(actual_amount, sanction_amount) AS amount, coalesce(end_date, sanction_date) AS day, stage, image_count
FROM completed c FULL JOIN sanctioned s ON c.record_id = s.record_id""")
def canonical_outer_merge(spark, sf):
    """Full outer merge, the completed record first."""
    c = views.completed(spark, sf).withColumnsRenamed({"actual_amount": "amount", "end_date": "day"})
    s = views.sanctioned(spark, sf).withColumnsRenamed({"sanction_amount": "amount", "sanction_date": "day"})
    return canonical.outer_merge(c, s, "record_id").select("record_id", "has_first", "has_second", "amount", "day", "stage", "image_count")


@query(f"""WITH {views.SANCTIONED_SQL}, {views.COMPLETED_SQL}
SELECT has_first, has_second, count(*) AS n FROM (SELECT c.record_id IS NOT NULL AS has_first, s.record_id IS NOT NULL AS has_second
  FROM completed c FULL JOIN sanctioned s ON c.record_id = s.record_id) GROUP BY 1, 2""")
def membership_flags(spark, sf):
    """Where records come from."""
    m = canonical.outer_merge(views.completed(spark, sf), views.sanctioned(spark, sf), "record_id")
    return m.groupBy("has_first", "has_second").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {views.WORKS_SQL} SELECT record_id,
  CASE WHEN stage = 'F' THEN date_diff('day', sanction_date, end_date) ELSE date_diff('day', make_date({_FY.format('sanction_date')}, 4, 1), end_date) END AS duration_days,
  CASE WHEN stage = 'F' THEN 'real_sanction_date' ELSE 'fiscal_year_proxy' END AS basis FROM works""")
def duration_basis(spark, sf):
    """A proxy date where the real one is not trusted."""
    real = F.col("stage") == "F"
    start = F.when(real, F.col("sanction_date")).otherwise(letters.fiscal_bounds(letters.fiscal_year(F.col("sanction_date"))).first)
    return views.works(spark, sf).select(
        "record_id", F.datediff("end_date", start).cast("long").alias("duration_days"),
        F.when(real, "real_sanction_date").otherwise("fiscal_year_proxy").alias("basis"),
    )


@query(f"""WITH {views.SANCTIONED_SQL}, {views.COMPLETED_SQL}, m AS (
  SELECT coalesce(c.record_id, s.record_id) AS record_id, c.record_id IS NULL AS e1, end_date < sanction_date AS e2, stage <> 'F' AND c.record_id IS NOT NULL AS e3
  FROM completed c FULL JOIN sanctioned s ON c.record_id = s.record_id)
SELECT record_id, array_to_string(list_filter([CASE WHEN e1 THEN 'attachment_missing' END, CASE WHEN e2 THEN 'completion_before_sanction' END,
  CASE WHEN e3 THEN 'source_stage_disagreement' END], lambda x: x IS NOT NULL), ',') AS issues,
  CASE WHEN coalesce(e1, false) OR coalesce(e2, false) OR coalesce(e3, false) THEN 'review' ELSE 'ok' END AS status FROM m""")
def validation_issue_array(spark, sf):
    """Sorted lists of broken checks."""
    m = canonical.outer_merge(views.completed(spark, sf), views.sanctioned(spark, sf), "record_id")
    issues = canonical.issue_list({
        "attachment_missing": ~F.col("has_first"),
        "completion_before_sanction": F.col("end_date") < F.col("sanction_date"),
        "source_stage_disagreement": (F.col("stage") != "F") & F.col("has_first"),
    })
    m = m.withColumn("i", issues)
    return m.select("record_id", F.array_join("i", ",").alias("issues"), F.when(F.size("i") > 0, "review").otherwise("ok").alias("status"))


def _canonical(spark, sf):
    """Orders and their items under the names the quality rules use."""
    m = canonical.outer_merge(views.completed(spark, sf), views.sanctioned(spark, sf), "record_id")
    m = m.join(views.places(spark, sf), "mp_id", "left")
    none = F.lit(None).cast("string")
    return m.select(
        "record_id", F.when(F.col("has_first"), F.col("record_id")).alias("work_id"), "has_first", "has_second",
        F.col("activity").alias("work_description"), "mp_name", F.col("state").alias("state_name"), "constituency",
        F.col("activity").alias("work_category"), "actual_amount", F.when(F.col("has_first"), F.lit("ok")).otherwise("missing").alias("actual_amount_status"),
        F.col("actual_amount").cast("decimal(20,2)").cast("string").alias("actual_amount_raw"), "sanction_amount", F.lit("ok").alias("sanction_amount_status"),
        none.alias("sanction_amount_raw"), F.col("end_date").alias("actual_end_date"), F.col("end_date").cast("string").alias("actual_end_date_raw"),
        "sanction_date", F.col("sanction_date").cast("string").alias("sanction_date_raw"),
        F.col("sanction_date").alias("recommendation_date"), F.col("sanction_date").cast("string").alias("recommendation_date_raw"),
        F.array(F.lit("none")).alias("issues"), none.alias("attachment_filenames"),
        F.when(F.col("stage") == "F", "Work Completed").otherwise("Sanction").alias("sanctioned_work_stage"),
    )


_ALERTS_SQL = f"""{views.SANCTIONED_SQL}, {views.COMPLETED_SQL}, m AS (
  SELECT s.record_id, CASE WHEN c.record_id IS NOT NULL THEN s.record_id ELSE 'record:' || s.record_id END AS work, c.record_id IS NOT NULL AS done,
    end_date, sanction_date, stage, activity FROM sanctioned s LEFT JOIN completed c USING (record_id)),
a AS (
  SELECT work, 'date_sequence_invalid' AS code, 'critical' AS severity, 'actual_end_date' AS field, end_date || ' before ' || sanction_date AS raw FROM m WHERE end_date < sanction_date
  UNION ALL SELECT work, 'sanctioned_stage_incomplete', 'info', 'work_stage', 'Sanction' FROM m WHERE done AND stage <> 'F'
  UNION ALL SELECT work, 'category_unknown', 'info', 'work_category', activity FROM m WHERE activity = '5-LOW'
), alerts AS (SELECT substr(sha1(work || chr(31) || code || chr(31) || field || chr(31) || substr(sha1(raw), 1, 8)), 1, 16) AS id, * FROM a)"""
_KNOWN = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query(f"WITH {_ALERTS_SQL} SELECT id, work AS work_id, code AS quality_code, severity, field, raw AS raw_value, code || '|' || field AS group_key FROM alerts")
def quality_alerts(spark, sf):
    """One row per broken quality rule with a stable id."""
    found = quality.alerts(_canonical(spark, sf), quality.standard_rules(_KNOWN))
    return found.select("id", "work_id", "quality_code", "severity", "field", "raw_value", "group_key")


@query(f"""WITH {_ALERTS_SQL}, r AS (SELECT severity, substr(id, 1, 1) AS c FROM alerts),
v AS (SELECT severity, CASE WHEN c <= '3' THEN 'accepted' WHEN c <= '7' THEN 'resolved' ELSE 'open' END AS status, CASE WHEN c <= '3' THEN 2 WHEN c <= '7' THEN 1 ELSE 0 END AS taken,
  CASE WHEN c IN ('8', '9') THEN 1 ELSE 0 END AS forbidden, CASE WHEN c = 'a' THEN 1 ELSE 0 END AS unknown, CASE WHEN c <= '3' THEN 1 ELSE 0 END AS changed FROM r)
SELECT severity, status, count(*) AS alerts, CAST(sum(taken) AS BIGINT) AS taken, CAST(sum(forbidden) AS BIGINT) AS forbidden, CAST(sum(unknown) AS BIGINT) AS unknown, CAST(sum(changed) AS BIGINT) AS changed FROM v GROUP BY ALL""")
def alert_resolutions(spark, sf):
    """2.15 POST /quality/alerts/resolve: alerts settled in two rounds, with an audit line for every request, taken or not."""
    found = quality.alerts(_canonical(spark, sf), quality.standard_rules(_KNOWN))
    alerts = graph.shared_table(found.select("id", "severity"), "alerts")
    log, audit = graph.shared_folder(spark, "resolutions"), graph.shared_folder(spark, "resolution-audit")
    first = F.substring("id", 1, 1)

    def ask(status, at, scope=True, name="id"):
        return [F.expr(name).alias("alert_id"), F.lit(status).alias("status"), F.lit("seen").alias("reason"), F.lit("reviewer").alias("actor"), F.lit(scope).alias("in_scope"), F.lit(at).alias("at")]

    one = alerts.where(first <= "7").select(*ask("resolved", 1)).union(alerts.where(first.isin("8", "9")).select(*ask("resolved", 1, False)))
    one = one.union(alerts.where(first == "a").select(*ask("resolved", 1, True, "concat('x', id)")))
    quality.resolve_alerts(alerts, one, log, audit)
    quality.resolve_alerts(alerts, alerts.where(first <= "3").select(*ask("accepted", 2)), log, audit)
    lines = spark.read.parquet(audit).withColumn("id", F.regexp_replace("alert_id", "^x", ""))
    count = lambda c, name: F.count_if(c).alias(name)
    per = lines.groupBy("id").agg(
        count(F.col("verdict") == "ok", "taken"), count(F.col("verdict") == "forbidden", "forbidden"), count(F.col("verdict") == "not_found", "unknown"),
        count((F.col("before") == "resolved") & (F.col("after") == "accepted"), "changed"),
    )
    states = quality.alert_states(alerts, spark.read.parquet(log)).join(per, "id", "left").na.fill(0)
    return states.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("alerts"), *(F.sum(c).alias(c) for c in ("taken", "forbidden", "unknown", "changed")))


@query(f"WITH {_ALERTS_SQL} SELECT code || '|' || field AS group_key, count(*) AS alerts, count(*) AS open, min(id) AS sample FROM alerts GROUP BY 1")
def quality_alert_groups(spark, sf):
    """Alerts by root cause."""
    return quality.alert_groups(quality.alerts(_canonical(spark, sf), quality.standard_rules(_KNOWN)))


@query("""SELECT CAST(l_suppkey AS VARCHAR) || '-' || l_partkey AS work_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(l_orderkey AS VARCHAR))), ',') AS records
FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1""")
def duplicate_work_ids(spark, sf):
    """Ids on more than one record."""
    l = views.load(spark, sf, "lineitem").select(F.concat_ws("-", "l_suppkey", "l_partkey").alias("work_id"), "l_orderkey")
    return quality.duplicated(l, "work_id", "l_orderkey").withColumn("records", F.array_join("records", ","))


@query("""SELECT o_orderkey AS id, substr(sha1(o_orderkey || chr(31) || 'amount_zero' || chr(31) || 'amount' || chr(31) || substr(sha1(o_orderstatus), 1, 8)), 1, 16) AS alert,
  substr(sha1(least(o_orderpriority, o_orderstatus) || chr(31) || greatest(o_orderpriority, o_orderstatus) || chr(31) || 'v1'), 1, 16) AS match, md5(o_orderpriority) AS md5, sha256(o_orderpriority) AS sha256 FROM orders""")
def stable_ids_sha1(spark, sf):
    """Ids that survive a rerun, and content hashes."""
    o = views.load(spark, sf, "orders")
    a, b = F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"), text.alert_id(F.col("o_orderkey"), F.lit("amount_zero"), F.lit("amount"), b).alias("alert"),
        text.match_id(a, b, "v1").alias("match"), F.md5(a).alias("md5"), F.sha2(a, 256).alias("sha256"),
    )


@query(f"""WITH {views.WORKS_SQL} SELECT record_id AS work, f.field AS raw_field, f.value AS normalised_value FROM works,
  LATERAL (VALUES ('amount', CAST(CAST(actual_amount AS DECIMAL(20, 2)) AS VARCHAR)), ('end_date', CAST(end_date AS VARCHAR)), ('sanction_date', CAST(sanction_date AS VARCHAR))) AS f(field, value)""")
def lineage_unpivot(spark, sf):
    """Which raw field a value came from, long form."""
    w = views.works(spark, sf).withColumn("work_id", F.col("record_id")).withColumn("amount", F.col("actual_amount").cast("decimal(20,2)"))
    fields = {"amount": ("amount", "amount", "decimal"), "end_date": ("end_date", "end_date", "date"), "sanction_date": ("sanction_date", "sanction_date", "date")}
    return canonical.lineage(w, fields, "lineitem", "v1").select("work", "raw_field", "normalised_value")


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice > 400000 THEN '>0.2' WHEN o_totalprice > 100000 THEN '0.05-0.2' ELSE '<0.05' END AS area,
  CASE WHEN o_custkey % 10 = 0 THEN '0' WHEN o_custkey % 10 <= 3 THEN '1-3' ELSE '4-6' END AS distance, greatest(1, CAST(round(o_custkey * 0.1) AS INTEGER)) AS rows FROM orders""")
def evidence_buckets(spark, sf):
    """Buckets of distances and areas, stamp bands."""
    o = views.load(spark, sf, "orders")
    area = F.when(F.col("o_totalprice") > 400000, 0.3).when(F.col("o_totalprice") > 100000, 0.1).otherwise(0.01)
    return o.select(
        F.col("o_orderkey").alias("id"), scores.area_bucket(area).alias("area"), scores.distance_bucket(F.col("o_custkey") % 10).alias("distance"),
        scores.watermark_rows(F.col("o_custkey")).alias("rows"),
    )


@query("""WITH c AS (SELECT c_custkey AS id, (c_custkey % 160) - 80.0 AS lat, (c_custkey % 359) - 179.0 AS lon FROM customer)
SELECT id, CAST(floor((lon + 180.0) / 360.0 * 4096) AS BIGINT) AS x,
  CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096) AS BIGINT) AS y FROM c""")
def slippy_tiles(spark, sf):
    """Tile numbers of coordinates."""
    k = F.col("c_custkey")
    t = scores.slippy_tile((k % 160 - 80).cast("double"), (k % 359 - 179).cast("double"), 12)
    return views.load(spark, sf, "customer").select(k.alias("id"), t.alias("t")).select("id", "t.x", "t.y")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT r_regionkey AS id, r_name AS name FROM region")
def union_by_name(spark, sf):
    """Union of frames with different columns."""
    n = views.load(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    r = views.load(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id"))
    return n.unionByName(r, allowMissingColumns=True)


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'both' AS op, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'subset', CAST(NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM b) AS INTEGER)""")
def set_ops(spark, sf):
    """Difference, intersection, subset test."""
    a = views.load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).distinct()
    b = views.load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    left = a.join(b, "k", "left_anti")
    subset = left.agg((F.count(F.lit(1)) == 0).cast("int").alias("k")).select(F.lit("subset").alias("op"), "k")
    return a.intersect(b).select(F.lit("both").alias("op"), "k").union(left.select(F.lit("left").alias("op"), "k")).union(subset)
