"""Queries of the review queues, logs, profiles and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import letters
from ..operators import forest, graph, profile, quantiles, sampling, serving
from ..sources import views
from .registry import query

_DECIDED = """dec AS (SELECT user_id, count(*) AS n, bool_or(event_type = 'purchase') AS confirmed FROM events GROUP BY user_id)"""


@query(f"""WITH {views.WORKS_SQL} SELECT record_id, state, round(actual_amount, 2) AS amount FROM works WHERE lower(state) = 'asia' AND actual_amount > 100000
ORDER BY actual_amount DESC, record_id DESC LIMIT 50 OFFSET 50""")
def work_queue_page(spark, sf):
    """One jurisdiction's works, the second page."""
    w = views.works(spark, sf).where(serving.in_scope({"state": [" Asia "]}) & (F.col("actual_amount") > 100000))
    p = serving.page(w, [F.desc(F.coalesce("actual_amount", F.lit(0.0))), F.desc("record_id")], 50, 50)
    return p.select("record_id", "state", F.round("actual_amount", 2).alias("amount"))


@query(f"""WITH {views.WORKS_SQL}, {_DECIDED} SELECT CASE WHEN confirmed THEN 'confirmed' WHEN user_id IS NOT NULL THEN 'seen' ELSE 'open' END AS status, count(*) AS n
FROM works LEFT JOIN dec ON mp_id = user_id GROUP BY 1""")
def status_counts(spark, sf):
    """Decisions over works, the higher role's first."""
    d = views.load(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("confirmed"))
    w = views.works(spark, sf).join(d, F.col("mp_id") == F.col("user_id"), "left")
    status = F.when(F.col("confirmed"), "confirmed").when(F.col("user_id").isNotNull(), "seen").otherwise("open")
    return w.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {views.WORKS_SQL} SELECT record_id FROM works WHERE contains(lower(concat_ws(' ', mp_name, constituency, activity)), 'nation_3 1-ur')")
def search_q(spark, sf):
    """substring search over joined fields."""
    return views.works(spark, sf).where(serving.search(["mp_name", "constituency", "activity"], "Nation_3 1-UR")).select("record_id")


@query("""SELECT c_custkey AS id, 'in' AS side FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
UNION ALL SELECT c_custkey, 'out' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""")
def scope_semi_anti(spark, sf):
    """Rows inside and outside a scope by semi and anti join."""
    n = views.load(spark, sf, "nation").join(views.load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'EUROPE'").select(F.col("n_nationkey").alias("c_nationkey"))
    c = views.load(spark, sf, "customer")
    inside = c.join(n, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("id"), F.lit("in").alias("side"))
    return inside.union(c.join(n, "c_nationkey", "left_anti").select("c_custkey", F.lit("out")))


@query("""SELECT l_orderkey AS id, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE s_nationkey IN (1, 2, 3, 7) AND c_nationkey IN (1, 2, 3, 7) GROUP BY l_orderkey""")
def both_sides_scope(spark, sf):
    """a link counts only if both its ends are in scope."""
    nations = [1, 2, 3, 7]
    s = views.load(spark, sf, "supplier").where(F.col("s_nationkey").isin(nations)).select(F.col("s_suppkey").alias("l_suppkey"))
    c = views.load(spark, sf, "customer").where(F.col("c_nationkey").isin(nations)).select(F.col("c_custkey").alias("o_custkey"))
    o = views.load(spark, sf, "orders").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    l = views.load(spark, sf, "lineitem").join(s, "l_suppkey", "left_semi").join(o, "l_orderkey")
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {views.WORKS_SQL}, b AS (SELECT mp_id, record_id AS other, row_number() OVER (PARTITION BY mp_id ORDER BY actual_amount DESC, record_id) AS r FROM works),
m AS (SELECT w.record_id, b.other, row_number() OVER (PARTITION BY w.record_id ORDER BY r) AS rank FROM works w JOIN b USING (mp_id) WHERE w.record_id <> b.other)
SELECT record_id, rank, other FROM m WHERE rank <= 5""")
def related_entities_top5(spark, sf):
    """The five largest other works of the same official."""
    w = views.works(spark, sf)
    return serving.related(w, "mp_id", "record_id", "actual_amount").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {views.WORKS_SQL}, n AS (SELECT * FROM works WHERE CAST(record_id AS BIGINT) % 50 = 1),
a AS (SELECT CAST(user_id * 50 + 1 AS VARCHAR) AS record_id, event_id, ts, event_type FROM events), h AS (SELECT record_id, count(*) AS actions, arg_max(event_type, {{'t': ts, 'e': event_id}}) AS status FROM a GROUP BY 1),
b AS (SELECT mp_id, record_id AS other, row_number() OVER (PARTITION BY mp_id ORDER BY actual_amount DESC, record_id) AS r FROM works),
o AS (SELECT n.record_id, b.other, row_number() OVER (PARTITION BY n.record_id ORDER BY r) AS k FROM n JOIN b USING (mp_id) WHERE n.record_id <> b.other), l AS (SELECT record_id, string_agg(other, ',' ORDER BY k) AS related FROM o WHERE k <= 5 GROUP BY 1)
SELECT record_id, constituency, actual_amount, coalesce(actions, 0) AS actions, coalesce(status, 'Flagged') AS status, coalesce(related, '') AS related FROM n LEFT JOIN h USING (record_id) LEFT JOIN l USING (record_id)""")
def work_details(spark, sf):
    """2.15 /works/{id}: works with their history of actions, status and related works; every fiftieth record asked for."""
    w = views.works(spark, sf).select("record_id", "mp_id", "constituency", "actual_amount")
    asked = w.where(F.col("record_id").cast("long") % 50 == 1).select("record_id")
    e = views.load(spark, sf, "events")
    actions = e.select((F.col("user_id") * 50 + 1).cast("string").alias("record_id"), F.col("ts").alias("at"), F.col("event_id").alias("actor"), F.col("event_type").alias("decision"))
    d = serving.work_detail(asked, w, actions, "mp_id", "record_id", "actual_amount")
    return d.select("record_id", "constituency", "actual_amount", F.size("history").cast("long").alias("actions"), "status", F.array_join("related", ",").alias("related"))


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS k, count(*) OVER (PARTITION BY user_id) AS reviews FROM events)
SELECT user_id, event_type, value, reviews FROM r WHERE k = 1""")
def latest_review_action(spark, sf):
    """The latest state of an append-only log."""
    return serving.latest(views.load(spark, sf, "events"), ["user_id"], "ts", "event_type", "value")


@query("""WITH f AS (SELECT user_id, min(ts) AS first, min(ts) FILTER (event_type = 'purchase') AS done FROM events GROUP BY user_id)
SELECT count(*) AS users, count(done) AS resolved, round(median(epoch(done - first) / 3600.0), 4) AS hours FROM f""")
def first_review_hours(spark, sf):
    """Median hours from the first event to the first terminal one."""
    done = F.min(F.when(F.col("event_type") == "purchase", F.col("ts")))
    f = views.load(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first"), done.alias("done"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = (micros("done") - micros("first")) / 3_600_000_000.0
    f = graph.shared_table(f.withColumn("h", hours), "first-review")  # read twice
    middle = quantiles.grouped_medians(f, "h", [], "m")
    return f.agg(F.count(F.lit(1)).alias("users"), F.count("done").alias("resolved")).select("users", "resolved", F.round(middle.scalar(), 4).alias("hours"))


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events), d AS (SELECT user_id, avg(value) > 50 AS dismissed FROM events GROUP BY user_id)
SELECT event_type, count(*) AS users, round(avg(CASE WHEN dismissed THEN 1.0 ELSE 0.0 END), 6) AS dismissal_rate FROM e JOIN d USING (user_id) GROUP BY event_type""")
def dismissal_rate(spark, sf):
    """An outcome's rate by signal."""
    e = views.load(spark, sf, "events")
    d = e.groupBy("user_id").agg((F.avg("value") > 50).alias("dismissed"), F.collect_set("event_type").alias("codes"))
    return d.select("dismissed", F.explode("codes").alias("event_type")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("users"), F.round(F.avg(F.col("dismissed").cast("double")), 6).alias("dismissal_rate")
    )


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER w > INTERVAL 4 HOUR, true) THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e),
h AS (SELECT user_id, s, epoch(max(ts) - min(ts)) / 3600.0 AS hours FROM s GROUP BY user_id, s) SELECT user_id, count(*) AS sessions, round(sum(hours), 4) AS hours FROM h GROUP BY user_id""")
def session_hours(spark, sf):
    """Sessions by gaps of four hours and their total length."""
    w = Window.partitionBy("user_id").orderBy("us")
    e = views.load(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("fresh", F.coalesce(F.col("us") - F.lag("us").over(w) > 4 * 3_600_000_000, F.lit(True)).cast("int"))
    s = e.withColumn("s", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "s").agg(((F.max("us") - F.min("us")) / 3_600_000_000.0).alias("h"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.sum("h"), 4).alias("hours"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS attempts FROM e""")
def rate_limit_sliding_300s(spark, sf):
    """Attempts in the last 300 seconds."""
    return serving.attempts_within(views.load(spark, sf, "events"), "user_id", "ts").select("event_id", "attempts")


@query("""SELECT event_id, event_type, json_extract_string(props, '$.' || 'k') AS k FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 100""")
def audit_page(spark, sf):
    """A filtered log, newest first, with a JSON field."""
    e = views.load(spark, sf, "events").where("event_type = 'click'")
    return serving.page(e, [F.desc("ts"), F.desc("event_id")], 100, 100).select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query(f"""WITH {views.WORKS_SQL} SELECT count(*) AS works, count(DISTINCT state) AS states, count(DISTINCT state || '|' || constituency) AS places, round(sum(actual_amount), 2) AS total,
  count(*) FILTER (image_count = 1) AS flagged, round(count(*) FILTER (image_count = 1) / count(*), 6) AS flag_rate FROM works""")
def kpi_summary(spark, sf):
    """Headline figures."""
    one = F.count_if(F.col("image_count") == 1)
    return views.works(spark, sf).agg(
        F.count(F.lit(1)).alias("works"), F.count_distinct("state").alias("states"), F.count_distinct("state", "constituency").alias("places"),
        F.round(F.sum("actual_amount"), 2).alias("total"), one.alias("flagged"), F.round(one / F.count(F.lit(1)), 6).alias("flag_rate"),
    )


@query(f"""WITH {views.WORKS_SQL}, a AS (SELECT 'mp_office' AS role, mp_name AS name, count(*) AS n FROM works GROUP BY mp_name ORDER BY n DESC, name LIMIT 1),
b AS (SELECT 'state_nodal' AS role, state AS name, count(*) AS n FROM works GROUP BY state ORDER BY n DESC, name LIMIT 1),
c AS (SELECT 'district_authority' AS role, constituency AS name, count(*) AS n FROM works GROUP BY constituency ORDER BY n DESC, name LIMIT 3)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def personas(spark, sf):
    """The busiest official, state and constituencies."""
    w = views.works(spark, sf)

    def busiest(role, column, k):
        n = w.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        return n.orderBy(F.desc("n"), "name").limit(k).select(F.lit(role).alias("role"), "name", "n")

    return busiest("mp_office", "mp_name", 1).union(busiest("state_nodal", "state", 1)).union(busiest("district_authority", "constituency", 3))


@query(f"""WITH {views.WORKS_SQL} SELECT activity, count(*) AS n, round(avg(actual_amount), 3) AS mean, round(stddev_samp(actual_amount), 3) AS std, min(actual_amount) AS least, max(actual_amount) AS most,
  round(quantile_cont(actual_amount, 0.05), 3) AS p5, round(quantile_cont(actual_amount, 0.5), 3) AS p50, round(quantile_cont(actual_amount, 0.95), 3) AS p95 FROM works GROUP BY activity""")
def describe_percentiles(spark, sf):
    """A distribution's moments and exact percentiles."""
    d = profile.describe(views.works(spark, sf), "actual_amount", "activity")
    return d.select("activity", "n", *(F.round(c, 3).alias(c) for c in ("mean", "std")), "least", "most", *(F.round(c, 3).alias(c) for c in ("p5", "p50", "p95")))


@query("""SELECT 'c_name' AS "column", count(*) FILTER (c_name IS NULL) AS nulls, CAST(0 AS DOUBLE) AS null_rate, count(DISTINCT c_name) AS "distinct" FROM customer
UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey IS NULL), CAST(0 AS DOUBLE), count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL), CAST(0 AS DOUBLE), count(DISTINCT c_mktsegment) FROM customer""")
def column_profile(spark, sf):
    """Nulls and distinct values of columns in one pass."""
    return profile.column_profile(views.load(spark, sf, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query("""WITH v AS (SELECT 'event_type' AS "column", CASE WHEN value > 90 THEN NULL ELSE event_type END AS value FROM events UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events),
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS k FROM c)
SELECT "column", value, n FROM r WHERE k <= 10""")
def value_counts_null_bucket(spark, sf):
    """Most frequent values with null as one of them."""
    e = views.load(spark, sf, "events").select(F.when(F.col("value") <= 90, F.col("event_type")).alias("event_type"), F.col("user_id").alias("user"))
    return profile.top_values(e, ["event_type", "user"])


@query("""WITH d AS (SELECT n_chars, lang FROM documents) SELECT count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median,
  count(*) FILTER (lang = 'en') AS en, count(*) FILTER (n_chars >= 150) AS large FROM d""")
def image_inventory_like(spark, sf):
    """An inventory with the upper median and a size gate."""
    d = views.load(spark, sf, "documents").select("n_chars", "lang")
    middle = quantiles.upper_median(d, "n_chars", "m")
    one = d.agg(
        F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"),
        F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("n_chars") >= 150).alias("large"),
    )
    return one.withColumn("upper_median", middle.scalar().cast("long"))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '31-Feb-2024' WHEN o_orderkey % 9 = 1 THEN '' ELSE strftime(o_orderdate, '%d-%b-%Y') END AS d, CAST(o_orderdate AS DATE) AS t FROM orders)
SELECT count(*) AS rows, count(*) FILTER (k % 9 = 1) AS blank, count(*) FILTER (k % 9 = 0) AS failed, round(count(*) FILTER (k % 9 = 0) / count(*) FILTER (k % 9 <> 1), 6) AS failure_rate,
  min(t) FILTER (k % 9 > 1) AS first, max(t) FILTER (k % 9 > 1) AS last FROM o""")
def date_parse_failures(spark, sf):
    """Dates that do not parse, an impossible day among them."""
    k = F.col("o_orderkey") % 9
    text = F.when(k == 0, "31-Feb-2024").when(k == 1, "").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    d = profile.date_failures(views.load(spark, sf, "orders").select(text.alias("d")), "d", "dd-MMM-yyyy")
    return d.withColumn("failure_rate", F.round("failure_rate", 6))


@query("""WITH d AS (SELECT l_suppkey AS agency, CAST(substr(regexp_replace(printf('%.6e', l_extendedprice), '^[^1-9]*', ''), 1, 1) AS INTEGER) AS d FROM lineitem),
c AS (SELECT agency, d, count(*) AS c FROM d GROUP BY 1, 2), n AS (SELECT agency, sum(c) AS n FROM c GROUP BY 1 HAVING sum(c) >= 30),
g AS (SELECT agency, n, k, n * log10(1 + 1.0 / k) AS e FROM n, range(1, 10) r(k))
SELECT agency, CAST(any_value(n) AS BIGINT) AS n, round(sum((coalesce(c, 0) - e) * (coalesce(c, 0) - e) / e), 4) AS chi_square FROM g LEFT JOIN c ON g.agency = c.agency AND g.k = c.d GROUP BY agency""".replace("SELECT agency, CAST", "SELECT g.agency, CAST").replace("GROUP BY agency\"", "GROUP BY g.agency").replace("c.d GROUP BY agency", "c.d GROUP BY g.agency"))
def benford_chi_square(spark, sf):
    """Leading digits of an agency's amounts against Benford's law."""
    l = views.load(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "agency")
    return profile.first_digits(l, "l_extendedprice", "agency").withColumn("chi_square", F.round("chi_square", 4))


@query("""SELECT l_suppkey AS agency, count(*) AS n, round(count(*) FILTER (month(l_shipdate) = 3) / count(*), 6) AS march_share,
  round(sum(CASE WHEN month(l_shipdate) = 3 THEN l_extendedprice ELSE 0 END), 1) AS march_amount FROM lineitem GROUP BY l_suppkey""")
def fy_end_dumping_share(spark, sf):
    """What an agency spends in the last month of the fiscal year."""
    left = letters.days_to_close(F.to_date("l_shipdate")) <= 30
    return views.load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("agency")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count_if(left) / F.count(F.lit(1)), 6).alias("march_share"),
        F.round(F.sum(F.when(left, F.col("l_extendedprice")).otherwise(0.0)), 1).alias("march_amount"),
    )


@query("""SELECT o_custkey AS mp, count(*) AS n, count(*) FILTER (o_totalprice >= 180000 AND o_totalprice < 200000) AS just_under FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_totalprice >= 180000 AND o_totalprice < 200000) >= 2""")
def structuring_band(spark, sf):
    """Officials with several amounts just under a limit."""
    under = F.count_if((F.col("o_totalprice") >= 180000) & (F.col("o_totalprice") < 200000))
    return views.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("mp")).agg(F.count(F.lit(1)).alias("n"), under.alias("just_under")).where("just_under >= 2")


@query("""SELECT o_orderkey AS id, date_diff('day', CAST(o_orderdate AS DATE), CAST(min(l_shipdate) AS DATE)) AS gap FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_orderdate HAVING date_diff('day', CAST(o_orderdate AS DATE), CAST(min(l_shipdate) AS DATE)) BETWEEN 0 AND 7""")
def short_gap(spark, sf):
    """Works finished within a week of their sanction."""
    l = views.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("first"))
    o = views.load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate").join(l, "id")
    return o.select("id", F.datediff(F.to_date("first"), F.to_date("o_orderdate")).cast("long").alias("gap")).where("gap BETWEEN 0 AND 7")


_STATES, _ROLES = list(serving.TRANSITIONS), list(serving.ROLE_TARGETS)
_PICK = lambda names, n: "CASE " + " ".join(f"WHEN ({n}) % {len(names)} = {i} THEN '{s}'" for i, s in enumerate(names)) + " END"
_PAIRS = lambda d: ", ".join(f"('{a}', '{b}')" for a, bs in d.items() for b in bs)
_LIST = lambda names: ", ".join(f"'{x}'" for x in names)


@query(f"""WITH m AS (SELECT event_id AS id, {_PICK(_STATES, "event_id")} AS f, {_PICK(_STATES, "event_id * 5 + user_id")} AS t, {_PICK(_ROLES, "user_id")} AS r, CASE WHEN event_id % 3 > 0 THEN 'because' END AS reason FROM events),
edge AS (SELECT * FROM (VALUES {_PAIRS(serving.TRANSITIONS)}) AS v(f, t)), may AS (SELECT * FROM (VALUES {_PAIRS(serving.ROLE_TARGETS)}) AS v(r, t))
SELECT id, m.f AS from_status, m.t AS to_status, m.r AS role, CASE WHEN edge.f IS NULL THEN 'illegal_transition' WHEN may.r IS NULL THEN 'role_not_allowed'
  WHEN reason IS NULL AND (m.t IN ({_LIST(serving.NEEDS_REASON)}) OR m.f IN ({_LIST(serving.TERMINAL)})) THEN 'reason_required' ELSE 'ok' END AS verdict
FROM m LEFT JOIN edge ON edge.f = m.f AND edge.t = m.t LEFT JOIN may ON may.r = m.r AND may.t = m.t""")
def workflow_transitions(spark, sf):
    """Workflow rules over moves of cases, each judged from the status it names."""
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (n % len(names) + 1).cast("int"))
    k = F.col("event_id")
    moves = views.load(spark, sf, "events").select(
        k.alias("id"), pick(_STATES, k).alias("from_status"), pick(_STATES, k * 5 + F.col("user_id")).alias("to_status"), pick(_ROLES, F.col("user_id")).alias("role"),
        F.when(k % 3 > 0, "because").alias("reason"),
    )
    return serving.check_transitions(moves).drop("reason")


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, lang, source FROM r WHERE k <= 200 // (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents))""")
def stratified_sample(spark, sf):
    """The same number of rows of each stratum."""
    return sampling.stratified(views.load(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang"], "doc_id", 200)


@query()
def isolation_forest_flags(spark, sf):
    """M3, U-3: multivariate outliers of works."""
    w = views.works(spark, sf).select("record_id", "actual_amount", "image_count", F.datediff("end_date", "sanction_date").alias("lag"))
    return forest.isolation_scores(w, "record_id", ["actual_amount", "image_count", "lag"])


@query("""SELECT r_name AS state, n_name AS constituency, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())""")
def grouping_sets_summary(spark, sf):
    """Beyond the reference: counts at three grains at once."""
    p = views.places(spark, sf).join(views.load(spark, sf, "customer").select(F.col("c_custkey").alias("mp_id"), "c_acctbal"), "mp_id")
    return p.groupingSets([[F.col("state"), F.col("constituency")], [F.col("state")], []], F.col("state"), F.col("constituency")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")
    )


@query("""SELECT event_id, max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events""")
def asof_prior_event(spark, sf):
    """Beyond the reference: each event with its user's event before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return views.load(spark, sf, "events").select("event_id", F.lag("ts").over(w).alias("prior"))
