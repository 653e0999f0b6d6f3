"""Queries on peers, pace and delays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import letters, scores
from ..operators import peers
from ..sources import views
from .registry import query

AS_OF = "2001-12-31"
CAP = 5_000_000.0

_ORDER_TOTALS = """t AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY l_orderkey),
w AS (SELECT o_orderkey AS id, o_orderpriority AS activity, n_name AS place, amount
  FROM t JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _amounts(spark, sf):
    w = views.works(spark, sf)
    return w.select(F.col("record_id").cast("long").alias("id"), "activity", F.col("constituency").alias("place"), F.col("actual_amount").alias("amount"))


def ladder_sql(source: str, value: str, category: str, place: str, keep: str) -> str:
    return f"""
, m2 AS (SELECT {category} AS c, {place} AS p, count(*) AS n, median({value}) AS m FROM {source} GROUP BY 1, 2),
d2 AS (SELECT {category} AS c, {place} AS p, median(abs({value} - m)) AS d FROM {source} JOIN m2 ON {category} = c AND {place} = p GROUP BY 1, 2),
m1 AS (SELECT {category} AS c, count(*) AS n, median({value}) AS m FROM {source} GROUP BY 1),
d1 AS (SELECT {category} AS c, median(abs({value} - m)) AS d FROM {source} JOIN m1 ON {category} = c GROUP BY 1),
m0 AS (SELECT count(*) AS n, median({value}) AS m FROM {source}),
d0 AS (SELECT median(abs({value} - m)) AS d FROM {source}, m0),
j AS (
  SELECT s.*, CASE WHEN m2.n >= 10 THEN 'place' WHEN m1.n >= 10 THEN 'category' ELSE 'all' END AS peer_level,
    CASE WHEN m2.n >= 10 THEN m2.n WHEN m1.n >= 10 THEN m1.n ELSE m0.n END AS peer_size,
    CASE WHEN m2.n >= 10 THEN m2.m WHEN m1.n >= 10 THEN m1.m ELSE m0.m END AS med,
    CASE WHEN m2.n >= 10 THEN d2.d WHEN m1.n >= 10 THEN d1.d ELSE d0.d END AS mad
  FROM {source} s JOIN m2 ON s.{category} = m2.c AND s.{place} = m2.p JOIN d2 ON s.{category} = d2.c AND s.{place} = d2.p
    JOIN m1 ON s.{category} = m1.c JOIN d1 ON s.{category} = d1.c, m0, d0
), z AS (
  SELECT *, coalesce(({value} - med) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(abs(med) * 0.1, 1.0) END, 0) AS z FROM j
)
{keep}"""


@query(f"WITH {_ORDER_TOTALS}" + ladder_sql("w", "amount", "activity", "place",
    "SELECT id, peer_level, peer_size, round(z, 4) AS z FROM z"))
def peer_zscore_ladder(spark, sf):
    """Robust z of each work against its peers."""
    z = peers.ladder_z(_amounts(spark, sf), "amount", "activity", "place")
    return z.select("id", "peer_level", "peer_size", F.round("z", 4).alias("z"))


@query(f"WITH {_ORDER_TOTALS}" + ladder_sql("w", "amount", "activity", "place",
    "SELECT id, amount, round(z, 4) AS z, round(least(greatest(z, 0) / 6, 1), 4) AS score FROM z WHERE z > 2.5 ORDER BY z DESC, id LIMIT 50"))
def cost_rule_topk(spark, sf):
    """The 50 works most above their peers, high side only."""
    z = peers.ladder_z(_amounts(spark, sf), "amount", "activity", "place").where(F.col("z") > peers.FLAG_Z)
    return z.orderBy(F.desc("z"), "id").limit(50).select(
        "id", "amount", F.round("z", 4).alias("z"), F.round(scores.cost_score(F.col("z")), 4).alias("score")
    )


@query(f"""WITH {views.SANCTIONED_SQL}, {views.COMPLETED_SQL}, {views.PLACES_SQL},
s AS (SELECT record_id AS id, activity, constituency AS place, date_diff('day', sanction_date, DATE '{AS_OF}') AS days
  FROM sanctioned JOIN places USING (mp_id) WHERE record_id NOT IN (SELECT record_id FROM completed))""" + ladder_sql("s", "days", "activity", "place",
    "SELECT id, days, peer_level, peer_size, round(z, 4) AS z, z > 2.5 AND peer_size >= 10 AS flag FROM z"))
def long_open_work(spark, sf):
    """Sanctioned, never completed, open far longer than peers."""
    done = views.completed(spark, sf).select("record_id")
    open_ = views.sanctioned(spark, sf).join(done, "record_id", "left_anti").join(views.places(spark, sf), "mp_id")
    days = F.datediff(F.lit(AS_OF).cast("date"), "sanction_date").cast("long")
    s = open_.select(F.col("record_id").alias("id"), "activity", F.col("constituency").alias("place"), days.alias("days"))
    z = peers.ladder_z(s, "days", "activity", "place")
    flag = (F.col("z") > peers.FLAG_Z) & (F.col("peer_size") >= peers.MIN_PEERS)
    return z.select("id", "days", "peer_level", "peer_size", F.round("z", 4).alias("z"), flag.alias("flag"))


@query(f"""WITH {views.WORKS_SQL}, m AS (SELECT activity, state, count(*) AS n, median(actual_amount) AS med FROM works GROUP BY 1, 2),
d AS (SELECT activity, state, median(abs(actual_amount - med)) AS mad FROM works JOIN m USING (activity, state) GROUP BY 1, 2)
SELECT activity, state, n, round(med, 4) AS median, round(mad, 4) AS mad,
  round(med + 2.5 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(abs(med) * 0.1, 1) END, 3) AS threshold FROM m JOIN d USING (activity, state)""")
def group_median_mad_threshold(spark, sf):
    """The threshold shown for a group of assigned rows."""
    t = peers.group_threshold(views.works(spark, sf), "actual_amount", "activity", "state")
    return t.select("activity", "state", "n", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), F.round("threshold", 3).alias("threshold"))


@query("""WITH r AS (SELECT event_id, rank() OVER (ORDER BY round(value, 1)) AS r, count(*) OVER (PARTITION BY round(value, 1)) AS t, count(*) OVER () AS n FROM events)
SELECT event_id, round((r + (t - 1) / 2.0) / n, 9) AS pct_rank FROM r""")
def avg_pct_rank(spark, sf):
    """Percentile rank with ties averaged."""
    e = views.load(spark, sf, "events").select("event_id", F.round("value", 1).alias("v"))
    return peers.average_rank(e, "v").select("event_id", F.round("pct_rank", 9).alias("pct_rank"))


@query(f"""WITH {views.WORKS_SQL}, s AS (SELECT activity, avg(actual_amount) AS m, stddev_samp(actual_amount) AS d FROM works GROUP BY activity)
SELECT record_id, round(CASE WHEN d > 0 THEN (actual_amount - m) / d ELSE 0 END, 5) AS z,
  CASE WHEN d > 0 THEN abs((actual_amount - m) / d) > 2.5 ELSE false END AS flag FROM works JOIN s USING (activity)""")
def mean_std_z_two_sided(spark, sf):
    """A3: two-sided z against mean and sample deviation."""
    z = peers.mean_std_z(views.works(spark, sf), "actual_amount", "activity")
    return z.select("record_id", F.round("z", 5).alias("z"), (F.abs("z") > peers.FLAG_Z).alias("flag"))


@query(f"""WITH {views.WORKS_SQL}, s AS (SELECT activity, avg(actual_amount) AS ma, stddev_samp(actual_amount) AS da,
  avg(image_count) AS mi, stddev_samp(image_count) AS di FROM works GROUP BY activity),
z AS (SELECT record_id, coalesce((actual_amount - ma) / CASE WHEN da = 0 THEN 1 ELSE da END, 0) AS za,
  coalesce((image_count - mi) / CASE WHEN di = 0 THEN 1 ELSE di END, 0) AS zi FROM works JOIN s USING (activity))
SELECT record_id, CASE WHEN abs(za) >= abs(zi) THEN 'amount' ELSE 'image_count' END AS feature, round(greatest(abs(za), abs(zi)), 4) AS deviation FROM z""")
def outlier_attribution(spark, sf):
    """The feature that deviates most from its peers."""
    w = views.works(spark, sf)
    s = w.groupBy("activity").agg(*(f(c).alias(f"{p}_{c}") for c in ("actual_amount", "image_count") for p, f in (("m", F.avg), ("d", F.stddev_samp))))
    def dev(c):
        spread = F.when(F.col(f"d_{c}") == 0, 1.0).otherwise(F.col(f"d_{c}"))
        return F.coalesce((F.col(c) - F.col(f"m_{c}")) / spread, F.lit(0.0))
    z = w.join(s, "activity").select("record_id", dev("actual_amount").alias("za"), dev("image_count").alias("zi"))
    feature = peers.top_feature({"amount": F.col("za"), "image_count": F.col("zi")})
    return z.select("record_id", feature.alias("feature"), F.round(F.greatest(F.abs("za"), F.abs("zi")), 4).alias("deviation"))


_FY_SQL = "(year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END)"


@query(f"""WITH l AS (SELECT l_suppkey AS mp, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS price FROM lineitem),
t AS (SELECT mp, {_FY_SQL} AS fy, sum(price) AS total FROM l GROUP BY 1, 2)
SELECT mp, CAST(fy AS INTEGER) AS fy, round(total, 2) AS total, total > {CAP} AS flag, round(least(greatest((total - {CAP}) / {CAP}, 0), 1), 5) AS score FROM t""")
def entitlement_pace(spark, sf):
    """What an official sanctioned in a fiscal year against the cap."""
    l = views.load(spark, sf, "lineitem")
    t = l.groupBy(F.col("l_suppkey").alias("mp"), letters.fiscal_year(F.to_date("l_shipdate")).alias("fy")).agg(F.sum("l_extendedprice").alias("total"))
    return t.select("mp", "fy", F.round("total", 2).alias("total"), (F.col("total") > CAP).alias("flag"),
                    F.round(scores.clamp((F.col("total") - CAP) / CAP), 5).alias("score"))


@query(f"""WITH {views.WORKS_SQL} SELECT record_id, date_diff('day', sanction_date, end_date) AS lag_days,
  date_diff('day', sanction_date, end_date) > 45 AS late,
  round(CASE WHEN date_diff('day', sanction_date, end_date) > 45 THEN least((date_diff('day', sanction_date, end_date) - 45) / 45.0, 1) ELSE 0 END, 5) AS score FROM works""")
def late_sanction(spark, sf):
    """More than 45 days between two dates."""
    w = views.works(spark, sf).withColumn("lag_days", F.datediff("end_date", "sanction_date").cast("long"))
    score = F.when(F.col("lag_days") > 45, scores.excess_ratio(F.col("lag_days"), F.lit(45.0))).otherwise(0.0)
    return w.select("record_id", "lag_days", (F.col("lag_days") > 45).alias("late"), F.round(score, 5).alias("score"))


@query(f"""WITH {views.SANCTIONED_SQL}, {views.COMPLETED_SQL}, {views.PLACES_SQL}, u AS (
  SELECT s.record_id, p.state, s.sanction_amount, c.record_id IS NULL AS open,
    CASE WHEN c.record_id IS NULL THEN date_diff('day', sanction_date, DATE '{AS_OF}') END AS open_days,
    CASE WHEN c.record_id IS NOT NULL THEN date_diff('day', sanction_date, end_date) END AS lag
  FROM sanctioned s JOIN places p USING (mp_id) LEFT JOIN completed c USING (record_id))
SELECT state, count(*) AS works, count(*) FILTER (open) AS open_works, count(*) FILTER (lag > 45) AS late_works,
  round(coalesce(count(*) FILTER (lag > 45) / nullif(count(*) FILTER (lag IS NOT NULL), 0), 0), 6) AS late_share,
  round(sum(CASE WHEN open THEN sanction_amount ELSE 0 END), 2) AS open_amount, max(open_days) AS longest_open FROM u GROUP BY state""")
def inefficiency_stats(spark, sf):
    """Open and late works with their amounts, by state."""
    u = (
        views.sanctioned(spark, sf).join(views.places(spark, sf), "mp_id")
        .join(views.completed(spark, sf).withColumn("done", F.lit(True)), "record_id", "left")
    )
    open_ = F.col("done").isNull()
    lag = F.when(~open_, F.datediff("end_date", "sanction_date"))
    late = F.count_if(lag > 45)
    return u.groupBy("state").agg(
        F.count(F.lit(1)).alias("works"), F.count_if(open_).alias("open_works"), late.alias("late_works"),
        F.round(F.coalesce(F.try_divide(late, F.count(lag)), F.lit(0.0)), 6).alias("late_share"),
        F.round(F.sum(F.when(open_, F.col("sanction_amount")).otherwise(0.0)), 2).alias("open_amount"),
        F.max(F.when(open_, F.datediff(F.lit(AS_OF).cast("date"), "sanction_date"))).cast("long").alias("longest_open"),
    )


@query(f"""WITH {views.SANCTIONED_SQL}, {views.COMPLETED_SQL} SELECT record_id,
  CASE WHEN c.record_id IS NULL THEN 'open' WHEN date_diff('day', sanction_date, end_date) > 45 THEN 'fired'
    WHEN end_date < sanction_date THEN 'unavailable' ELSE 'clear' END AS status, sanction_amount
FROM sanctioned LEFT JOIN completed c USING (record_id) ORDER BY sanction_amount DESC, record_id LIMIT 200""")
def inefficiency_findings(spark, sf):
    """Findings, the largest sanctioned amounts first."""
    f = views.sanctioned(spark, sf).join(views.completed(spark, sf).withColumn("done", F.lit(True)), "record_id", "left")
    status = (
        F.when(F.col("done").isNull(), "open").when(F.datediff("end_date", "sanction_date") > 45, "fired")
        .when(F.col("end_date") < F.col("sanction_date"), "unavailable").otherwise("clear")
    )
    return f.select("record_id", status.alias("status"), "sanction_amount").orderBy(F.desc_nulls_last("sanction_amount"), "record_id").limit(200)


@query("""WITH e AS (SELECT user_id, event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (value > m) AS above, round(max(value), 6) AS most FROM e GROUP BY event_type""")
def group_size_broadcast(spark, sf):
    """A group's statistic beside each row, then counted."""
    e = views.load(spark, sf, "events")
    e = e.join(e.groupBy("event_type").agg(F.avg("value").alias("m")), "event_type")  # few groups, however many rows
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > F.col("m")).alias("above"), F.round(F.max("value"), 6).alias("most"))
