"""Queries on forecasts, calibration by outcomes, mosaics of tiles and moves of cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import slippy_tile
from ..operators import evaluation, outlook, satellite, serving
from ..sources import views
from .registry import query

_FOLD = """s AS (SELECT mp, min(month) AS low, max(month) AS last, map_from_entries(list({'k': month, 'v': amount})) AS m FROM spent GROUP BY mp),
x AS (SELECT mp, last, list_transform(range(low, last + 1), lambda k: coalesce(m[k], 0.0)) AS x FROM s),
f AS (SELECT mp, len(x) AS months, list_reduce(list_transform(list_concat([x[1]], x[2:]), lambda v, i: {'l': CAST(v AS DOUBLE), 't': coalesce(x[2], x[1]) - x[1], 'v': CAST(v AS DOUBLE)}),
  lambda a, e: {'l': 0.5 * e.v + 0.5 * (a.l + a.t), 't': 0.3 * (0.5 * e.v + 0.5 * (a.l + a.t) - a.l) + 0.7 * a.t, 'v': e.v}) AS z FROM x)"""


@query(f"""WITH spent AS (SELECT o_custkey AS mp, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
granted AS (SELECT o_custkey AS mp, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS given FROM orders GROUP BY 1), paid AS (SELECT mp, sum(amount) AS paid FROM spent GROUP BY mp), {_FOLD},
t AS (SELECT mp, z.l AS level, z.t AS trend, list_sum(list_transform(range(1, 7), lambda h: greatest(0.0, z.l + h * z.t))) AS forecast FROM f)
SELECT mp, round(level, 3) AS level, round(trend, 3) AS trend, round(forecast, 3) AS forecast, round(given - paid, 2) AS balance,
  CASE WHEN round(given - paid, 3) > 0 THEN round(least(1.0, forecast / (given - paid)), 5) END AS absorbed FROM t JOIN paid USING (mp) JOIN granted USING (mp)""")
def fund_forecast(spark, sf):
    """2.14: what six months are expected to take of an official's funds, by smoothed level and trend."""
    o, l = views.load(spark, sf, "orders"), views.load(spark, sf, "lineitem")
    works = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("mp"), "l_shipdate", "l_extendedprice")
    money = lambda c: F.col(c).cast("decimal(18,2)").alias(c)  # noqa: E731  sums do not depend on the order of rows
    spent = outlook.monthly(works.select("mp", "l_shipdate", money("l_extendedprice")), "mp", "l_shipdate", "l_extendedprice")
    spent = spent.withColumn("amount", F.col("amount").cast("double"))
    granted = o.select(F.col("o_custkey").alias("mp"), money("o_totalprice").alias("amount")).groupBy("mp").agg(F.sum("amount").cast("double").alias("amount"))
    found = outlook.fund_forecast(spent, granted, "mp")
    balance = F.round("balance", 3)
    return found.select(
        "mp", *(F.round(c, n).alias(c) for c, n in (("level", 3), ("trend", 3), ("forecast", 3), ("balance", 2))), F.when(balance > 0, F.round("absorbed", 5)).alias("absorbed")
    )


_WEIGHTS = {"1-URGENT": 25.0, "2-HIGH": 20.0, "3-MEDIUM": 15.0, "4-NOT SPECIFIED": 10.0, "5-LOW": 5.0, "6-NEVER SEEN": 5.0}


@query(f"""WITH w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in _WEIGHTS.items())}) AS v(signal, old)),
r AS (SELECT o_orderpriority AS signal, CAST(least(100, floor((o_custkey * 7 + o_orderkey) % 101 / 100.0 * 100 + 1e-9)) AS INTEGER) AS b, o_orderstatus = 'F' OR (o_custkey * 7 + o_orderkey) % 101 > 60 AND o_orderpriority < '3' AS ok FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT signal, b, count(*) AS n, count(*) FILTER (ok) AS k FROM r GROUP BY 1, 2),
u AS (SELECT *, sum(n) OVER o AS nn, sum(k) OVER o AS kk FROM c WINDOW o AS (PARTITION BY signal ORDER BY b DESC)),
g AS (SELECT signal, sum(n) AS reviewed, sum(k) AS k, min(CASE WHEN nn >= 10 AND kk >= 0.6 * nn THEN b END) AS b FROM u GROUP BY signal),
m AS (SELECT w.signal, old, reviewed, k / reviewed AS precision, CASE WHEN b IS NULL THEN 0.5 ELSE least(0.5 + 0.1, greatest(0.5 - 0.1, b / 100.0)) END AS threshold,
  old * coalesce(least(2.0, greatest(0.5, k / reviewed / (SELECT sum(k) / sum(reviewed) FROM g))), 1.0) AS raw FROM w LEFT JOIN g USING (signal))
SELECT signal, CAST(coalesce(reviewed, 0) AS BIGINT) AS reviewed, round(precision, 6) AS precision, round(threshold, 4) AS threshold, round(raw * (SELECT sum(old) / sum(raw) FROM m), 6) AS weight FROM m""")
def calibrated_signals(spark, sf):
    """2.14: thresholds and weights of signals after a round of reviews; open ones do not count."""
    mark = (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 101
    confirmed = F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F") | ((mark > 60) & (F.col("o_orderpriority") < "3")))
    reviews = views.load(spark, sf, "orders").select(F.col("o_orderpriority").alias("signal"), (mark / 100.0).alias("score"), confirmed.alias("confirmed"))
    found = outlook.calibrated(reviews, _WEIGHTS, 0.5, target=0.6)
    return found.select("signal", "reviewed", *(F.round(c, n).alias(c) for c, n in (("precision", 6), ("threshold", 4), ("weight", 6))))


_ZOOM, _GRID, _SIDE, _CROP = 9, 3, 8, 13
_LAT, _LON = "(c_custkey * 37 % 1201 / 10.0 - 60)", "(c_custkey * 53 % 3501 / 10.0 - 175)"


@query(f"""WITH c AS (SELECT c_custkey AS id, ({_LON} + 180.0) / 360.0 * 512 AS x, (1.0 - ln(tan(radians({_LAT})) + 1.0 / cos(radians({_LAT}))) / pi()) / 2.0 * 512 AS y FROM customer),
w AS (SELECT id, floor(x) AS tx, floor(y) AS ty, CAST(floor((1 + x - floor(x)) * {_SIDE} - {_CROP} / 2.0) AS INTEGER) AS l, CAST(floor((1 + y - floor(y)) * {_SIDE} - {_CROP} / 2.0) AS INTEGER) AS t FROM c),
g AS (SELECT id, count(*) FILTER ((tx + dx - 1 + 3 * (ty + dy - 1)) % 5 = 0) AS missing FROM w, range(3) AS a(dx), range(3) AS b(dy) GROUP BY id),
p AS (SELECT id, i, j, CAST(tx + (l + j) // {_SIDE} - 1 AS BIGINT) AS x, CAST(ty + (t + i) // {_SIDE} - 1 AS BIGINT) AS y, (l + j) % {_SIDE} AS px, (t + i) % {_SIDE} AS py FROM w, range({_CROP}) AS a(i), range({_CROP}) AS b(j)),
v AS (SELECT id, sum(CASE WHEN (x + 3 * y) % 5 = 0 THEN 0 ELSE (x * 7 + y * 11 + px * 3 + py * 5) % 256 * (i * {_CROP} + j + 1) END) AS checksum FROM p GROUP BY id)
SELECT id, CAST(missing AS INTEGER) AS missing, {_CROP * _CROP} AS n, CAST(checksum AS BIGINT) AS checksum FROM g JOIN v USING (id)""")
def tile_mosaic(spark, sf):
    """A square around each place, put together from the tiles that cover it; every fifth tile is not there."""
    k = F.col("c_custkey")
    places = views.load(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1201 / 10.0 - 60).alias("lat"), (k * 53 % 3501 / 10.0 - 175).alias("lon"))
    own = places.select(slippy_tile(F.col("lat"), F.col("lon"), _ZOOM).alias("t"))
    near = F.sequence(F.lit(-1), F.lit(1))
    around = own.select(F.explode(F.transform(near, lambda d: F.col("t.x") + d)).alias("x"), F.col("t.y").alias("_y")).withColumn("y", F.explode(F.transform(near, lambda d: F.col("_y") + d)))
    cells = F.sequence(F.lit(0), F.lit(_SIDE * _SIDE - 1))
    pixel = lambda i: ((F.col("x") * 7 + F.col("y") * 11 + i % _SIDE * 3 + F.floor(i / _SIDE) * 5) % 256).cast("int")
    tiles = around.select("x", "y").distinct().where((F.col("x") + 3 * F.col("y")) % 5 != 0).select("x", "y", F.transform(cells, pixel).alias("pixels"))
    found = satellite.mosaic(places, tiles, _ZOOM, _GRID, _SIDE, _CROP)
    weighted = F.transform("pixels", lambda v, i: v.cast("long") * (i + 1))
    return found.select("id", "missing", F.size("pixels").alias("n"), F.aggregate(weighted, F.lit(0).cast("long"), lambda a, v: a + v).alias("checksum"))


_STATES = list(serving.TRANSITIONS)
_ROLES = list(serving.ROLE_TARGETS)
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, bs in serving.TRANSITIONS.items() for b in bs)
_MAY = ", ".join(f"('{r}', '{b}')" for r, bs in serving.ROLE_TARGETS.items() for b in bs)
_PICK = lambda names, n: "CASE " + " ".join(f"WHEN {n} = {i} THEN '{s}'" for i, s in enumerate(names)) + " END"


@query(f"""WITH RECURSIVE m AS (SELECT user_id AS k, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  {_PICK(_STATES, f"event_id * 5 % {len(_STATES)}")} AS target, {_PICK(_ROLES, f"event_id % {len(_ROLES)}")} AS role, CASE WHEN event_id % 3 > 0 THEN 'because' END AS reason FROM events),
allowed AS (SELECT * FROM (VALUES {_ALLOWED}) AS v(a, b)), may AS (SELECT * FROM (VALUES {_MAY}) AS v(r, b)),
j AS (SELECT m.*, r.r IS NOT NULL AS may FROM m LEFT JOIN may r ON r.r = m.role AND r.b = m.target),
s AS (SELECT DISTINCT k, 0 AS n, CAST(NULL AS BIGINT) AS item, 'NEW' AS before, 'NEW' AS status, 'ok' AS verdict FROM j UNION ALL
  SELECT s.k, s.n + 1, j.item, s.status, CASE WHEN v.verdict = 'ok' THEN j.target ELSE s.status END, v.verdict FROM s JOIN j ON j.k = s.k AND j.n = s.n + 1,
  LATERAL (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM allowed WHERE a = s.status AND b = j.target) THEN 'illegal_transition' WHEN NOT j.may THEN 'role_not_allowed'
    WHEN coalesce(j.reason, '') = '' AND (j.target IN ({", ".join(repr(x) for x in serving.NEEDS_REASON)}) OR s.status IN ({", ".join(repr(x) for x in serving.TERMINAL)})) THEN 'reason_required' ELSE 'ok' END AS verdict) AS v)
SELECT k AS "case", item, before AS from_status, verdict, status FROM s WHERE n > 0""")
def case_moves(spark, sf):
    """2.15 POST /cases/transition: moves of cases taken in order of time; only legal ones change a case."""
    e = views.load(spark, sf, "events")
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (n % len(names) + 1).cast("int"))
    moves = e.select(
        F.col("user_id").alias("case"), F.col("event_id").alias("item"), "ts", pick(_STATES, F.col("event_id") * 5).alias("to_status"),
        pick(_ROLES, F.col("event_id")).alias("role"), F.when(F.col("event_id") % 3 > 0, "because").alias("reason"),
    )
    return serving.replay(moves, "case", "item", "ts")


_A = ["phantom_work", "coordinate_reuse", "backdated_completion", "genuine", "genuine_unverified", "none"]
_B = ["structuring", "missing_evidence", "cost_outlier", "cross_year_text_duplicate", "entitlement_pace_cluster", "none", "none"]
_CASES = lambda names, n: "CASE " + " ".join(f"WHEN ({n}) % {len(names)} = {i} THEN '{s}'" for i, s in enumerate(names)) + " END"


@query(f"""WITH w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey // 3 % 2 = 0 THEN 'A' ELSE 'B' END AS branch, o_custkey AS mp, o_orderpriority AS category, o_totalprice AS amount, 'work ' || (o_orderkey % 7) AS description, o_orderkey % 3 > 0 AS has_images, o_orderkey % 97 AS asset FROM orders),
t AS (SELECT id, branch, asset, CASE branch WHEN 'A' THEN {_CASES(_A, "id")} ELSE {_CASES(_B, "id")} END AS pattern FROM w),
c AS (SELECT DISTINCT asset, asset % 3 = 0 AS changed FROM w WHERE asset % 10 < 9),
a AS (SELECT pattern, changed FROM t LEFT JOIN c USING (asset) WHERE branch = 'A'), b AS (SELECT * FROM w WHERE branch = 'B'),
p AS (SELECT category, avg(amount) AS m, stddev_samp(amount) AS s FROM b GROUP BY 1), x AS (SELECT description, mp, count(*) AS n FROM b GROUP BY 1, 2), o AS (SELECT mp, sum(amount) AS total FROM b GROUP BY 1),
e AS (SELECT DISTINCT pattern, unnest(CASE WHEN pattern = 'structuring' THEN [id, id + 14] ELSE [id] END) AS id FROM t WHERE branch = 'B'),
j AS (SELECT pattern, b.mp, CASE pattern WHEN 'structuring' THEN amount < 150000 WHEN 'missing_evidence' THEN NOT has_images WHEN 'cost_outlier' THEN s > 0 AND (amount - m) / s > 1.2 WHEN 'cross_year_text_duplicate' THEN n > 1 WHEN 'entitlement_pace_cluster' THEN total > 1500000 END AS f
  FROM e LEFT JOIN b USING (id) LEFT JOIN p USING (category) LEFT JOIN x ON x.description = b.description AND x.mp = b.mp LEFT JOIN o ON o.mp = b.mp)
SELECT 'A' AS branch, pattern, count(*) FILTER (NOT changed) AS hits, count(*) AS total FROM a WHERE pattern IN ('phantom_work', 'coordinate_reuse', 'backdated_completion') GROUP BY pattern
UNION ALL SELECT 'A', 'genuine_correctly_not_flagged', count(*) FILTER (changed), count(*) FROM a WHERE pattern LIKE 'genuine%' AND changed IS NOT NULL
UNION ALL SELECT 'B', pattern, count(*) FILTER (f), count(*) FROM j WHERE pattern NOT IN ('none', 'entitlement_pace_cluster') GROUP BY pattern
UNION ALL SELECT 'B', pattern, count(DISTINCT mp) FILTER (f), count(DISTINCT mp) FROM j WHERE pattern = 'entitlement_pace_cluster' GROUP BY pattern""")
def evaluation_report(spark, sf):
    """2.14, 2.15 /evaluation: hits of each rule among planted irregularities, for both branches."""
    k = F.col("o_orderkey")
    pick = lambda names: F.element_at(F.array(*(F.lit(x) for x in names)), (k % len(names) + 1).cast("int"))
    branch = F.when(F.floor(k / 3) % 2 == 0, "A").otherwise("B")
    o = views.load(spark, sf, "orders").withColumns({"branch": branch, "asset": k % 97})
    works = o.select(
        k.alias("id"), "branch", F.col("o_custkey").alias("mp"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("work "), k % 7).alias("description"), (k % 3 > 0).alias("has_images"),
    )
    truth = o.select(k.alias("id"), "branch", "asset", F.when(F.col("branch") == "A", pick(_A)).otherwise(pick(_B)).alias("pattern"))
    truth = truth.withColumn("cluster", F.when(F.col("pattern") == "structuring", F.array("id", F.col("id") + 14)))
    change = o.where("asset % 10 < 9").select("asset", (F.col("asset") % 3 == 0).alias("changed")).distinct()
    return evaluation.branch_report(works, truth, change, 150_000.0, 1_500_000.0, 1.2)
