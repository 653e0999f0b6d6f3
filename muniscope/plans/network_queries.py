"""Queries on duplicates, components, vendors and satellite evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, satellite, serving, similarity, vendors
from ..sources import views
from .registry import query


@query("""SELECT md5(text) AS h, count(DISTINCT doc_id) AS n, min(doc_id) AS first, count(DISTINCT source) AS groups FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def exact_hash_groups(spark, sf):
    """Equal content across items, one row per content."""
    d = views.load(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    return similarity.pair_up(d, ["h"], "doc_id", "source")


@query("""WITH d AS (SELECT DISTINCT lang, text, doc_id, source FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS a, min(b.doc_id) AS b FROM d a JOIN d b ON a.text = b.text AND a.lang IS NOT DISTINCT FROM b.lang AND a.source <> b.source GROUP BY a.doc_id""")
def exact_text_cross_group_pairs(spark, sf):
    """Every document whose text, in its language, stands in another source too, with the least such document."""
    d = views.load(spark, sf, "documents").where("text IS NOT NULL").select("lang", F.md5("text").alias("h"), "doc_id", "source")
    return similarity.cross_links(d, ["lang", "h"], "doc_id", "source").select("a", "b")


@query("""WITH d AS (SELECT DISTINCT lang, md5(text) AS h, doc_id, source FROM documents WHERE text IS NOT NULL),
c AS (SELECT lang, h, min(doc_id) AS class FROM d GROUP BY lang, h HAVING count(DISTINCT source) > 1)
SELECT c.class, d.doc_id, d.source FROM d JOIN c ON d.h = c.h AND d.lang IS NOT DISTINCT FROM c.lang""")
def exact_text_cross_group_members(spark, sf):
    """Every member of the classes of equal text and language that span several sources; null texts are in none."""
    d = views.load(spark, sf, "documents").where("text IS NOT NULL").select("lang", F.md5("text").alias("h"), "doc_id", "source")
    return similarity.members_of(d, ["lang", "h"], "doc_id", "source", "source")


@query("""WITH d AS (SELECT DISTINCT md5(text) AS h, doc_id, source FROM documents WHERE text IS NOT NULL),
c AS (SELECT h, min(doc_id) AS class FROM d GROUP BY h HAVING count(DISTINCT doc_id) > 1)
SELECT c.class, d.doc_id, d.source FROM d JOIN c ON d.h = c.h""")
def exact_hash_members(spark, sf):
    """Every member of the classes of equal content; null texts are in none."""
    d = views.load(spark, sf, "documents").where("text IS NOT NULL").select(F.md5("text").alias("h"), "doc_id", "source")
    return similarity.members_of(d, ["h"], "doc_id", "source", "doc_id")


_BITS = """e AS (SELECT vec_id AS id, embedding AS v, list_sort(embedding)[32] AS mid FROM embeddings),
h0 AS (SELECT id, list_transform(v, lambda x: x > mid) AS bits FROM e),
h AS (SELECT e.id, list_transform(range(64), lambda i: xor(CAST(h0.bits[i + 1] AS INTEGER), CAST(list_contains(list_transform(range(e.id % 4), lambda j: (7 * e.id + 13 * j) % 64), i) AS INTEGER))) AS bits
  FROM e JOIN h0 ON h0.id = e.id - e.id % 4)"""
_DIST = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))"
_PAIRS = f"""{_BITS}, n AS (SELECT bits, min(id) AS id FROM h GROUP BY bits),
p AS (SELECT a.id AS a, b.id AS b, {_DIST} AS d FROM n a JOIN n b ON a.id < b.id UNION ALL SELECT n.id, h.id, 0 FROM h JOIN n ON n.bits = h.bits WHERE n.id <> h.id)"""
_NEAR = 6


def _hashes(spark, sf):
    """Pictures of which each is taken four times: the hash of a group's first with up to three bits changed."""
    e = views.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), similarity.sign_hash(F.col("embedding")).alias("x"))
    first = e.select(F.col("id").alias("head"), "x")
    one = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), ((7 * F.col("id") + 13 * j) % 64).cast("int"))
    changed = F.lit(0).cast("long")
    for j in range(3):
        changed = changed.bitwiseXOR(F.when(F.col("id") % 4 > j, one(j)).otherwise(F.lit(0).cast("long")))
    return e.select("id").join(first, F.col("head") == F.col("id") - F.col("id") % 4).select("id", F.col("x").bitwiseXOR(changed).alias("x"))


@query(f"WITH {_PAIRS} SELECT a, b, CAST(d AS INTEGER) AS distance FROM p WHERE d <= {_NEAR}")
def hamming_pairs_banded(spark, sf):
    """Pairs of distinct hashes within six bits, by seven bands, and the copies of each."""
    return similarity.hash_pairs(_hashes(spark, sf), "id", "x", _NEAR)


_HIST = f"hist AS (SELECT {_DIST} AS d, count(*) AS n FROM h a JOIN h b ON a.id < b.id GROUP BY 1)"
_THRESHOLD = f"""{_HIST}, run AS (SELECT d, sum(n) OVER (ORDER BY d) AS run, sum(n) OVER () AS total FROM hist),
t AS (SELECT CAST(least(6, greatest(2, floor(min(d) / 2))) AS INTEGER) AS threshold FROM run WHERE run >= greatest(1, total * 0.01))"""


@query(f"WITH {_BITS}, {_HIST} SELECT CAST(d AS INTEGER) AS distance, n FROM hist")
def hamming_histogram(spark, sf):
    """Distances of all pairs, counted tile by tile."""
    return similarity.distance_histogram(_hashes(spark, sf), "id", "x")


@query(f"WITH {_BITS}, {_THRESHOLD} SELECT threshold FROM t")
def adaptive_threshold(spark, sf):
    """The threshold a histogram of distances asks for."""
    return similarity.adaptive_threshold(similarity.distance_histogram(_hashes(spark, sf), "id", "x"))


_COMP = f"""RECURSIVE {_PAIRS}, {_THRESHOLD}, pairs AS (SELECT a, b FROM p WHERE d <= (SELECT threshold FROM t) AND keep), e2 AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, b AS seen FROM e2 UNION SELECT r.node, e2.b FROM reach r JOIN e2 ON e2.a = r.seen),
comp AS (SELECT node, least(node, min(seen)) AS component FROM reach GROUP BY node)"""


def _near(spark, sf):
    """M7: pairs within the threshold that the data's own histogram asks for."""
    h = graph.shared_table(_hashes(spark, sf), "hashes")
    t = similarity.adaptive_threshold(similarity.distance_histogram(h, "id", "x")).first()
    return graph.shared_table(similarity.hash_pairs(h, "id", "x", t[0] if t and t[0] is not None else 2), "pairs")


@query(f"WITH {_COMP} SELECT node, component FROM comp".replace("keep", "true"))
def components_min_label(spark, sf):
    """M8: connected components of near pairs."""
    return graph.components(_near(spark, sf))


@query(f"WITH {_COMP}, big AS (SELECT component FROM comp GROUP BY component HAVING count(*) > 3) SELECT pairs.a, pairs.b FROM pairs JOIN comp ON pairs.a = comp.node WHERE component NOT IN (SELECT component FROM big)".replace("keep", "a % 7 > 0 AND b % 7 > 0"))
def suppress_large_components(spark, sf):
    """M7: pairs outside components of more than three."""
    pairs = _near(spark, sf).where("a % 7 > 0 AND b % 7 > 0")
    return graph.suppress_large(pairs, graph.components(pairs), 3).select("a", "b")


_PHOTOS = """i AS (SELECT md5(text) AS md5, source || ':' || (doc_id % 50) AS work, doc_id AS seq, CAST(n_chars % 400 AS INTEGER) AS width, CAST(100 + n_chars % 300 AS INTEGER) AS height FROM documents),
f AS (SELECT md5, min(work) AS class, count(DISTINCT work) AS works, arg_min(width, seq) AS w, arg_min(height, seq) AS h FROM i GROUP BY md5 HAVING count(DISTINCT work) > 1)"""


def _photos(spark, sf):
    d = views.load(spark, sf, "documents")
    work = F.concat("source", F.lit(":"), (F.col("doc_id") % 50).cast("string"))
    return d.select(F.md5("text").alias("md5"), work.alias("work"), F.col("doc_id").alias("seq"), (F.col("n_chars") % 400).cast("int").alias("width"), (100 + F.col("n_chars") % 300).cast("int").alias("height"))


@query(f"WITH {_PHOTOS} SELECT DISTINCT md5, class, work FROM i JOIN f USING (md5) WHERE w >= 150 AND h >= 150")
def identical_photos(spark, sf):
    """Works that share an image whose first copy is large enough."""
    return similarity.identical_photos(_photos(spark, sf))


@query(f"WITH {_PHOTOS} SELECT md5, works FROM f WHERE w < 150 OR h < 150")
def stamp_groups(spark, sf):
    """M6: groups of images too small to be evidence."""
    return similarity.stamp_groups(_photos(spark, sf))


@query("""WITH i AS (SELECT md5(text) AS md5, source, doc_id, n_chars FROM documents)
SELECT md5, source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM i GROUP BY md5, source""")
def last_wins_per_work(spark, sf):
    """Of equal images of one work the last."""
    d = views.load(spark, sf, "documents").select(F.md5("text").alias("md5"), "source", "doc_id", "n_chars")
    return similarity.last_per_work(d, ["md5", "source"], "doc_id")


@query(f"""WITH {_PAIRS}, ends AS (SELECT a AS work, b AS other, d FROM p WHERE d <= {_NEAR} UNION ALL SELECT b, a, d FROM p WHERE d <= {_NEAR})
SELECT work, other, CAST(d AS INTEGER) AS distance FROM ends WHERE work IN (3, 10, 21)""")
def duplicates_of_work(spark, sf):
    """2.15 /works/{id}/duplicates, J19: the edges of given works, whichever end they are."""
    edges = similarity.hash_pairs(_hashes(spark, sf), "id", "x", _NEAR)
    both = edges.select(F.col("a").alias("work"), F.col("b").alias("other"), "distance").union(edges.select("b", "a", "distance"))
    return both.where(F.col("work").isin(3, 10, 21))


@query()
def text_near_pairs(spark, sf):
    """J11, M10, U-1: descriptions of one official's works with a matching ratio above 0.9 in different fiscal years."""
    o, l = views.load(spark, sf, "orders"), views.load(spark, sf, "lineitem")
    p = views.load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    w = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, "l_partkey")
    text = F.lower(F.concat_ws(" ", F.lit("supply and laying of"), "p_name", "p_brand", F.lit("for order of"), "o_orderpriority"))
    d = w.select(F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("mp"), text.alias("t"), F.year("o_orderdate").alias("year"))
    works = graph.shared_table(d, "works")  # the joins' shuffle files go before the texts are dealt
    pairs = similarity.text_pairs(works, "id", "t", "mp", across="year").select("a", "b", F.round("ratio", 6).alias("ratio"))
    graph.discard(works)
    return pairs


_W = """w AS (SELECT l_suppkey AS vendor, o_custkey AS mp, CAST(o_orderdate AS DATE) AS day, l_extendedprice AS amount, l_orderkey * 10 + l_linenumber AS id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _vendor_works(spark, sf):
    l, o = views.load(spark, sf, "lineitem"), views.load(spark, sf, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("vendor"), F.col("o_custkey").alias("mp"), F.to_date("o_orderdate").alias("day"),
        F.col("l_extendedprice").alias("amount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )


@query("""WITH e AS (SELECT DISTINCT 'vendor:' || l_suppkey AS l, 'place:' || c_nationkey AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
v AS (SELECT l AS vertex FROM e UNION ALL SELECT r FROM e), d AS (SELECT vertex, count(*) AS degree FROM v GROUP BY vertex)
SELECT vertex, degree, round(degree / ((SELECT count(*) FROM d) - 1), 9) AS centrality FROM d""")
def degree_centrality(spark, sf):
    """Degree centrality of vendors and places."""
    w = _vendor_works(spark, sf).join(views.load(spark, sf, "customer").select(F.col("c_custkey").alias("mp"), F.col("c_nationkey").alias("place")), "mp")
    return graph.degree_centrality(w, "vendor", "place").withColumn("centrality", F.round("centrality", 9))


@query(f"""WITH {_W}, b AS (SELECT mp, vendor, count(*) AS works FROM w GROUP BY mp, vendor), t AS (SELECT mp, sum(works) AS total FROM b GROUP BY mp)
SELECT mp, vendor, works, round(works / total, 6) AS share FROM b JOIN t USING (mp) WHERE works / total >= 0.05 AND total >= 20""")
def vendor_concentration(spark, sf):
    """Vendors with much of one official's works."""
    return vendors.concentration(_vendor_works(spark, sf), 0.05, 20).withColumn("share", F.round("share", 6))


@query(f"""WITH {_W}, f AS (SELECT vendor, min(day) AS first_win FROM w GROUP BY vendor)
SELECT vendor, CAST(vendor % 60 AS INTEGER) AS gap FROM f WHERE vendor % 60 <= 30""")
def vendor_shell(spark, sf):
    """Vendors registered shortly before their first win."""
    w = _vendor_works(spark, sf)
    registered = w.groupBy("vendor").agg(F.min("day").alias("d")).select("vendor", F.date_sub("d", (F.col("vendor") % 60).cast("int")).alias("registered"))
    return vendors.shell(w, registered)


@query(f"""WITH {_W}, n AS (SELECT *, lead(vendor) OVER o AS other, lead(amount) OVER o AS nxt FROM w WINDOW o AS (PARTITION BY mp, day ORDER BY amount, vendor))
SELECT mp, day, vendor, other FROM n WHERE vendor <> other AND nxt - amount <= 0.02 * nxt""")
def vendor_neighbouring_bids(spark, sf):
    """Near-equal bids of two vendors on one day, next to each other in order of amount."""
    return vendors.neighbouring_bids(_vendor_works(spark, sf))


_COLLUSION = f"""WITH {_W} SELECT DISTINCT a.mp, a.day, least(a.vendor, b.vendor) AS vendor, greatest(a.vendor, b.vendor) AS other
FROM w a JOIN w b ON a.mp = b.mp AND a.day = b.day AND a.vendor <> b.vendor WHERE b.amount >= a.amount AND b.amount - a.amount <= 0.02 * b.amount"""


@query(_COLLUSION)
def vendor_collusion_pairs(spark, sf):
    """Every pair of vendors with near-equal bids on one day."""
    return vendors.collusion_pairs(_vendor_works(spark, sf))


@query(f"SELECT vendor, count(*) AS days, count(DISTINCT other) AS partners FROM (SELECT mp, day, vendor, other FROM ({_COLLUSION}) UNION ALL SELECT mp, day, other, vendor FROM ({_COLLUSION})) GROUP BY vendor")
def vendor_collusion(spark, sf):
    """Vendors by how often, and with how many others, they bid near-equal amounts."""
    p = vendors.collusion_pairs(_vendor_works(spark, sf))
    ends = p.select(F.explode(F.array(F.struct("vendor", "other"), F.struct(F.col("other").alias("vendor"), F.col("vendor").alias("other")))).alias("e")).select("e.*")
    return ends.groupBy("vendor").agg(F.count(F.lit(1)).alias("days"), F.count_distinct("other").alias("partners"))


@query(f"""WITH {_W}, low AS (SELECT * FROM w WHERE amount < 50000 AND amount >= 50000 * (1 - 0.1)),
r AS (SELECT *, CASE WHEN coalesce(date_diff('day', lag(day) OVER o, day) > 700, true) THEN 1 ELSE 0 END AS fresh FROM low WINDOW o AS (PARTITION BY vendor, mp ORDER BY day, id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY vendor, mp ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT vendor, mp, count(*) AS invoices, round(sum(amount), 2) AS total FROM g GROUP BY vendor, mp, run HAVING count(*) > 1 AND sum(amount) > 50000""")
def vendor_split_invoicing(spark, sf):
    """Invoices just under a limit that exceed it together."""
    return vendors.split_invoicing(_vendor_works(spark, sf), 50_000.0, 0.1, 700).withColumn("total", F.round("total", 2))


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS party, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount FROM orders)
SELECT a.id AS award, b.id AS payment FROM a JOIN a b ON a.party = b.party AND date_diff('day', a.day, b.day) BETWEEN 2 AND 10 WHERE b.amount / a.amount BETWEEN 0.5 AND 0.98""")
def round_trip_interval_join(spark, sf):
    """An interval join as an equi-join on buckets of days."""
    o = views.load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("party"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"))
    return vendors.round_trips(o, o, low=0.5, high=0.98)


_ROLLUP = f"""WITH {_W}, b AS (SELECT mp, vendor, count(*) AS works FROM w GROUP BY mp, vendor), t AS (SELECT mp, sum(works) AS total FROM b GROUP BY mp),
c AS (SELECT DISTINCT vendor FROM b JOIN t USING (mp) WHERE works / total >= 0.05 AND total >= 20),
e AS (SELECT DISTINCT vendor, mp FROM w), n AS (SELECT (SELECT count(DISTINCT vendor) FROM e) + (SELECT count(DISTINCT mp) FROM e) AS n)
SELECT vendor, count(*) AS works, count(DISTINCT mp) AS officials, round(sum(amount), 1) AS total, CAST(any_value(CASE WHEN vendor IN (SELECT vendor FROM c) THEN 1 ELSE 0 END) AS BIGINT) AS patterns,
  round(least(least(0.3 * any_value(CASE WHEN vendor IN (SELECT vendor FROM c) THEN 1 ELSE 0 END), 1) + 0.2 * count(DISTINCT mp) / (any_value(n) - 1), 1), 6) AS score FROM w, n GROUP BY vendor"""


@query(_ROLLUP)
def vendor_rollup(spark, sf):
    """Totals, patterns and score per vendor."""
    w = _vendor_works(spark, sf)
    c = graph.degree_centrality(w, "vendor", "mp").where(F.col("vertex").startswith("vendor:"))
    c = c.select(F.substring_index("vertex", ":", -1).cast("long").alias("vendor"), "centrality")
    p = vendors.concentration(w, 0.05, 20).select("vendor", F.lit("concentration").alias("pattern"))
    r = vendors.rollup(w, c, p)
    return r.select("vendor", "works", "officials", F.round("total", 1).alias("total"), "patterns", F.round("score", 6).alias("score"))


@query(f"SELECT vendor, works, score FROM ({_ROLLUP}) AS r WHERE score > 0.2 ORDER BY score DESC, vendor LIMIT 100")
def vendor_network_list(spark, sf):
    """F7, 2.15 /vendor-network: the rollup's vendors above a risk, riskiest first."""
    r = vendor_rollup(spark, sf).where("score > 0.2")
    return serving.page(r, [F.desc("score"), F.col("vendor")], 0, 100).select("vendor", "works", "score")


_BANDS = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 10000) AS v FROM embeddings),
b AS (SELECT id, v[1:16] AS red0, v[17:32] AS nir0, v[33:48] AS red1, v[49:64] AS nir1 FROM e),
n AS (SELECT id, list_avg(list_transform(list_zip(red0, nir0), lambda z: CASE WHEN z[2] + z[1] = 0 THEN 0 ELSE (z[2] - z[1]) / (z[2] + z[1]) END)) AS n0,
  list_avg(list_transform(list_zip(red1, nir1), lambda z: CASE WHEN z[2] + z[1] = 0 THEN 0 ELSE (z[2] - z[1]) / (z[2] + z[1]) END)) AS n1,
  list_avg(list_transform(list_zip(red0, red1, nir0, nir1), lambda z: abs(z[2] - z[1]) + abs(z[4] - z[3]))) / 20000 AS diff FROM b)"""


@query(f"""WITH {_BANDS} SELECT id, round(n0, 4) AS ndvi_before, round(n1, 4) AS ndvi_after, round(diff, 4) AS pixel_diff, abs(n1 - n0) > 0.15 AND diff > 0.02 AS changed FROM n""")
def ndvi_change(spark, sf):
    """Vegetation index and pixel difference of two scenes."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 10000)
    bands = views.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *(F.slice(v, 1 + 16 * i, 16).alias(n) for i, n in enumerate(("red0", "nir0", "red1", "nir1"))))
    return satellite.change(bands, 0.15, 0.02)


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey % 5 AS k, c_custkey % 90 AS cloud, (c_custkey % 11) / 10.0 AS conf, c_custkey % 700 AS skew, c_mktsegment AS category FROM customer)
SELECT id, CASE WHEN k = 0 THEN 'coordinates_missing' WHEN conf < 0.6 THEN 'geocode_uncertain' WHEN k = 1 THEN 'imagery_missing' WHEN skew > 365 THEN 'imagery_misaligned' WHEN cloud > 30 THEN 'cloudy'
  WHEN category NOT IN ('BUILDING', 'FURNITURE') THEN 'inconclusive' WHEN category = 'FURNITURE' THEN 'asset_below_resolution' ELSE 'eligible' END AS status FROM p""")
def eligibility_ladder(spark, sf):
    """The first failing gate decides."""
    k = F.col("c_custkey")
    c = views.load(spark, sf, "customer").select(
        k.alias("id"), F.when(F.col("c_nationkey") % 5 != 0, 1.0).alias("lat"), ((k % 11) / 10.0).alias("confidence"), (F.col("c_nationkey") % 5 != 1).alias("images"),
        (k % 700).alias("skew"), (k % 90).alias("cloud"), F.col("c_mktsegment").alias("category"),
    )
    return c.select("id", satellite.eligibility(c).alias("status"))


@query("""WITH w AS (SELECT s_suppkey AS id, s_nationkey AS category, s_acctbal AS amount, s_suppkey % 3 AS branch FROM supplier),
s AS (SELECT category, avg(amount) AS m, stddev_samp(amount) AS d FROM w GROUP BY category),
g AS (SELECT id, CASE WHEN d > 0 AND abs((amount - m) / d) > 1.5 THEN 1.0 ELSE 0.0 END AS cost, CASE WHEN id % 4 = 0 THEN 1.0 ELSE 0.0 END AS missing,
  CASE WHEN branch = 0 THEN CASE WHEN id % 2 = 0 THEN 0.0 ELSE 1.0 END END AS sat, (id % 7) / 7.0 AS vendor FROM w JOIN s USING (category)),
r AS (SELECT id, round(100 * (15 * cost + 5 * missing + coalesce(15 * sat, 0) + 10 * vendor) / (30 + CASE WHEN sat IS NULL THEN 0 ELSE 15 END), 2) AS risk FROM g)
SELECT id, risk, CASE WHEN risk > 80 THEN 'Critical' WHEN risk > 60 THEN 'High' WHEN risk > 30 THEN 'Moderate' ELSE 'Low' END AS band FROM r""")
def satellite_fusion(spark, sf):
    """A second fusion that leaves out what does not apply."""
    k = F.col("s_suppkey")
    w = views.load(spark, sf, "supplier").select(
        k.alias("id"), F.col("s_nationkey").alias("category"), F.col("s_acctbal").alias("amount"), (k % 4 == 0).alias("missing"),
        F.when(k % 3 == 0, k % 2 == 0).alias("changed"), ((k % 7) / 7.0).alias("vendor"),
    )
    return satellite.fuse(w, 1.5)
