"""Streaming queries, run to the end of what is there, and recall of injected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images
from ..operators import graph, injection, peers
from ..sources import files, readers, sinks, views
from ..streaming import streams
from .registry import query

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, sf):
    s = streams.file_stream(spark, sf, "events.parquet", _SCHEMA)
    return s.withColumn("at", F.col("ts").cast("timestamp"))


#: Parts that the events come in, by time, and days after the last one at which a row closes all windows.
_PARTS_OF_TIME, _CLOSES_AFTER = 3, 30


def _feed(spark, sf):
    """Events as a stream of several batches in order of time; the last batch is one row, of no user, long after."""
    folder = graph.shared_folder(spark, "feed")
    e = views.load(spark, sf, "events").select(*(c.split()[0] for c in _SCHEMA.split(", ")))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    for k in range(_PARTS_OF_TIME if low else 0):
        begin, end = (low + (high - low) * i / _PARTS_OF_TIME for i in (k, k + 1))
        part = e.where((F.col("ts") >= F.lit(begin)) & ((F.col("ts") < F.lit(end)) if k + 1 < _PARTS_OF_TIME else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(folder)
    close = e.agg((F.max("ts") + F.expr(f"INTERVAL {_CLOSES_AFTER} DAYS")).alias("ts"))
    none = [F.lit(None).cast(e.schema[c].dataType).alias(c) if c != "ts" else F.col("ts") for c in e.columns]
    close.select(*none).coalesce(1).write.mode("append").parquet(folder)
    s = streams.file_stream(spark, folder, "*.parquet", _SCHEMA, files_per_trigger=1)
    return s.withColumn("at", F.col("ts").cast("timestamp"))


def _out(spark, tag):
    base = graph.shared_folder(spark, f"stream-{tag}")
    return f"{base}/out", f"{base}/checkpoint"


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf):
    """Tumbling counts, each window written once when the watermark has passed it, and forgotten."""
    out, mark = _out(spark, "windows")
    counts = streams.window_counts(_feed(spark, sf), "at", "1 hour", None, "0 seconds", "event_type")
    streams.run_available(counts, out, mark)
    return spark.read.parquet(out).where("event_type IS NOT NULL").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf):
    """2.11: insert-if-new over micro-batches: of a key's many rows one enters."""
    out, mark = _out(spark, "new")
    streams.run_batches(_events(spark, sf).select("event_id", "user_id"), streams.merge_new(out, "user_id"), mark)
    return spark.read.parquet(out).select("user_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_within_watermark(spark, sf):
    """2.11: first rows of a key by the engine's own state, which is dropped with the watermark."""
    out, mark = _out(spark, "within")
    streams.run_available(streams.first_seen(_events(spark, sf), ["user_id", "event_type"], "at", "3650 days").select("user_id", "event_type"), out, mark)
    return spark.read.parquet(out)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 4 HOUR, true) THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    """2.11: sessions of a user by gaps of four hours, each written once when the watermark has passed it."""
    out, mark = _out(spark, "sessions")
    streams.run_available(streams.sessions(_feed(spark, sf), "at", "4 hours", "0 seconds", "user_id"), out, mark)
    return spark.read.parquet(out).where("user_id IS NOT NULL").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT a.event_id, a.user_id, count(*) AS attempts, count(*) >= 10 AS limited FROM e a JOIN e b ON a.user_id = b.user_id AND (b.s < a.s OR b.s = a.s AND b.event_id <= a.event_id) AND b.s >= a.s - 300
GROUP BY a.event_id, a.user_id""")
def stream_sliding_limit(spark, sf):
    """2.11, W7: attempts of a user in the 300 seconds before each, with ten as the limit, from state per user."""
    out, mark = _out(spark, "sliding")
    feed = _feed(spark, sf).withWatermark("at", "1 minute")
    streams.run_available(streams.sliding_attempts(feed, "user_id", "event_id", "at", 300, 10), out, mark)
    return spark.read.parquet(out).where("user_id IS NOT NULL")


_LIFE = 6 * 3600


@query(f"""WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'issue' WHEN 'error' THEN 'revoke' ELSE 'use' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT *, max(CASE WHEN kind = 'issue' THEN k END) OVER o AS issued, max(CASE WHEN kind = 'revoke' THEN k END) OVER o AS revoked, max(CASE WHEN kind = 'issue' THEN ts END) OVER o AS since FROM e WINDOW o AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, coalesce(issued > coalesce(revoked, 0) AND ts < since + to_seconds({_LIFE}), false) AS live FROM w WHERE kind = 'use'""")
def stream_token_uses(spark, sf):
    """2.11: uses of tokens that are issued, expire and are revoked, from state that a timer ends."""
    out, mark = _out(spark, "tokens")
    kind = F.when(F.col("event_type") == "signup", "issue").when(F.col("event_type") == "error", "revoke").otherwise("use")
    feed = _feed(spark, sf).withColumn("kind", kind).withWatermark("at", "1 minute")
    streams.run_available(streams.token_uses(feed, "user_id", "event_id", "at", "kind", _LIFE), out, mark)
    if streams.state_rows(spark, mark, "ends"):
        raise ValueError("tokens outlived their end")
    return spark.read.parquet(out).where("user_id IS NOT NULL")


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, value FROM r WHERE k = 1""")
def stream_latest_state(spark, sf):
    """An append-only log and the latest state of each key."""
    out, mark = _out(spark, "log")
    streams.run_available(_events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value"), out, mark)
    log = spark.read.parquet(out)
    return log.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("v")).select("user_id", "v.*")


@query("""WITH s AS (SELECT user_id, CAST(floor(epoch(ts) / 300) AS BIGINT) AS b FROM events) SELECT user_id, b * 300 AS bucket, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def stream_rate_limit(spark, sf):
    """Buckets of 300 seconds with two attempts or more, each written once when it is over."""
    out, mark = _out(spark, "rate")
    counts = streams.window_counts(_feed(spark, sf), "at", "300 seconds", None, "0 seconds", "user_id")
    streams.run_available(counts.where("n >= 2"), out, mark)
    return spark.read.parquet(out).where("user_id IS NOT NULL").select("user_id", F.col("start").cast("long").alias("bucket"), "n")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "WORK_RECOMMENDATION_DTL_ID", o_orderstatus AS "WORK_STAGE", CAST(o_custkey AS VARCHAR) AS "MP" FROM orders""")
def resumed_pages(spark, sf):
    """Records of a portal's pages, each page with a totals row; a run that stops after some pages and another that goes on."""
    root = graph.shared_folder(spark, "portal")
    o = views.load(spark, sf, "orders")
    record = F.struct(F.col("o_orderkey").alias("WORK_RECOMMENDATION_DTL_ID"), F.col("o_orderstatus").alias("WORK_STAGE"), F.col("o_custkey").alias("MP"))
    pages = o.groupBy((F.col("o_orderkey") % 12).alias("page")).agg(F.collect_list(record).alias("rows"), F.count(F.lit(1)).alias("n"))
    total = F.concat(F.lit('{"WORK_STAGE":"Grand total","MP":'), "n", F.lit("}]"))
    body = F.concat(F.regexp_replace(F.to_json("rows"), r"\]$", ","), total)
    page = F.to_json(F.struct(body.alias("TotalWorks"))).cast("binary")
    named = pages.select(F.format_string("page-%04d", F.col("page").cast("int")).alias("name"), page.alias("content"))
    files.write_files(named.where("page < 5"), f"{root}/pages")  # the rest is not there yet
    stream = readers.paged_records(spark, f"{root}/pages", "WORK_RECOMMENDATION_DTL_ID string, WORK_STAGE string, MP string", "WORK_RECOMMENDATION_DTL_ID", 2)
    streams.run_until_idle(stream, f"{root}/out", f"{root}/checkpoint")
    files.write_files(named, f"{root}/pages")
    again = readers.paged_records(spark, f"{root}/pages", "WORK_RECOMMENDATION_DTL_ID string, WORK_STAGE string, MP string", "WORK_RECOMMENDATION_DTL_ID", 2)
    streams.run_until_idle(again, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("""SELECT n_nationkey || '.jpg' AS name, CAST(octet_length(encode(n_name)) AS BIGINT) AS length FROM nation UNION ALL SELECT n_nationkey || '.jpg', CAST(octet_length(encode(n_name)) AS BIGINT) + 7 FROM nation WHERE n_nationkey % 4 = 0""")
def attachment_stream(spark, sf):
    """S9, 2.11: media files as they come: each once, those that change again, over three runs."""
    root = graph.shared_folder(spark, "incoming")
    n = views.load(spark, sf, "nation")
    name = F.concat(F.col("n_nationkey").cast("string"), F.lit(".jpg"))
    rows = n.select("n_nationkey", name.alias("name"), F.col("n_name").cast("binary").alias("content"))

    def run() -> None:
        streams.run_until_idle(readers.changed_files(spark, f"{root}/in").drop("content"), f"{root}/out", f"{root}/checkpoint")

    files.write_files(rows.where("n_nationkey < 10"), f"{root}/in")
    run()
    files.write_files(rows, f"{root}/in")
    run()
    longer = rows.where("n_nationkey % 4 = 0").withColumn("content", F.concat("content", F.lit(" edited").cast("binary")))
    files.replace_files(longer, f"{root}/in")
    run()
    return spark.read.parquet(f"{root}/out").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def _works(spark, sf):
    w = views.works(spark, sf)
    return w.select(
        F.col("record_id").alias("id"), F.col("mp_id").alias("mp"), F.concat(F.lit("Zilla Parishad "), "constituency").alias("agency"), "activity", F.col("actual_amount").alias("amount"),
        "sanction_date", "end_date", F.col("image_count").cast("int").alias("image_count"), F.concat_ws(" ", "activity", "record_id").alias("description"), F.col("constituency").alias("place"),
    )


_COPIED = {"structuring": 3, "split_purchase": 4}
_SURE = [n for n in injection.PATTERNS if n != "cost_outlier"]


@query(f"""WITH {views.WORKS_SQL}, t AS (SELECT least(20, count(*)) AS n FROM works), p AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {_COPIED.get(n, 1)})" for n in _SURE)}) AS v(pattern, k))
SELECT pattern, CAST(n * k AS INTEGER) AS injected, CAST(n * k AS INTEGER) AS found FROM p, t""")
def injection_recall(spark, sf):
    """2.14: twelve patterns put into works and looked for by the library's own rules, pictures by hashes of pixels; all must be found."""
    found = injection.recall_by_detector(injection.with_pictures(_works(spark, sf)), 20, _SURE)
    return found.select("pattern", F.col("injected").cast("int").alias("injected"), F.col("found").cast("int").alias("found"))


@query()
def cost_outlier_recall(spark, sf):
    """Recall of injected cost outliers by the peer ladder."""
    w = graph.shared_table(injection.inject(_works(spark, sf), 20, ["cost_outlier"]), "injected")
    z = peers.ladder_z(w, "amount", "activity", "place")
    return injection.recall(w, z.where(F.col("z") > peers.FLAG_Z))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'insufficient_features' WHEN o_orderkey % 150 >= 100 AND (o_custkey % 10) / 10.0 >= 0.2 AND (o_custkey % 7) / 20.0 >= 0.05 THEN 'confirmed_visual_correspondence'
  WHEN o_orderstatus = 'P' THEN 'rejected_watermark' ELSE 'rejected_generic_similarity' END AS class FROM orders""")
def image_match_class(spark, sf):
    """What a geometric comparison's counts decide."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    keypoints = F.when(k % 5 == 0, 5).otherwise(500)
    name = images.match_class(k % 150, (c % 10) / 10.0, (c % 7) / 20.0, keypoints, F.col("o_orderstatus") == "P")
    return views.load(spark, sf, "orders").select(k.alias("id"), name.alias("class"))


_PARTS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(f"""WITH r AS (SELECT sha256('{{"r_name":' || to_json(r_name) || ',"r_regionkey":"' || r_regionkey || '"}}') AS h FROM region)
SELECT count(*) AS rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_PARTS})) AS digest FROM r""")
def snapshot_digest(spark, sf):
    """K2: a digest of content, whatever its order."""
    r = views.load(spark, sf, "region").select("r_regionkey", "r_name")
    d = sinks.digest(r.orderBy(F.desc("r_regionkey")))
    return r.agg(F.count(F.lit(1)).alias("rows")).withColumn("digest", F.lit(d))
