"""Queries on sources and sinks: each writes files from a table to the shared folder and reads them as an operator does."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import images, text
from ..operators import graph
from ..session import ship_package
from ..sources import corpus, files, sinks, views
from .registry import query


def _csv(df, spark, tag: str) -> str:
    """df as a family of CSV files in folders by nation, every file with the family's name."""
    root = graph.shared_folder(spark, tag)
    sinks.write_csv(df, f"{root}/a/works")
    return root


def _customers(spark, sf):
    c = views.load(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("WORK_ID"), F.concat(F.lit('say "'), "c_name", F.lit('", then\ngo')).alias("DESCRIPTION"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("ACTIVITY"),
    )


_TEXT = """'say "' || c_name || '", then' || chr(10) || 'go'"""


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS "WORK_ID", {_TEXT} AS "DESCRIPTION", CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS "ACTIVITY", CAST(NULL AS VARCHAR) AS "NOTE" FROM customer""")
def csv_family_scan(spark, sf):
    """A recursive family of CSV files, all text, nulls kept, absent columns null."""
    root = _csv(_customers(spark, sf), spark, "csv")
    return corpus.csv_family(spark, root, "*.csv", ["WORK_ID", "DESCRIPTION", "ACTIVITY", "NOTE"]).drop("_source_csv")


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS "WORK_ID", CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS "ACTIVITY", upper(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END) || '|' || c_custkey AS "KEY" FROM customer""")
def csv_family_blank_filled(spark, sf):
    """Blanks for nulls, unique keys, derived columns."""
    root = _csv(_customers(spark, sf), spark, "csv")
    rows = corpus.csv_family(spark, root, "*.csv", ["WORK_ID", "ACTIVITY"]).drop("_source_csv")
    return corpus.blank_filled(rows, "WORK_ID", {"KEY": F.concat(F.upper("ACTIVITY"), F.lit("|"), "WORK_ID")})


@query("SELECT count(*) AS rows, true AS has_paths FROM customer")
def csv_family_paths(spark, sf):
    """A family with the list of its files."""
    root = _csv(_customers(spark, sf), spark, "csv")
    _, paths = corpus.profiled(spark, root, "*.csv", ["WORK_ID"])
    return paths.agg(F.sum("rows").alias("rows"), F.min(F.col("path").endswith(".csv")).alias("has_paths"))


def _database(spark) -> tuple[str, dict[str, str]] | None:
    """URL and properties of a SQL database: that of spark.muniscope.jdbc.url, or one inside a local master's own JVM; none
    where executors are other processes, which a database in one JVM does not reach."""
    url = spark.conf.get("spark.muniscope.jdbc.url", None)
    if url:
        return url, {}
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return None
    return "jdbc:derby:memory:muniscope;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 0")
def sql_table_scan(spark, sf):
    """A table of a SQL database, read by ranges of its key in parallel, with the filter sent to the database."""
    found = _database(spark)
    c = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    if found is None:
        path = f"{graph.shared_folder(spark, 'database')}/works.sqlite"
        corpus.write_sqlite(c, path, "works", "id")
        return corpus.sqlite_table(spark, path, "works", c.schema, "id", 4, "balance > 0")
    url, properties = found
    table = f"works_{uuid.uuid4().hex}"
    c.coalesce(1).write.jdbc(url, table, mode="overwrite", properties=properties)
    return corpus.sql_table(spark, url, table, properties, "id", 4).where("balance > 0").select(*(F.col(x) for x in c.columns))


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS amount FROM orders""")
def json_artifact_scan(spark, sf):
    """A JSON artifact, written without NaN and read with its schema."""
    path = graph.shared_folder(spark, "json")
    o = views.load(spark, sf, "orders")
    sinks.write_json(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("amount")), path)
    return corpus.json_artifact(spark, path, "id long, status string, amount double", lines=True)


@query("""SELECT s_suppkey AS vendor, s_name AS name, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS risk FROM supplier""")
def csv_artifact_scan(spark, sf):
    """A typed CSV artifact whose NaN are nulls."""
    path = graph.shared_folder(spark, "artifact")
    s = views.load(spark, sf, "supplier")
    sinks.write_csv(s.select(F.col("s_suppkey").alias("vendor"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")).otherwise(F.lit(float("nan"))).alias("risk")), path)
    return corpus.csv_artifact(spark, path, "vendor long, name string, risk double")


_JPEG = "unhex('FFD8FFE0') || encode(p_name) || unhex('FFD9')"


def embedded_files(spark, sf):
    """(path, length, modificationTime, content): parts as files in memory: every third a picture, a document with two, or neither."""
    p = views.load(spark, sf, "part")
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE0")), F.col("p_name").cast("binary"), F.unhex(F.lit("FFD9")))
    pdf = F.concat(F.lit("%PDF-1.4 ").cast("binary"), jpeg, F.lit(" x ").cast("binary"), jpeg, F.lit(" %%EOF").cast("binary"))
    k = F.col("p_partkey") % 3
    content = F.when(k == 0, jpeg).when(k == 1, pdf).otherwise(F.lit("plain").cast("binary"))
    return p.select(F.concat(F.lit("f/"), F.col("p_partkey").cast("string")).alias("path"), content.alias("content"))


@query(f"""WITH j AS (SELECT p_partkey, md5({_JPEG}) AS md5 FROM part WHERE p_partkey % 3 < 2)
SELECT 'f/' || p_partkey AS path, md5, CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 1 END AS n FROM j""")
def embedded_jpegs(spark, sf):
    """Every JPEG stream inside files, by path and digest."""
    found = corpus.embedded_images(embedded_files(spark, sf))
    return found.groupBy("path", "md5").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'not_a_pdf' WHEN p_partkey % 3 = 2 THEN CASE p_partkey % 6 WHEN 2 THEN 'empty' ELSE 'unsupported' END END AS failure FROM part""")
def pdf_failures(spark, sf):
    """Why a document gave no image."""
    f = embedded_files(spark, sf).withColumn("id", F.substring("path", 3, 20).cast("long"))
    none = F.when(F.col("id") % 6 == 2, F.lit("")).otherwise(F.lit("%PDF-1.4 /Filter /JPXDecode %%EOF")).cast("binary")
    f = f.withColumn("content", F.when(F.col("id") % 3 == 2, none).otherwise(F.col("content")))
    return f.select("id", corpus.pdf_failure("content").alias("failure"))


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'jpg' ELSE 'pdf' END AS name, count(*) AS files, CAST(sum(octet_length(encode(p_name))) AS BIGINT) AS bytes FROM part WHERE p_partkey % 3 < 2 GROUP BY 1""")
def attachment_walk(spark, sf):
    """Media files below a folder by extension, whatever its case, others left out; a file for every part."""
    root = graph.shared_folder(spark, "files")
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "JPG").when(k % 3 == 1, "pdf").otherwise("txt")
    named = views.load(spark, sf, "part").select(k, F.concat(k.cast("string"), F.lit("."), kind).alias("name"), F.col("p_name").cast("binary").alias("content"))
    files.write_files(named.where(k % 2 == 0), f"{root}/deep/even")
    files.write_files(named.where(k % 2 == 1), f"{root}/odd")
    found = corpus.attachments(spark, root)
    return found.groupBy(F.lower(F.substring_index("name", ".", -1)).alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("""WITH w AS (SELECT o_orderkey AS work, 'img' || (o_orderkey % 50) || '.jpg' AS name FROM orders)
SELECT DISTINCT work, name FROM w""")
def guarded_references(spark, sf):
    """names from a list, those that would leave the folder left out."""
    o = views.load(spark, sf, "orders")
    listed = F.concat(F.lit("img"), F.col("o_orderkey") % 50, F.lit(".jpg; ../x.jpg;/etc/y.jpg;;"))
    return corpus.references(o.select(F.col("o_orderkey").alias("work"), listed.alias("l")), "work", "l")


@query("SELECT r_regionkey, r_name FROM region")
def snapshot_round_trip(spark, sf):
    """A sorted snapshot, the same content again, and what a reader then sees."""
    path = graph.shared_folder(spark, "snapshot")
    r = views.load(spark, sf, "region")
    wrote = [sinks.write_snapshot(r.limit(2), path, ["r_regionkey"]), sinks.write_snapshot(r, path, ["r_regionkey"]), sinks.write_snapshot(r.orderBy(F.desc("r_regionkey")), path, ["r_regionkey"])]
    if wrote != [True, True, False]:
        raise ValueError("a snapshot was written again, or not at all")
    return sinks.read_snapshot(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def backup_before_migration(spark, sf):
    """The copy that is made before a new table comes, read back; none when all tables are there."""
    root = graph.shared_folder(spark, "store")
    views.load(spark, sf, "nation").select("n_nationkey", "n_name").write.parquet(f"{root}/works")
    copy = sinks.backup_before(spark, root, ["works", "cases"])
    if sinks.backup_before(spark, root, ["works"]) is not None:
        raise ValueError("a backup without need")
    return spark.read.parquet(f"{copy}/works")


@query("""SELECT n_nationkey, n_name AS name_x, r_name AS name_y FROM nation JOIN region ON n_regionkey = r_regionkey""")
def profile_join(spark, sf):
    """An inner join many to one, with suffixes."""
    n = views.load(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    r = views.load(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return corpus.profile_join(n, r, "k").drop("k")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'machinery')")
def exact_scope(spark, sf):
    """scope by the raw value, not normalised: another case is another value."""
    c = views.load(spark, sf, "customer")
    return c.where(text.exactly("c_mktsegment", ["BUILDING", "machinery"])).select(F.col("c_custkey").alias("id"))


@query("""SELECT p_partkey AS id, contains(lower(p_name), 'widget') AS plain, contains(lower(p_brand), 'd#1') AS literal, regexp_matches(p_name, '^(cold|large) .*t$', 'i') AS pattern FROM part
WHERE contains(lower(p_name), 'widget') OR contains(lower(p_brand), 'd#1') OR regexp_matches(p_name, '^(cold|large) .*t$', 'i')""")
def column_containment(spark, sf):
    """a text or a regular expression inside a column, whatever the case."""
    p = views.load(spark, sf, "part")
    p = p.select(F.col("p_partkey").alias("id"), text.holds("p_name", "WIDGET").alias("plain"), text.holds("p_brand", "D#1").alias("literal"), text.holds("p_name", "^(Cold|Large) .*T$", True).alias("pattern"))
    return p.where("plain OR literal OR pattern")


@query("""SELECT o_orderkey AS id, CAST(greatest(1, round_even(o_custkey % 900 * 0.1, 0)) AS INTEGER) AS top_end, CAST(o_custkey % 900 - greatest(1, round_even(o_custkey % 900 * 0.1, 0)) AS INTEGER) AS bottom_begin FROM orders""")
def stamp_bands(spark, sf):
    """The rows of a picture where stamps stand."""
    h = (F.col("o_custkey") % 900).cast("int")
    return views.load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), images.stamp_bands(h).alias("_b")).select("id", "_b.*")


def _tiff(width: int, red: list[int], nir: list[int]) -> bytes:
    """A two-band, 16-bit, pixel-interleaved TIFF in one strip."""
    import struct

    pixels = struct.pack(f"<{2 * len(red)}H", *(x for pair in zip(red, nir) for x in pair))
    entries = [(256, 3, 1, width), (257, 3, 1, len(red) // width), (258, 3, 2, 16 | 16 << 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 2), (279, 4, 1, len(pixels)), (284, 3, 1, 1)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II" + struct.pack("<HI", 42, 8 + len(pixels)) + pixels + directory


@query("""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 10000) AS BIGINT)) AS v FROM embeddings)
SELECT id, 8 AS width, list_sum(v[1:32]) AS red, list_sum(v[33:64]) AS nir FROM e""")
def two_band_rasters(spark, sf):
    """Two-band rasters written as TIFF and read back (embeddings seen as 8 x 4 pixels of two bands)."""
    ship_package(spark)

    @F.pandas_udf("binary")
    def write(v: pd.Series) -> pd.Series:
        return pd.Series([_tiff(8, list(map(int, x[:32])), list(map(int, x[32:]))) for x in v])

    v = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 10000))
    files = views.load(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), write(v).alias("content"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x).cast("long")
    return corpus.raster_bands(files).select(F.col("path").cast("long").alias("id"), "width", add("red").alias("red"), add("nir").alias("nir"))


@query("""WITH s AS (SELECT user_id, event_id % 7 AS slot, ts, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS kind FROM events),
g AS (SELECT user_id || ':' || slot AS session, min(ts) FILTER (kind = 'start') AS a, min(ts) FILTER (kind = 'end') AS b FROM s GROUP BY 1)
SELECT session, round(epoch(b - a) / 3600.0, 4) AS hours FROM g WHERE b >= a""")
def review_sessions(spark, sf):
    """2.11, 2.15: explicit sessions from their start and end lines."""
    e = views.load(spark, sf, "events")
    name = F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 7).cast("string"))
    log = e.select(name.alias("session"), "ts", F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"))
    return sinks.review_sessions(log, "session", "ts", "kind").withColumn("hours", F.round("hours", 4))


@query("""SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 40 AS INTEGER)) AND user_id % 9 <> 0""")
def live_tokens(spark, sf):
    """2.11: uses of tokens that had not expired and were not revoked."""
    from ..streaming import streams

    e = views.load(spark, sf, "events")
    expires = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 40).cast("int")).cast("timestamp_ntz")
    used = e.select("event_id", "user_id", "ts", expires.alias("expires"))
    return streams.live_tokens(used, e.where("user_id % 9 = 0"), "user_id", "expires", "ts").select("event_id", "user_id")


@query("""SELECT CAST(count(*) AS BIGINT) AS actions, CAST(count(*) AS BIGINT) AS audited, CAST(count(*) AS BIGINT) AS ids, count(DISTINCT user_id) AS latest FROM events WHERE event_type = 'click'""")
def audited_upsert(spark, sf):
    """K7, K9, 2.15 POST: actions appended with an audit line and an id each; the latest of each key counts."""
    log, audit = graph.shared_folder(spark, "actions"), graph.shared_folder(spark, "audit")
    e = views.load(spark, sf, "events").where("event_type = 'click'").select("user_id", "ts", "event_id", "value")
    sinks.append_audited(e, log, audit, "reviewer")
    actions, lines = spark.read.parquet(log), spark.read.parquet(audit)
    counted = lines.agg(F.count(F.lit(1)).alias("audited"), F.count_distinct("audit_id").alias("ids"))
    latest = sinks.upsert_view(actions, ["user_id"], "ts").agg(F.count(F.lit(1)).alias("latest"))
    one = actions.agg(F.count(F.lit(1)).alias("actions"))
    return one.join(counted, F.lit(True)).join(latest, F.lit(True))  # one row each
