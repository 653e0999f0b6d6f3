"""Sources, sinks, pictures, quantiles and streams beyond what the registered queries show."""

import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from muniscope.functions import images
from muniscope.operators import quantiles, similarity
from muniscope.sources import corpus, sinks
from muniscope.streaming import streams


def test_sql_table_in_ranges(spark):
    url = "jdbc:derby:memory:muniscope;create=true"
    d = spark.createDataFrame([(k, f"n{k}") for k in range(50)], "id int, name string")
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    d.write.jdbc(url, "works", mode="overwrite", properties=props)
    got = corpus.sql_table(spark, url, "works", props, "id", 4)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in d.collect())
    assert corpus.sql_table(spark, url, "works", props).count() == 50


def test_profile_join_checks_its_side(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        corpus.profile_join(d, d, "k")


def test_blank_filled_checks_its_key(spark):
    d = spark.createDataFrame([("1", None), (None, "x")], "k string, v string")
    assert corpus.blank_filled(d.limit(1), "k").first().v == ""
    with pytest.raises(ValueError):
        corpus.blank_filled(d, "k").collect()


def test_snapshot_readers_see_a_whole_version(spark, tmp_path):
    path = str(tmp_path / "s")
    d = spark.range(5).toDF("k")
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, path)
    sinks.write_snapshot(d, path, ["k"])
    old = sinks.read_snapshot(spark, path)
    sinks.write_snapshot(d.where("k > 2"), path, ["k"])
    assert old.count() == 5 and sinks.read_snapshot(spark, path).count() == 2


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0, 5.0, 1.0, 9.0], list(np.random.default_rng(1).integers(0, 40, 301).astype(float))])
def test_percentiles_are_exact(spark, values):
    d = spark.createDataFrame(pd.DataFrame({"g": "x", "v": values})).repartition(7)
    got = quantiles.grouped_percentiles(d, "v", ["g"], {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}).first()
    assert np.allclose(list(got)[1:], np.quantile(values, [0, 0.05, 0.5, 0.95, 1]))
    assert quantiles.grouped_medians(d, "v", ["g"], "m").first().m == np.median(values)


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert quantiles.grouped_percentiles(none, "v", [], {"a": 0.5}).collect() in ([], [(None,)])
    assert quantiles.upper_median(none, "v", "m").collect() == []


def test_hash_pairs_name_copies_once(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(12)]
    values = base + base[:4] * 3 + [b ^ (1 << k) for k, b in enumerate(base[:6])]
    d = spark.createDataFrame(list(enumerate(values)), "id int, x long")
    got = sorted(tuple(r) for r in similarity.hash_pairs(d, "id", "x", 2).collect())
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    reps = sorted(first.values())
    want = [(i, j, (values[i] ^ values[j]).bit_count()) for i in reps for j in reps if i < j and (values[i] ^ values[j]).bit_count() <= 2]
    want += [(first[v], i, 0) for i, v in enumerate(values) if first[v] != i]
    assert got == sorted(want)
    hist = {r.distance: r.n for r in similarity.distance_histogram(d, "id", "x", 100).collect()}
    assert sum(hist.values()) == len(values) * (len(values) - 1) // 2


def test_bands_of_the_threshold_keep_candidates_few(spark):
    """Seven bands of random 64-bit values meet in less than a twentieth of all pairs."""
    rng = np.random.default_rng(0)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, 1500)
    edges = [round(i * 64 / 7) for i in range(8)]
    met = 0
    for lo, hi in zip(edges, edges[1:]):
        part = (x.view(np.uint64) >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        _, n = np.unique(part, return_counts=True)
        met += int((n * (n - 1) // 2).sum())
    assert met < 0.05 * 1500 * 1499 / 2


def test_text_pairs_across_years(spark):
    rows = [(1, "road to the school", "m", 2020), (2, "road to the schools", "m", 2020), (3, "road to the school!", "m", 2021), (4, "road to the school", "n", 2021)]
    d = spark.createDataFrame(rows, "id int, t string, g string, y int")
    assert {(r.a, r.b) for r in similarity.text_pairs(d, "id", "t", "g", across="y").collect()} == {(1, 3), (2, 3)}
    assert {(r.a, r.b) for r in similarity.text_pairs(d, "id", "t", "g").collect()} == {(1, 2), (1, 3), (2, 3)}


def test_photo_groups(spark):
    rows = [("a", "w1", 1, 200, 200), ("a", "w2", 2, 200, 200), ("a", "w2", 3, 200, 200), ("b", "w1", 1, 100, 200), ("b", "w3", 2, 100, 200), ("c", "w9", 1, 500, 500)]
    d = spark.createDataFrame(rows, "md5 string, work string, seq int, width int, height int")
    assert sorted(tuple(r) for r in similarity.identical_photos(d).collect()) == [("a", "w1", "w1"), ("a", "w1", "w2")]
    assert [tuple(r) for r in similarity.stamp_groups(d).collect()] == [("b", 2)]


def scene(seed):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(30, 225, (32, 32)), np.ones((8, 8))) + rng.normal(0, 2, (256, 256))


def test_a_shifted_and_turned_picture_is_confirmed():
    one = scene(1)
    assert images._confirms(images.compare(one, np.roll(one, (5, -7), (0, 1)) * 0.8 + 20))
    assert images._confirms(images.compare(one, one[2:-2, 3:-3]))
    assert not images._confirms(images.compare(one, scene(2)))
    assert images.compare(np.full((200, 200), 7.0), one)[3] < 10


def test_pictures_that_are_none_have_null_counts(spark):
    d = spark.createDataFrame([(None, 4, [1.0] * 16, 4), ([1.0] * 15, 4, [1.0] * 16, 4), ([1.0] * 16, 4, [1.0] * 16, 4)], "a array<float>, n int, b array<float>, m int")
    got = [r.c for r in d.select(images.compare_pictures("a", "n", "b", "m").alias("c")).collect()]
    assert [r.good for r in got] == [None, None, 0] and got[2].keypoints == 0


def test_tiff_layouts():
    red, nir = np.arange(12, dtype="<f4").reshape(3, 4), np.arange(12, 24, dtype="<f4").reshape(3, 4)
    for planar in (1, 2):
        raw = (np.stack([red, nir], axis=2) if planar == 1 else np.stack([red, nir])).tobytes()
        half = len(raw) // 2
        tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 2, 32 | 32 << 16), (259, 3, 1, 1), (273, 4, 2, 8), (277, 3, 1, 2), (279, 4, 2, 16), (284, 3, 1, planar), (339, 3, 2, 3 | 3 << 16)]
        head = struct.pack("<II", 24, 24 + half) + struct.pack("<II", half, half)
        body = b"II" + struct.pack("<HI", 42, 24 + len(raw)) + head + raw
        data = body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        got = corpus.tiff_bands(data)
        assert (got[0] == red).all() and (got[1] == nir).all()
    for bad in (b"", b"II", b"PK..", b"II" + struct.pack("<HI", 42, 4000)):
        with pytest.raises((ValueError, struct.error)):
            corpus.tiff_bands(bad)


def test_sliding_attempts_over_batches(spark, tmp_path):
    rows = [(k, 1, 30 * k) for k in range(15)] + [(100, 2, 0), (101, 2, 301)]
    at = F.timestamp_seconds("s").alias("at")
    src = str(tmp_path / "in")
    for part in (rows[:8], rows[8:]):
        spark.createDataFrame(part, "event_id long, user_id long, s long").select("event_id", "user_id", at).coalesce(1).write.mode("append").parquet(src)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = streams.file_stream(spark, src, "*.parquet", "event_id long, user_id long, at timestamp", 1)
    streams.run_available(streams.sliding_attempts(stream, "user_id", "event_id", "at", 300, 10), out, mark)
    got = {r.event_id: (r.attempts, r.limited) for r in spark.read.parquet(out).collect()}
    want = {k: sum(1 for _, v, t in rows[: k + 1] if v == 1 and 30 * k - 300 <= t) for k in range(15)}
    assert {k: got[k][0] for k in range(15)} == want and got[100][0] == got[101][0] == 1
    assert [k for k in range(15) if got[k][1]] == [k for k in range(15) if want[k] >= 10]


def test_live_tokens_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 5, 9), (2, "b", 5, 5), (3, "c", 5, 9)], "use long, token string, at long, expires long").write.parquet(src)
    revoked = spark.createDataFrame([("c",), ("c",)], "token string")
    stream = streams.file_stream(spark, src, "*.parquet", "use long, token string, at long, expires long")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    streams.run_available(streams.live_tokens(stream, revoked, "token", "expires", "at"), out, mark)
    assert [r.use for r in spark.read.parquet(out).collect()] == [1]


def test_sql_table_without_a_server(spark, tmp_path, monkeypatch):
    """Where executors are other processes, the database is a file that they share; ranges lose no row, and nulls stay."""
    from muniscope.plans import source_queries

    path = f"file://{tmp_path}/new/works.sqlite"
    d = spark.createDataFrame([(k, f"n{k}" if k % 5 else None, k / 4 if k % 3 else None) for k in range(-20, 400, 3)], "id long, name string, balance double")
    corpus.write_sqlite(d, path, "works", "id")
    got = corpus.sqlite_table(spark, path, "works", d.schema, "id", 4)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, d.collect()), key=lambda r: r[0])
    assert corpus.sqlite_table(spark, path, "works", d.schema, "id", 4, "balance > 50").count() == d.where("balance > 50").count()
    corpus.write_sqlite(d.where("false"), f"{tmp_path}/none.sqlite", "works", "id")
    assert corpus.sqlite_table(spark, f"{tmp_path}/none.sqlite", "works", d.schema, "id").count() == 0
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, source_queries.sql_table_scan(spark, sf).collect()))
    monkeypatch.setattr(source_queries, "_database", lambda spark: None)
    assert sorted(map(tuple, source_queries.sql_table_scan(spark, sf).collect())) == want and want
