"""Streaming sources that resume, and state that ends."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from muniscope.sources import readers
from muniscope.streaming import streams


def test_waits_grow_and_the_last_error_is_raised():
    waits, calls = [], []

    def busy_twice():
        calls.append(1)
        if len(calls) == 1:
            raise readers.Busy(7)
        if len(calls) < 4:
            raise TimeoutError
        return "done"

    assert readers.with_retry(busy_twice, sleep=waits.append) == "done" and waits == [7, 4.0, 8.0]
    waits.clear()
    with pytest.raises(ConnectionError):
        readers.with_retry(lambda: (_ for _ in ()).throw(ConnectionError()), retries=2, sleep=waits.append)
    assert waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        readers.with_retry(lambda: int("x"), sleep=waits.append)


def test_rows_of_a_page():
    rows = [{"ID": 1, "A": "x"}, {"A": "total"}]
    assert readers.rows_of_page(json.dumps({"TotalWorks": json.dumps(rows)}), "ID") == rows[:1]
    assert readers.rows_of_page(json.dumps(rows), "ID") == rows[:1]
    assert readers.rows_of_page("{}", "ID") == []


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    pages, out, mark = (str(tmp_path / x) for x in ("pages", "out", "mark"))
    os.mkdir(pages)

    def page(k):
        with open(f"{pages}/page-{k:03d}", "w") as f:
            json.dump({"TotalWorks": json.dumps([{"ID": 10 * k + i, "A": None if i else "é"} for i in range(3)] + [{"A": "total"}])}, f)

    def run():
        streams.run_until_idle(readers.paged_records(spark, pages, "ID string, A string, B string", "ID", 2), out, mark)
        return sorted((int(r.ID), r.A, r.B) for r in spark.read.parquet(out).collect())

    want = lambda ks: [(10 * k + i, None if i else "é", None) for k in ks for i in range(3)]
    for k in range(3):
        page(k)
    assert run() == want(range(3)) == run()
    for k in range(3, 8):
        page(k)
    assert run() == want(range(8))
    assert len(os.listdir(f"{mark}/commits")) >= 4  # two pages a batch


def test_changed_files_come_again(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("files", "out", "mark"))
    os.makedirs(f"{folder}/deep")

    def put(name, text, at):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{folder}/{name}", ns=(at * 10**9, at * 10**9))

    def run():
        streams.run_until_idle(readers.changed_files(spark, folder), out, mark)
        return sorted((os.path.basename(r.path), bytes(r.content).decode()) for r in spark.read.parquet(out).collect())

    put("a.jpg", "one", 1000)
    put("deep/b.PDF", "two", 1001)
    put("notes.txt", "no", 1002)
    assert run() == [("a.jpg", "one"), ("b.PDF", "two")] == run()
    put("a.jpg", "one more", 1003)
    put("c.png", "three", 1001)  # of the very time that was read last
    put("d.png", "four", 1003)
    assert run() == [("a.jpg", "one"), ("a.jpg", "one more"), ("b.PDF", "two"), ("c.png", "three"), ("d.png", "four")]
    put("e.png", "five", 1003)
    assert ("e.png", "five") in run()
    put("f.png", "six", 500)  # older than all
    assert len(run()) == 7 and ("f.png", "six") in run()


def batches(spark, folder, rows, parts):
    """rows (item, key, second, kind) as files of a folder, one a batch, then one row that lets all time pass."""
    cuts = [len(rows) * k // parts for k in range(parts + 1)]
    for part in [*(rows[a:b] for a, b in zip(cuts, cuts[1:])), [(-1, None, 10**7, "end")]]:
        d = spark.createDataFrame(part, "item long, key long, second long, kind string")
        d.select("item", "key", F.timestamp_seconds("second").alias("at"), "kind").coalesce(1).write.mode("append").parquet(folder)
    s = streams.file_stream(spark, folder, "*.parquet", "item long, key long, at timestamp, kind string", files_per_trigger=1)
    return s.withWatermark("at", "10 seconds")


def test_tokens_end_with_their_timers(spark, tmp_path):
    rng = random.Random(7)
    rows, second = [], 1000
    for i in range(400):
        second += rng.choice([0, 1, 5, 40])
        rows.append((i, rng.randrange(5), second, rng.choice(["issue", "use", "use", "use", "revoke"])))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    streams.run_available(streams.token_uses(batches(spark, str(tmp_path / "in"), rows, 3), "key", "item", "at", "kind", 60), out, mark)
    ends, want = {}, {}
    for item, key, second, kind in rows:
        if kind == "issue":
            ends[key] = second + 60
        elif kind == "revoke":
            ends.pop(key, None)
        else:
            want[item] = second < ends.get(key, -1)
    assert {r.item: r.live for r in spark.read.parquet(out).collect()} == want and len(set(want.values())) == 2
    assert streams.state_rows(spark, mark, "ends") == 0


def test_attempts_are_forgotten_after_their_window(spark, tmp_path):
    rng = random.Random(8)
    rows, second = [], 1000
    for i in range(300):
        second += rng.choice([0, 0, 1, 30, 90])
        rows.append((i, rng.randrange(3), second, "x"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    streams.run_available(streams.sliding_attempts(batches(spark, str(tmp_path / "in"), rows, 3), "key", "item", "at", 300, 10), out, mark)
    want = {i: sum(k == key and s >= at - 300 and (s, j) <= (at, i) for j, k, s, _ in rows) for i, key, at, _ in rows}
    got = {r.item: (r.attempts, r.limited) for r in spark.read.parquet(out).where("key IS NOT NULL").collect()}
    assert got == {i: (n, n >= 10) for i, n in want.items()} and any(n >= 10 for n in want.values())
    assert streams.state_rows(spark, mark, "times") <= 1  # the row that let time pass
