import datetime
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from muniscope.functions import amounts
from muniscope.operators import canonical, cases, forest, graph, injection, peers, quality, sampling, serving, similarity, vendors
from muniscope.sources import corpus, sinks
from muniscope.streaming import streams


def ladder_by_hand(rows, least=10):
    """Each row's z from lists of its peers."""
    out = []
    for c, p, v in rows:
        for keep in (lambda r: r[0] == c and r[1] == p, lambda r: r[0] == c, lambda r: True):
            group = [r[2] for r in rows if keep(r)]
            if len(group) >= least:
                break
        known = [x for x in group if x is not None]
        m = statistics.median(known)
        d = statistics.median(abs(x - m) for x in known)
        scale = 1.4826 * d if d > 0 else max(abs(m) * 0.1, 1)
        out.append(0.0 if v is None else (v - m) / scale)
    return out


def test_ladder_matches_lists(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice("xyz"), rng.choice([None, 5.0, rng.random() * 100])) for _ in range(60)] + [("c", "x", 1.0)] * 3
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, c string, p string, v double")
    got = {r.id: r.z for r in peers.ladder_z(d, "v", "c", "p").collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(ladder_by_hand(rows))


def test_low_values_never_flag(spark):
    d = spark.createDataFrame([(i, "a", "x", 100.0 + i) for i in range(12)] + [(99, "a", "x", 1.0)], "id int, c string, p string, v double")
    assert peers.ladder_z(d, "v", "c", "p").where(F.col("z") > peers.FLAG_Z).count() == 0


def test_average_rank_with_ties(spark):
    values = [3, 1, 1, 2, 3, 3, None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values) if v is not None], "id int, v int")
    got = {r.id: r.pct_rank for r in peers.average_rank(d, "v").collect()}
    assert got == pytest.approx({0: 5 / 6, 1: 1.5 / 6, 2: 1.5 / 6, 3: 3 / 6, 4: 5 / 6, 5: 5 / 6})


def test_merge_validation_and_lineage(spark):
    done = spark.createDataFrame([("1", "w1", "1010000.0", datetime.date(2024, 2, 1), "State1")], "record_id string, work_id string, actual_amount_raw string, actual_end_date date, state_name string")
    planned = spark.createDataFrame(
        [("1", "5 lakh", datetime.date(2024, 1, 11), None, "Sanction"), ("2", "7,00,000", datetime.date(2024, 3, 1), "State2", "Sanction")],
        "record_id string, sanction_amount_raw string, sanction_date date, state_name string, sanctioned_work_stage string",
    )
    m = canonical.outer_merge(done, planned, "record_id")
    got = {r.record_id: r for r in m.collect()}
    assert (got["1"].state_name, got["2"].state_name) == ("State1", "State2")
    assert [(got[k].has_first, got[k].has_second) for k in "12"] == [(True, True), (False, True)]
    issues = canonical.issue_list({"b": F.col("has_second"), "a": F.col("has_first")})
    assert {r.record_id: r.i for r in m.select("record_id", issues.alias("i")).collect()} == {"1": ["a", "b"], "2": ["b"]}
    with pytest.raises(ValueError):
        canonical.require_unique(done.union(done), "record_id")
    n = m.withColumn("sanction_amount", amounts.normalise_amount(F.col("sanction_amount_raw")).amount)
    trace = canonical.lineage(n, {"SANCTION_AMOUNT": ("sanction_amount_raw", "sanction_amount", "units")}, "planned", "v1").collect()
    assert sorted((r.work, r.raw_value, float(r.normalised_value)) for r in trace) == [("record:2", "7,00,000", 700000.0), ("w1", "5 lakh", 500000.0)]


def test_quality_alert_ids_are_stable_and_follow_the_value(spark):
    def frame(amount):
        return spark.createDataFrame([("1", "w1", amount)], "record_id string, work_id string, v double")

    def found(amount):
        rule = quality.Rule("amount_negative", "actual_amount", F.col("v") < 0, F.col("v"))
        return [r.id for r in quality.alerts(frame(amount), [rule]).collect()]

    assert found(-5.0) == found(-5.0) != found(-6.0)
    assert found(5.0) == []


def signals(spark, rows):
    return spark.createDataFrame(
        [(w, c, s, float(x), t, s != "unavailable", cases.CLUSTERS.get(c, c)) for w, c, s, x, t in rows],
        "work string, signal_code string, status string, score double, strength string, available boolean, cluster string",
    )


def test_case_rules(spark):
    s = signals(spark, [
        ("strong", "text_exact", "fired", 0.8, "strong"), ("strong", "cost_peer", "clear", 0, None),
        ("one_cluster", "cost_peer", "fired", 0.6, "medium"), ("one_cluster", "anomaly", "fired", 0.6, "medium"),
        ("two_clusters", "cost_peer", "fired", 0.6, "medium"), ("two_clusters", "photo_similar", "fired", 0.4, "medium"),
        ("late", "late_sanction", "fired", 1.0, "strong"), ("candidate", "photo_similar", "candidate_only", 0, None),
        ("blind", "text_exact", "unavailable", 0, None),
    ])
    over = spark.createDataFrame([("late", 100)], "work string, days_over int")
    got = {r.work: r for r in cases.consolidate(s, None, over).collect()}
    assert set(got) == {"strong", "two_clusters", "late"}
    assert got["strong"].evidence_completeness == 1.0
    assert (got["late"].review_tier, got["strong"].review_tier) == ("systemic_cohort", "actionable")
    assert got["two_clusters"].anomaly_priority == 1.0
    more = cases.consolidate(s, None, spark.createDataFrame([("late", 225)], "work string, days_over int"))
    assert {r.work: r.review_tier for r in more.collect()}["late"] == "actionable"


def test_case_ids_ignore_clear_signals(spark):
    base = [("w", "text_exact", "fired", 0.8, "strong")]
    a = cases.consolidate(signals(spark, base)).first().case_id
    b = cases.consolidate(signals(spark, [*base, ("w", "cost_peer", "clear", 0.1, None)])).first().case_id
    c = cases.consolidate(signals(spark, [("w", "text_exact", "fired", 0.5, "medium"), ("w", "cost_peer", "fired", 0.6, "medium")])).first().case_id
    assert a == b != c


@pytest.mark.parametrize("distance", [0, 3, 6])
def test_banded_hamming_is_brute_force(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 8))) for b in base for _ in range(3)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    d = spark.createDataFrame(list(enumerate(signed)), "id int, x long")
    got = {(r.a, r.b, r.distance) for r in similarity.hamming_pairs(d, "id", "x", distance).collect()}
    want = {(i, j, bin(values[i] ^ values[j]).count("1")) for i in range(len(values)) for j in range(i + 1, len(values))}
    assert got == {w for w in want if w[2] <= distance}


def test_text_bounds_lose_no_match(spark):
    import difflib

    rng = random.Random(2)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = base + [t[: max(1, len(t) - rng.randint(0, 4))] + rng.choice(["", "x", "yz"]) for t in base for _ in range(2)]
    d = spark.createDataFrame([(i, t, "g") for i, t in enumerate(texts)], "id int, t string, g string")
    got = {(r.a, r.b) for r in similarity.text_pairs(d, "id", "t", "g").collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    ids = sorted(first.values())
    want = {(i, j) for i in ids for j in ids if i < j and difflib.SequenceMatcher(None, texts[i], texts[j], autojunk=False).ratio() > 0.9}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_round_trips_meet_across_buckets(spark):
    day = datetime.date(2024, 1, 1)
    awards = spark.createDataFrame([(i, 1, day + datetime.timedelta(days=i), 100.0) for i in range(12)], "id int, party int, day date, amount double")
    pays = spark.createDataFrame([(i, 1, day + datetime.timedelta(days=i), 95.0) for i in range(25)], "id int, party int, day date, amount double")
    got = {(r.award, r.payment) for r in vendors.round_trips(awards, pays).collect()}
    assert got == {(a, p) for a in range(12) for p in range(25) if 2 <= p - a <= 10}


def test_scope_matrix(spark):
    d = spark.createDataFrame([("W1", "Orissa"), ("W2", "odisha "), ("W3", None), ("W4", "Goa")], "w string, s string")
    assert [r.w for r in d.where(serving.in_scope({"s": ["ODISHA"]})).orderBy("w").collect()] == ["W1", "W2"]
    assert d.where(serving.in_scope({})).count() == 4
    with pytest.raises(ValueError):
        serving.page(d, [F.col("w")], 0, 201)


def test_forest_finds_injected_outliers(spark):
    rng = random.Random(0)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(1000 + i, 12.0 + i, -15.0) for i in range(5)]
    got = forest.isolation_scores(spark.createDataFrame(rows, "id int, a double, b double"), "id", ["a", "b"]).collect()
    flagged = {r.id for r in got if r.flag}
    assert flagged >= {1000, 1001, 1002, 1003, 1004}
    assert len(flagged) <= 0.06 * len(rows)
    empty = forest.isolation_scores(spark.createDataFrame([], "id int, a double"), "id", ["a"])
    assert empty.count() == 0


def test_stratified_sample_is_even_and_repeats(spark):
    d = spark.range(300).withColumn("s", F.col("id") % 3)
    a = sampling.stratified(d, ["s"], "id", 30)
    assert {r.s: r["count"] for r in a.groupBy("s").count().collect()} == {0: 10, 1: 10, 2: 10}
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in sampling.stratified(d.repartition(7), ["s"], "id", 30).collect())


def test_injection_covers_every_pattern(spark):
    w = spark.createDataFrame(
        [(str(i), i % 3, i % 4, "road", 1000.0 + i, datetime.date(2023, 5, 1), datetime.date(2023, 9, 1), 2, "d") for i in range(30)],
        "id string, mp int, agency int, activity string, amount double, sanction_date date, end_date date, image_count int, description string",
    )
    got = injection.inject(w, 2)
    assert {r.pattern for r in got.select("pattern").distinct().collect()} == {None, *injection.PATTERNS}
    assert got.select("id").distinct().count() == got.count()


def test_snapshot_log_and_insert(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    path = str(tmp_path / "snap")
    assert sinks.write_snapshot(d, path, ["k"]) is True
    assert sinks.write_snapshot(d.orderBy(F.desc("k")), path, ["k"]) is False
    assert sinks.write_snapshot(d.limit(1), path, ["k"]) is True
    assert sinks.read_snapshot(spark, path).count() == 1
    assert sinks.drop_old_snapshots(spark, path, 1) == 1 and sinks.drop_old_snapshots(spark, path, 1) == 0
    assert sinks.read_snapshot(spark, path).count() == 1
    log = str(tmp_path / "log")
    assert sinks.insert_if_new(d, log, "k").count() >= 0
    sinks.insert_if_new(spark.createDataFrame([(2, "changed"), (3, "c")], "k int, v string"), log, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(log).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    both = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, t int")
    assert [tuple(r) for r in sinks.upsert_view(both, ["k"], "t").select("k", "v").collect()] == [(1, "new")]
    with pytest.raises(Exception):
        sinks.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "j"))


def test_csv_family_with_different_headers(spark, tmp_path):
    for folder, text in (("a", "K,X\n1,one\n"), ("b/c", "X,Z,K\ntwo,9,2\n")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "works.csv").write_text(text)
    (tmp_path / "other.csv").write_text("K\n3\n")
    d = corpus.csv_family(spark, str(tmp_path), "works.csv", ["K", "X", "Z"])
    assert sorted((r.K, r.X, r.Z) for r in d.collect()) == [("1", "one", None), ("2", "two", "9")]
    assert corpus.guarded(d, "K").count() == 2
    with pytest.raises(ValueError):
        corpus.guarded(d.union(d), "K")


def test_attachments_and_embedded_images(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0abc\xff\xd9"
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 " + jpeg + b" between " + jpeg + b" %%EOF")
    (tmp_path / "y.txt").write_text("no")
    files = corpus.attachments(spark, str(tmp_path))
    assert [r.name for r in files.collect()] == ["x.pdf"]
    assert [bytes(r.image) for r in corpus.embedded_images(files).collect()] == [jpeg, jpeg]
    assert files.select(corpus.pdf_failure()).first()[0] is None
    assert corpus.changed_since(files, files).count() == 0
    w = spark.createDataFrame([("w", "x.pdf; ../etc/passwd ;;z.jpg")], "id string, l string")
    names = corpus.references(w, "id", "l")
    assert sorted(r.name for r in names.collect()) == ["x.pdf", "z.jpg"]
    used, missing = sinks.referenced_only(files, names)
    assert [r.name for r in used.collect()] == ["x.pdf"] and [r.name for r in missing.collect()] == ["z.jpg"]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(5).write.parquet(source)

    def run():
        streams.run_batches(streams.file_stream(spark, source, "*.parquet", "id long"), streams.merge_new(out, "id"), mark)
        return spark.read.parquet(out).count()

    assert run() == 5
    spark.range(3, 8).write.mode("append").parquet(source)
    assert run() == 8


@pytest.mark.parametrize("n,block", [(0, 7), (1, 7), (60, 7), (300, 50), (300, 4096)])
def test_distances_of_all_pairs(spark, n, block):
    """Every pair once, copies and a hot value included, in one tile or many."""
    rng = np.random.default_rng(n)
    values = [int(v) for v in rng.integers(-(1 << 63), (1 << 63) - 1, n)]
    values = [values[0] if i % 3 == 0 else values[i % 90] ^ (1 << i % 62) if i % 3 == 1 else v for i, v in enumerate(values)]
    d = spark.createDataFrame([*enumerate(values), (None, 5), (n + 1, None)], "id long, x long")
    got = {r.distance: r.n for r in similarity.distance_histogram(d, "id", "x", block).collect()}
    want: dict = {}
    for i in range(n):
        for j in range(i):
            k = bin((values[i] ^ values[j]) & ((1 << 64) - 1)).count("1")
            want[k] = want.get(k, 0) + 1
    assert got == want and sum(got.values()) == n * (n - 1) // 2


def test_a_threshold_below_six(spark):
    """Two percent of the pairs within four bits, the rest far: the threshold is two, and only closer pairs are linked."""
    rng = np.random.default_rng(1)
    base = [int(v) for v in rng.integers(0, 1 << 62, 20)]
    values = [b ^ flip for b in base for flip in (0, 0b1111, 0b11)]
    d = spark.createDataFrame(list(enumerate(values)), "id long, x long")
    h = similarity.distance_histogram(d, "id", "x")
    assert similarity.adaptive_threshold(h).first().threshold == 2
    near = similarity.hash_pairs(d, "id", "x", 2)
    assert {(r.a, r.b) for r in near.collect()} == {(3 * k + i, 3 * k + 2) for k in range(20) for i in (0, 1)}


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.6])
def test_near_texts_equal_brute_force(spark, threshold):
    """Some hundred texts in a hot group and small ones: edited copies, tiny texts, a phrase that all share, equal texts."""
    import difflib

    rng = random.Random(int(threshold * 10))
    words = [w + c for w in "road drain school lamp bridge well hall pump".split() for c in "abcd"]
    rows, texts = [], []
    for i in range(260):
        if texts and rng.random() < 0.6:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choice("abcdé ")
            t = "".join(t)
        elif rng.random() < 0.3:
            t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
        else:
            t = "supply and laying of " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        texts.append(t)
        rows.append((i, t, rng.choice([1, 1, 1, 2]), rng.choice([2020, 2021])))
    d = spark.createDataFrame(rows, "id long, t string, mp int, year int")
    for across in (None, "year"):
        distinct: dict = {}
        for i, t, mp, year in rows:
            if t:
                distinct.setdefault((mp, t), []).append((i, year))
        want = set()
        for (mp, s), x in distinct.items():
            for (other, t), y in distinct.items():
                (i, j) = (min(x)[0], min(y)[0])
                if mp == other and i < j and (not across or len({k for _, k in x + y}) > 1):
                    ratio = difflib.SequenceMatcher(None, s, t, autojunk=False).ratio()
                    if ratio > threshold:
                        want.add((i, j, round(ratio, 9)))
        got = similarity.text_pairs(d, "id", "t", "mp", threshold, across)
        assert {(r.a, r.b, round(r.ratio, 9)) for r in got.collect()} == want and want


def test_trees_in_one_give_the_depths_of_each():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[:40, 1] = 0.5  # ties
    trees = [forest.grow(x[rng.choice(300, n)], rng) for n in (1, 2, 40, 256)]

    def walk(t, row):
        at = 0
        while t.feature[at] >= 0:
            at = t.left[at] if row[t.feature[at]] <= t.cut[at] else t.right[at]
        return t.length[at]

    got = forest.mean_depth(x, *forest.in_one(trees))
    assert got == pytest.approx([np.mean([walk(t, row) for t in trees]) for row in x])


def test_clean_up_takes_what_the_application_wrote(spark):
    import os

    d = graph.shared_table(spark.range(3), "some")
    folder = d.inputFiles()[0].split("/muniscope/")[0].removeprefix("file://") + "/muniscope/" + spark.sparkContext.applicationId
    assert os.listdir(folder)
    graph.clean_up(spark)
    assert not os.path.exists(folder)


def test_officials_of_a_page_of_vendors(spark):
    w = spark.createDataFrame([("v", 2, 1.0), ("v", 1, 2.0), ("v", 2, 3.0), ("u", 9, 1.0)], "vendor string, mp int, amount double")
    assert [tuple(r) for r in vendors.officials_of(w, w.where("vendor = 'v'")).collect()] == [("v", "1;2")]
