"""Cases in which an operator once did less than the whole job."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from muniscope.llm import decontam, exact_dedup, jaccard_join, sentencepiece_codec, toxicity


@pytest.mark.parametrize(
    "p,q,n,m,common,seeds", [(90, 100, 67, 74, 67, (2169, 2987, 4683, 4807, 7136)), (4, 5, 25, 28, 24, (530, 579, 1865, 1998, 2843))]
)
def test_posts_meet_the_need_of_either_kind_of_partner(p, q, n, m, common, seeds):
    """One set posts its strong parts only, the other all; the seeds once lost their link."""
    sim = jaccard_join.Similarity(p, q)

    def met(x, y):
        a, b = ({t: (need, set(v.tolist())) for t, need, v in sim.posts(s)} for s in (x, y))
        return any(len(a[t][1] & b[t][1]) >= max(a[t][0], b[t][0]) for t in a.keys() & b.keys())

    for seed in seeds:
        x = np.random.default_rng(seed).integers(0, 1 << 63, n + m - common).astype(np.uint64)
        assert met(np.sort(x[:n]), np.sort(x[n - common :]))


@pytest.mark.parametrize("p,q", [(90, 100), (4, 5)])
def test_posts_of_random_pairs_at_the_threshold(p, q):
    rng = np.random.default_rng(5)
    sim = jaccard_join.Similarity(p, q)
    for _ in range(4000):
        n = int(rng.integers(20, 121))
        common = int(rng.integers(-(-n * p // q), n + 1))
        m = q * common // p + common - n  # the largest partner that is still linked
        x = rng.integers(0, 1 << 63, n + m - common).astype(np.uint64)
        a, b = ({t: (need, set(v.tolist())) for t, need, v in sim.posts(s)} for s in (np.sort(x[:n]), np.sort(x[n - common :])))
        assert sim.linked(common, n, m) and any(len(a[t][1] & b[t][1]) >= max(a[t][0], b[t][0]) for t in a.keys() & b.keys())


def test_decontamination_in_blocks_keeps_rows_without_unique_ids(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k}") for k in range(9)], "item_id long, text string")
    rows = [(1, "alpha1 beta1 gamma1 x"), (1, "y z alpha2 beta2 gamma2"), (1, "y"), (None, "alpha3 beta3 gamma3"), (None, None), (None, "clean"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(repr, decontam.find_passages(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    assert len(whole) == len(rows) and sorted(map(repr, decontam.find_passages(docs, items).collect())) == whole


LONG = " ".join(f"w{k}" for k in range(60))
#: Ids that are null, repeated with one text and repeated with other texts.
ROWS = [
    (1, "a b"), (2, "A B"), (None, "a B"), (None, "C d\u00c9"), (None, "c d\u00c9"), (None, None), (None, ""),
    (3, "b b b"), (3, "c c c"), (4, "C c c"), (5, LONG), (5, LONG), (6, LONG + " x"), (6, "alone"), (None, LONG + " y"),
]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_stages_judge_rows_and_not_ids(spark):
    """Each stage against the list of rows that must stay, by row, whatever the ids."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    groups = {}
    for k, (i, t) in enumerate(ROWS):
        groups.setdefault((t or "").lower(), []).append((-1 if i is None else i, k))
    want = sorted(max(g)[1] for g in groups.values())
    got = rows_of(exact_dedup.drop_copies(spark, docs, ""))
    assert len(got) == len(want) and [g.lower() for g in got] == sorted(repr(ROWS[k]).lower() for k in want)
    exact = [ROWS[k] for k in want]
    near = rows_of(jaccard_join.drop_near_copies(spark, spark.createDataFrame(exact, "doc_id long, text string"), ""))
    assert near == sorted(repr(r) for r in exact if not (r[1] or "").startswith("w0") or r == (5, LONG))


def test_contaminated_rows_go_by_row(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k}") for k in range(9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "alpha1 beta1 gamma1 x"), (1, "clean"), (None, "alpha3 beta3 gamma3"), (None, "clean too"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 20, 40):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        assert rows_of(decontam.drop_contaminated(spark, docs, str(tmp_path))) == sorted(repr(rows[k]) for k in (1, 3, 4, 5))


def test_toxic_rows_go_by_row(spark, monkeypatch):
    rows = [(1, "bad"), (1, "fine"), (None, "bad"), (None, None), (2, "fine")]
    one = toxicity.Trees([np.zeros(7, dtype=np.int64)], [np.full(7, 1.5)], [np.array([-1.0, 0, 0, 0, 0, 0, 0, 1.0])])
    model = toxicity.Model({"bad": 3.0}, one, (np.array([-1.0, 1.0]), np.array([0.0, 1.0])))
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: model)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'k' AS label", "*", "array(1, null) AS score")
    got = toxicity.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    assert rows_of(got.select("doc_id", "text")) == sorted(repr(r) for r in rows if r[1] != "bad")


def test_chunks_of_a_huge_text_combine_to_its_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HUGE", 1000)
    monkeypatch.setattr(exact_dedup, "CHUNK", 64)
    monkeypatch.setattr(exact_dedup, "_powers", [])
    texts = ["\u00c9a" * 700, "short", "\u00c9A" * 700, "x" * 1001, None, "\u00e9a" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("doc_id", F.col("row"))
    got = {r.row: (r.fp_hi, r.fp_lo, r.n_bytes, bytes(r.sha)) for r in exact_dedup.fingerprints(docs).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode().lower()
        assert got[k] == (*exact_dedup.fingerprint(data), len(data), hashlib.sha256(data).digest())
    assert got[0] == got[2] != got[5]


def test_of_tied_rows_one_is_kept(spark):
    d = spark.createDataFrame([(1, "a"), (1, "A"), (1, "a"), (None, "b"), (None, "b"), (0, "a")], "doc_id long, text string")
    got = exact_dedup.exact_groups(d).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 2, False), (0, 2, True), *[(1, 4, False)] * 3, (1, 4, True)]


def test_bytes_that_are_no_text_are_encoded_and_spanned(spark):
    raw = [b"good \xff\xfe text", b"\xe2\x82", b"caf\xc3\xa9 \xc3", "fine \u00e9".encode()]
    d = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(raw)], "doc_id long, b binary")
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(d.selectExpr("doc_id", "CAST(b AS STRING) AS text")).collect()}
    for k, b in enumerate(raw):
        spans = list(zip(got[k].begins, got[k].ends))
        assert got[k].decoded == sentencepiece_codec.repaired(b)[0]
        assert b"".join(b[x:y] for x, y in spans) == b or b"\xff" in b or b"\xe2" in b or b.endswith(b"\xc3")
        assert all(0 <= x <= y <= len(b) for x, y in spans) and spans[-1] == (len(b), len(b))
