"""Ring shards, spelling variants and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from muniscope.llm import periodic_runs, ring_shards, spelling_variants

SF = "/root/testdata/sf0.001"
CLASH = "h row arc at part rank shift home shard slot low high word n key r letter rest p best runs collapsed _text size".split()
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "la la la la la la"), (6, "é é é é é é é É"), (7, "x y x y"),
    (8, " ".join(f"word{i % 97} and{i % 13}" for i in range(30_000))), (9, "a " * 3_000), (10, "b" * 50_000), (10, "b" * 50_000),
    (None, "no id"), (None, None), (11, "la la la la la la"),
]


def with_clash(d):
    return d.withColumns({c: F.lit("clash") for c in CLASH})


# --- periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            part = w[i : i + length]
            if j > i and length >= max(6, 4 * q) and all(part[:-d] != part[d:] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def repeated(rng):
    w = []
    for _ in range(rng.randint(1, 5)):
        base = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 7))]
        w += (base * rng.randint(1, 8))[: rng.randint(1, 60)]
    return w


def test_refinement_finds_every_run():
    rng = random.Random(13)
    for _ in range(1500):
        w = repeated(rng)
        assert sorted(periodic_runs.refine(w), key=lambda r: (r[0], r[2])) == brute_runs(w)
        assert periodic_runs.runs_of([b"%d" % x for x in w]) == brute_runs(w)


@pytest.mark.parametrize("word", [lambda i: 0, lambda i: i % 5000, lambda i: (i * i) % 7, lambda i: bin(i).count("1") % 2])
def test_long_sequences_take_little_time(word):
    import time

    took = []
    for n in (20_000, 80_000):
        w = [word(i) for i in range(n)]
        begin = time.process_time()
        periodic_runs.refine(w)
        took.append(time.process_time() - begin)
    assert took[1] < 12 * took[0] + 0.5  # far from the square, 16 times


def test_periodic_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in repeated(rng))) for i in range(12, 500)] + ROWS
    with_clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = Counter(brute_row(*r) for r in rows if r[0] != 8)
    assert Counter(tuple(r) for r in got.collect() if r.doc_id != 8) == want
    (long,) = [r for r in got.collect() if r.doc_id == 8]
    assert (long.start, long.length, long.period) == brute_row(*ROWS[7])[2:5] if zlib.crc32(b"8") % 10 == 0 else (long.n_runs, long.period) == (1, 2 * 97 * 13)


def test_periodic_query_on_a_table(spark):
    got = {tuple(r) for r in periodic_runs.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [(d, t) for d, t in docs if len(t or "") < 8000]
    assert {brute_row(*r) for r in short} <= got and len(docs) == len(got)


def test_periodic_runs_keep_columns_and_take_empty_tables(spark):
    d = with_clash(spark.createDataFrame(ROWS, "doc_id long, text string"))
    got = periodic_runs.periodic_runs(d)
    assert got.count() == len(ROWS) and periodic_runs.periodic_runs(d.limit(0)).count() == 0
    assert {r["word"] for r in got.select("word").collect()} == {"clash"}
    row = got.where("doc_id = 5").first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)] and bytes(row.collapsed) == b"la"


# --- ring shards


def check_rows_law(got, rows, shards):
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    counts = [len(per[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    facts = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((d, *facts(t)) for d, t in rows) == Counter((r.doc_id, r.size, r.text_crc32) for r in got)


@pytest.mark.parametrize("hot", [0, 400])
def test_counts_are_at_most_one_apart(spark, hot):
    rows = [(i, f"text {i % 300}") for i in range(1, 700)] + [(1000 + i, "a very common text") for i in range(hot)] + ROWS
    d = with_clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(6)
    check_rows_law(ring_shards.ring_shards(d, 16, 64).collect(), rows, 16)
    few = spark.createDataFrame(rows[:5], "doc_id long, text string")
    check_rows_law(ring_shards.ring_shards(few, 16, 64).collect(), rows[:5], 16)
    assert ring_shards.ring_shards(d.limit(0)).count() == 0


def naive_flow(counts, owner, room):
    """Row by row: a row of an arc asks the shards of the places clockwise, all rows for one place before any for the next."""
    filled = [0] * len(room)
    waiting = [(a, i) for a, n in enumerate(counts) for i in range(n)]
    out, step = {}, 0
    while waiting:
        left = []
        for a, i in waiting:
            k = owner[(a + step) % len(owner)]
            if filled[k] < room[k]:
                out[a, i] = (k, filled[k])
                filled[k] += 1
            else:
                left.append((a, i))
        waiting, step = left, step + 1
    return out


def test_flow_is_that_of_single_rows():
    rng = random.Random(11)
    for _ in range(200):
        shards = rng.randint(1, 6)
        owner = np.array([rng.randrange(shards) for _ in range(rng.randint(1, 30))] + list(range(shards)))
        counts = np.array([rng.choice([0, 0, 1, 2, 50]) for _ in owner])
        slack = rng.choice([0.0, 0.0, 0.1, 0.5])
        room = ring_shards.capacities(int(counts.sum()), shards, slack)
        got = {(a, i): (k, slot + i - low) for a, low, high, k, slot in ring_shards.flow(counts, owner, room) for i in range(low, high)}
        assert got == naive_flow(counts.tolist(), owner.tolist(), room)


def test_a_further_shard_moves_few_rows_and_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 2}") for i in range(20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    before = {r.doc_id: r for r in ring_shards.ring_shards(d, 16).collect()}
    after = {r.doc_id: r.shard for r in ring_shards.ring_shards(d, 17).collect()}
    home = {r.doc_id: r.home for r in ring_shards.ring_shards(d, 17).collect()}
    assert all(home[i] in (before[i].home, 16) for i in home)  # the ring alone gives rows to the new shard only
    assert sum(before[i].shard != after[i] for i in after) < 0.12 * len(rows)  # 1/17 is 0.059
    assert sum(r.home != r.shard for r in before.values()) < 0.04 * len(rows)
    assert sum(before[i].shard != before[i + 1].shard for i in range(0, 20_000, 2)) <= 64
    loose = ring_shards.ring_shards(d, 16, slack=0.5).collect()
    assert all(r.home == r.shard for r in loose)


def test_shards_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = ring_shards.op11_ring_shards(spark, SF)
    check_rows_law(got.collect(), rows, 16)
    assert {(r.law, r.grown_shard) for r in got.collect()} == {("rows", None)}


# --- spelling variants


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(count):
    near = {w: [x for x in count if is_near(w, x)] for w in count}
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), count[w], len(near[w]), count[form[w]] if form[w] else None) for w in count}


def variant_rows(seed):
    rng = random.Random(seed)
    letters = "abcdeéÉ×Q"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 8, 9, 12]))) for _ in range(12)]
    words = list(base)
    for _ in range(260):
        w = list(rng.choice(words))
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 2)
        words.append("".join(w))
    anagrams = ["".join(rng.sample("abcdefg", 7)) for _ in range(150)] + ["aabbccdd", "abbccdd", "aabbccd", "aabccdd"]
    rows = [(i, " ".join(f"{w}, {w}." for w in rng.sample(words, 6) + rng.sample(anagrams, 4) + [rng.choice(base)] * rng.choice([1, 1, 40]))) for i in range(250)]
    return rows + [(900, "q" * 200 + " " + "q" * 200), (901, "q" * 201), (902, "q" * 201 + " " + "q" * 100 + "r" + "q" * 100), (903, "q" * 100 + "r" + "q" * 100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, tmp_path, seed):
    rows = variant_rows(seed) + ROWS
    with_clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling_variants.op12_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(brute_words(rows))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(f for _, f, *_ in want) and max(x[4] for x in want) > 3


def test_chains_of_forms_and_ties(spark):
    chain = [("abcdefg" + "h" * i, 10**i) for i in range(8)] + [("zyxwvut", 1), ("zyxwvua", 30), ("zyxwvub", 30)]
    words = spark.createDataFrame([(w, 2 * n) for w, n in chain], "word string, n long")
    got = {r.word: r for r in spelling_variants.spelling_variants(words).collect()}
    assert all(got[w].root == "abcdefg" + "h" * 7 for w, _ in chain[:8])
    assert (got["zyxwvut"].form, got["zyxwvut"].n_near, got["zyxwvua"].form) == ("zyxwvua", 2, None)


def test_a_large_group_of_anagrams_is_not_compared_pair_by_pair(spark):
    rng = random.Random(4)
    words = list({"".join(rng.sample("abcdefghi", 9)) for _ in range(3000)}) + ["abcdefgh", "bbcdefghi"]
    d = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {r.word: r.n_near for r in spelling_variants.near_words(d).select("word", "n_near").collect()}
    want = {w: n for w in words if (n := sum(is_near(w, x) for x in words[-2:]) + (sum(is_near(w, x) for x in words[:-2]) if w in words[-2:] else 0))}
    assert got == want


def test_variants_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling_variants.op12_spelling_variants(spark, str(tmp_path)).count() == 0


def test_variants_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling_variants.op12_spelling_variants(spark, SF).collect()}
    count = brute_words(rows)
    assert {(r[0], r[3]) for r in got} == set(count.items())
    if len(count) < 4000:
        assert got == brute_variants(count)
