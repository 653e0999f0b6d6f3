"""Operators against brute force on small data."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from muniscope.llm import components as comp
from muniscope.llm import decontam, exact_dedup, html_extract, jaccard_join, license_scan, line_templates
from muniscope.llm import sentencepiece_codec as spc
from muniscope.llm import toxicity, warc


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(50)}"] * rng.randint(0, 2)
    return out


def corpus(seed, groups=25, hot=40):
    """Texts with near copies of many distances, a hot group and a passage that many share."""
    rng = random.Random(seed)
    shared = words(rng, 40)
    texts = []
    for g in range(groups):
        base = words(rng, rng.choice([1, 2, 3, 5, 12, 30, 80, 200, 500])) + (shared if rng.random() < 0.3 else [])
        for _ in range(hot if g == 0 else rng.randint(1, 4)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 1, 2, 4, 8]))))
    rng.shuffle(texts)
    return texts


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def linked_components(texts, size, p, q):
    sets = [sets_of(t, size) for t in texts]
    root = list(range(len(texts)))
    links = [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links[i] += 1
                links[j] += 1
    return [(len(s), find(i), links[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed,size,p,q,chunk", [(1, 3, 90, 100, 250_000), (2, 3, 90, 100, 300), (3, 5, 4, 5, 250_000), (4, 5, 4, 5, 400)])
def test_jaccard_components(spark, seed, size, p, q, chunk):
    texts = corpus(seed)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(d, size, p, q, chunk).collect()}
    assert [got[i] for i in range(len(texts))] == linked_components(texts, size, p, q)


def test_a_large_block_that_stays_disconnected(spark):
    """Texts that share most of their parts, so that one block of many chunks holds groups of all sizes."""
    rng = random.Random(3)
    base = words(rng, 300, 10_000)
    texts = []
    for g in range(12):
        mine = list(base)
        for _ in range(40):
            mine[rng.randrange(300)] = f"g{rng.randrange(1000)}"
        texts += [" ".join(edited(rng, mine, rng.choice([0, 1, 2, 6]))) for _ in range(rng.choice([1, 2, 9, 25]))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for chunk in (250_000, 2000):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(d, 5, 4, 5, chunk).collect()}
        assert [got[i] for i in range(len(texts))] == linked_components(texts, 5, 4, 5)


@pytest.mark.parametrize("seed", range(4))
def test_signature_tree_connects_what_is_linked(seed):
    rng = np.random.default_rng(seed)
    sim = jaccard_join.Similarity(4, 5)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, rng.integers(2, 300)).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(base.size) > 0.05], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for _ in range(4)]
    links = jaccard_join.link_group(sets, np.arange(len(sets)), sim)
    root = list(range(len(sets)))

    def find(r, i):
        return i if r[i] == i else find(r, r[i])

    for a, b in links:
        assert sim.linked(np.intersect1d(sets[a], sets[b]).size, sets[a].size, sets[b].size)
        root[find(root, a)] = find(root, b)
    for i in range(len(sets)):
        for j in range(i):
            if sim.linked(np.intersect1d(sets[i], sets[j]).size, sets[i].size, sets[j].size):
                assert find(root, i) == find(root, j)


def test_posts_guarantee():
    """Linked sets share as many posts of a common size class as either needs."""
    rng = np.random.default_rng(0)
    for p, q in ((90, 100), (4, 5)):
        sim = jaccard_join.Similarity(p, q)
        for n in [1, 2, 5, 9, 12, 13, 19, 40, 100, 101, 333, 900]:
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for mode in ("drop", "add", "swap"):
                k = 0
                while True:
                    y = x[k + 1 :] if mode == "drop" else np.append(x, rng.integers(0, 1 << 63, k + 1).astype(np.uint64)) if mode == "add" else np.append(x[k + 1 :], rng.integers(0, 1 << 63, k + 1).astype(np.uint64))
                    y = np.unique(y)
                    if not y.size or not sim.linked(np.intersect1d(x, y).size, x.size, y.size):
                        break
                    last, k = y, k + 1
                if k:
                    a, b = ({t: (need, set(v.tolist())) for t, need, v in sim.posts(s)} for s in (x, last))
                    assert any(len(a[t][1] & b[t][1]) >= max(a[t][0], b[t][0]) for t in a.keys() & b.keys())


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500 + i, 500) for i in range(30)]
    got = {r.node: r.root for r in comp.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k not in loops}


def test_suffix_array_and_search():
    rng = np.random.default_rng(4)
    for n, sigma in ((1, 1), (2, 1), (50, 2), (300, 3), (2000, 40)):
        text = rng.integers(0, sigma + 1, n)
        text[-1] = 0
        text[n // 3 : n // 2] = 1  # a long run
        text[-1] = 0
        suffixes, _ = decontam.suffix_array(text)
        zero = {int(p): k - n for k, p in enumerate(np.flatnonzero(text == 0))}
        key = lambda i: [zero.get(k, int(text[k])) for k in range(i, n)]
        assert suffixes.tolist() == sorted(range(n), key=key)
        index = decontam.FMIndex(text, sigma)
        patterns = [rng.integers(1, sigma + 1, rng.integers(1, 7)) for _ in range(60)] + [np.ones(6, dtype=int)]
        lengths = np.array([len(p) for p in patterns])
        rows = np.zeros((len(patterns), 6), dtype=np.int64)
        for r, p in zip(rows, patterns):
            r[6 - len(p) :] = p
        found = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(*index.search(rows, lengths))}
        for k, p in enumerate(patterns):
            want = [i for i in range(n - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert found.get(k, []) == want


def contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for d, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, body in items:
            b = cut(body)
            for k in range(max(1, len(b) - 12) if b else 0):
                window = b[k : k + 13]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(str(item))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("shard,block", [(1 << 20, 8 << 20), (200, 8 << 20), (1 << 20, 400)])
def test_decontamination(spark, monkeypatch, shard, block):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.choice([0, 1, 4, 12, 13, 14, 40]), 60))) for k in range(15)] + [(99, None)]
    docs = []
    for d in range(40):
        w = words(rng, rng.randint(0, 120), 60)
        if d % 3 == 0:
            body = (items[rng.randrange(15)][1] or "").upper().replace(" ", ", ")
            w[len(w) // 2 : len(w) // 2] = [body]
        docs.append((d, " ".join(w)))
    docs.append((40, None))
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    got = decontam.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == contamination(docs, items)
    text = dict(docs)
    for r in got:
        spans = list(zip(r.word_begins, r.word_ends))
        assert sum(b - a for a, b in spans) == r.n_hit and spans == sorted(spans)
        raw = (text[r.doc_id] or "").encode()
        assert sum(len(decontam.words_of(raw[a:b])) for a, b in zip(r.byte_begins, r.byte_ends)) == r.n_hit


def test_fingerprints_compose():
    rng = random.Random(3)
    data = rng.randbytes(5 * exact_dedup.CHUNK + 777)
    step = exact_dedup.CHUNK
    parts = [data[i : i + step] for i in range(0, len(data), step)]
    hashes = [(exact_dedup.chunk_hash(p), (len(p) + 1) // 2) for p in parts]

    def join(items):
        if len(items) == 1:
            return items[0]
        k = rng.randrange(1, len(items))
        (a, n), (b, m) = join(items[:k]), join(items[k:])
        return exact_dedup.combine(a, b, m), n + m

    for _ in range(5):  # any grouping gives the same
        h, _ = join(hashes)
        assert ((h[0] << 31 | h[1]), (h[2] << 31 | h[3])) == exact_dedup.fingerprint(data)
    p, r = exact_dedup.PRIMES[0], exact_dedup.BASES[0]
    small = data[:40]
    want = sum(int.from_bytes(small[2 * i : 2 * i + 2], "little") * pow(r, 19 - i, p) for i in range(20)) % p
    assert exact_dedup.chunk_hash(small)[0] == want


def test_fingerprint_clash_is_told_apart(spark, monkeypatch):
    """With fingerprints forced equal, the chunkwise comparison separates the texts."""
    def same(batch):
        sha = [hashlib.sha256(x.lower()).digest() for x in batch.column(2).to_pylist()]
        n = len(sha)
        return exact_dedup.record_batch(exact_dedup.FP_SCHEMA, batch.column(0), batch.column(1), [1] * n, [1] * n, [4] * n, sha)

    monkeypatch.setattr(exact_dedup, "_fingerprints", same)
    d = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "AAAA"), (4, "cccc")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(d).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def test_sentencepiece_matches_library_and_spans_tile(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spc.default_model())
    texts = ["", None, "Hello world", "  two  spaces ", "naïve café\n\ttab", "日本語 \U0001f600 \x00 x", "a" * 5000, "▁ ▁▁", "é" * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in spc.encode_documents(d, spc.default_model()).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        r = rows[i]
        assert list(r.ids) == sp.encode(t, add_eos=True)
        assert r.decoded == sp.decode(list(r.ids))
        raw = t.encode()
        assert "".join(raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(r.begins, r.ends)).encode("utf-8", "surrogateescape") == raw
    digest = {r.doc_id: r for r in spc.encode_digests(d, spc.default_model()).collect()}
    assert digest[2].ids_sha256 == hashlib.sha256(" ".join(map(str, rows[2].ids)).encode()).hexdigest()
    assert all(digest[i].spanned_bytes == len((t or "").encode()) for i, t in enumerate(texts))


def test_spans_agree_with_the_library():
    import sentencepiece

    c = spc.codec(spc.default_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=spc.default_model())
    text = "The quick brown fox, naïve café and  two spaces."
    pieces = sp.encode(text, return_type="proto").pieces
    begins, ends = c.spans(text.encode(), [p.id for p in pieces])
    assert list(zip(begins, ends)) == [(p.begin, p.end) for p in pieces]


def test_normaliser_with_a_compiled_map():
    """A hand-made trie: 'ab' -> 'x', 'abc' -> 'yz', the longest wins; space squeezing keeps alignment."""
    class Map:
        def longest(self, text, at):
            for key, new in ((b"abc", b"yz"), (b"ab", b"x")):
                if text.startswith(key, at):
                    return len(key), new

    n = spc.Normaliser(b"")
    n.map, n.squeeze, n.dummy_prefix, n.escape = Map(), True, True, True
    out, align = n.run(b"  abcab  q ")
    assert out.decode() == "▁yzx▁q"
    assert align.tolist() == [2, 2, 2, 2, 2, 5, 7, 7, 7, 9, 10]


def drain(docs):
    """The line-template rules, in loops."""
    lt = line_templates

    def support(n):
        return next(d for least, d in lt.SUPPORT if n >= least)

    def tokens(line):
        flat = re.sub(r"^ | $", "", re.sub(r"[ \t\r\f\x0b]+", " ", line))
        return tuple(lt.VARIABLE if re.search("[0-9]", t) else t for t in flat.split(" ")) if flat else ()

    spread = {}
    for k, (_, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            if t := tokens(line):
                spread.setdefault(t, set()).add(k)
    often = {}
    for t, where in spread.items():
        for i in range(lt.DEPTH, len(t)):
            key = (len(t), t[: lt.DEPTH], i, t[i])
            often[key] = often.get(key, 0) + len(where)
    stand, of = {}, {}
    for t, where in spread.items():
        later = [(i, x) for i, x in enumerate(t) if i >= lt.DEPTH and x != lt.VARIABLE]
        same = tuple(x for x in later if often[len(t), t[: lt.DEPTH], *x] >= support(len(t)))
        if 3 * (len(later) - len(same)) <= max(len(t) - lt.DEPTH - 1, 0):
            of[t] = (len(t), t[: lt.DEPTH], same)
            stand.setdefault(of[t], set()).update(where)
    good = {m for m, where in stand.items() if len(where) >= support(m[0])}
    return {d: "\n".join(x for x in (text or "").split("\n") if of.get(tokens(x)) not in good) for d, text in docs}


def test_line_templates(spark):
    rng = random.Random(8)
    docs = []
    for d in range(60):
        lines = [" ".join(words(rng, rng.randint(1, 12), 30)) for _ in range(rng.randint(0, 6))]
        if d % 2:
            lines.append(f"user {rng.choice(['ann', 'bob', 'eve'])} logged  in at 1{d}:30 ok")
        if d % 4 == 0:
            lines.insert(0, f"All rights are reserved by the owner of {rng.choice(['x', 'y'])}\t")
        if d % 3 == 0:
            lines.append("All rights reserved.")
        docs.append((d, "\n".join(lines)))
    long = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr")
    docs += [(60, None), (61, "head\n" + long), (62, long.replace("ck", "zz") + "\n \nx"), (63, long + " more")]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = drain(docs)
    assert got == want
    assert sum(len(t or "") for _, t in docs) > sum(map(len, want.values()))
    assert want[61] == "head" and want[63] and not any("All rights" in t or "logged" in t for t in want.values())


def test_a_leaf_holds_several_templates(spark):
    """Three templates of one token count and start; and two lines, none of which has the majority of its leaf."""
    forms = ["the page was written by {} for our many readers", "the page was moved there with {} and other things", "the page was not found in {} of these two"]
    docs = [(k, forms[k % 3].format("".join(chr(97 + int(c)) for c in str(1000 + k)))) for k in range(60)]
    docs += [(100 + k, "the page was seen by people " + " ".join("".join(chr(97 + int(c)) for c in str(7000 + 31 * k + j)) for j in range(4))) for k in range(200)]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[k] == 1 for k in range(60)) and not any(got[k] for k in range(100, 300))


def test_licenses_with_many_and_few_templates(monkeypatch):
    rng = random.Random(1)
    texts = {f"t{k}": " ".join(words(rng, n, 5000)) for k, n in enumerate([5, 6, 8, 9, 13, 20, 40, 70, 150, 300])}
    templates = license_scan.Templates.of(texts)
    hits = 0
    for trial in range(60):
        name = f"t{trial % 10}"
        body = texts[name].split()
        doc = words(rng, rng.randint(0, 200), 9000)
        at = rng.randint(0, len(doc))
        doc[at:at] = body
        text = " ".join(doc).encode()
        found = {f[0]: f for f in license_scan.scan(text, templates)}
        hits += name in found
        for n, share, begin, end in found.values():
            inside = set(license_scan.shingle_row(decontam.words_of(text))[begin : end - 4].tolist())
            assert math.isclose(share, len(inside & set(templates.sets[templates.names.index(n)].tolist())) / templates.sets[templates.names.index(n)].size)
        monkeypatch.setattr(license_scan, "FEW", 0)
        assert license_scan.scan(text, templates) == sorted(found.values())
        monkeypatch.setattr(license_scan, "FEW", 32)
    assert hits == 60


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for d in range(900):
        w = words(rng, rng.randint(20, 80), 200)
        toxic = d % 5 == 0
        if toxic:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["grumpf", "blarghen", "blarghte", "blargho", "snorp"]))
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    held = [d for d in range(900) if zlib.crc32(str(d).encode()) % 3 == 1]
    wrong = [d for d in held if (got[d] >= toxicity.THRESHOLD) != (d % 5 == 0)]
    assert len(held) > 200 and len(wrong) <= 3
    assert all(0 <= s <= 1 for s in got.values())
    assert "blar*" in model.lexicon
    # Labels of held-out rows are never seen.
    flipped = [(d, 1 - t if d in set(held) else t) for d, t in labels]
    again = toxicity.fit(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert again.lexicon == model.lexicon


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    s = rng.random(500)
    y = (rng.random(500) < s).astype(float)
    knots = toxicity.isotonic(s, y)
    assert (np.diff(knots[1]) > 0).all() and abs(np.interp(0.5, *knots) - 0.5) < 0.15
    x = rng.random((800, len(toxicity.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    t = toxicity.fit_trees(x[:600], y[:600])
    assert ((t.raw(x[600:]) > 0) == y[600:]).mean() > 0.9


def test_without_both_labels_scores_are_zero(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels in ([], [(2, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score_documents(docs, model).collect()] == [0.0, 0.0]


def test_loser_tree_is_a_merge():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_are_gzip_members_any_reader_takes(spark, tmp_path):
    import glob
    import gzip

    rows = [(i, f"http://www.Example.com:80/{i % 7}?q={i}#f", f"<p>page {i % 9}\r\n\r\nWARC/1.1") for i in range(100)]
    path = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    files = glob.glob(f"{path}/part-*")
    raw = b"".join(gzip.open(f).read() for f in files)
    assert raw.count(b"WARC-Record-ID: <urn:page:") == 100
    got = warc.merge_runs(warc.read_runs(spark, path)).collect()
    assert [(r.url_key, r.captured_at, r.page_id) for r in got] == sorted((r.url_key, r.captured_at, r.page_id) for r in got)
    assert sum(r.record_type == "response" for r in got) == 9
    for r in got:
        body = rows[r.page_id][2].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.base32_sha1(body))
    big = warc.member(b"x" * (1 << 24) + b"y")
    assert big[-1] == 0 and b"".join(c for _, c in warc.members(big)) == b"x" * (1 << 24) + b"y"
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example)/a?b"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><h1>T</h1><p>a &amp; b<br>c<p><b>d</p></article><footer>f</footer>", "T\na & b c\nd"),
        ("<nav><a href=x>m</a></nav><main><p>x</p><aside>s</aside><div class='comments'><p>c</p></div><p>y</main>", "x\ny"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><article><p>yes", "yes"),
        ("<article><header><h1>Title</h1></header><p>p</p><form>f<button>b</button></form></article>", "Title\np"),
        ("<article class='comment'><p>c</p></article><article><p>a</p></article>", "a"),
        ("<!-- <p>c</p> --><article>x<!-- y", "x"),
        ("plain words only", "plain words only"),
        ("", ""),
        ("<article><p>  a\n\t b &#65;&nbsp;</p></article>", "a b A"),
    ],
)
def test_extraction(page, want):
    assert html_extract.extract(page) == want


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in got.collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    all_docs = spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_documents(all_docs, toxicity.fit(all_docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    stay = {d: t for d, t in docs.items() if scores[d] < toxicity.THRESHOLD}
    best = {}
    for d, t in stay.items():
        key = "".join(c.lower() if c.isascii() else c for c in t or "")
        best[key] = max(d, best.get(key, -1))
    ids = sorted(best.values())
    near = linked_components([stay[d] for d in ids], 5, 4, 5)
    ids = [d for k, d in enumerate(ids) if near[k][1] == k]
    bad = contamination([(d, stay[d]) for d in ids], items)
    assert kept == {d for d in ids if not (bad[d][1] > 0 and 20 * bad[d][1] >= bad[d][0])}
