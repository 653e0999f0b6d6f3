"""Texts with very many lines or spans, phrases and templates in blocks, and the character map."""

import os
import random
import struct
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from muniscope.llm import decontam, license_scan, line_templates, sentencepiece_codec


def test_a_text_of_many_recurring_lines(spark):
    """Thousands of lines to drop in each text, some to keep, against a plain list; one text loses all of its lines."""
    lines = [f"this line number word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} comes again and again" for k in range(3000)]
    texts = {i: "\n".join(x for k, line in enumerate(lines) for x in ([line, f"own {'xyz'[k % 3] * (k % 7 + 1)} {i * 31 + k}q only here {'abc' * (i + 1)}{'d' * (k % 11)}"] if k % 500 == i else [line])) for i in range(12)}
    texts[20] = "\n".join(lines)
    texts[21] = lines[5] + "\nsomething else stands here"
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(d).collect()}
    gone = set(lines)
    for i, text in texts.items():
        kept = [x for x in text.split("\n") if x not in gone]
        assert (got[i].text, got[i].n_dropped) == ("\n".join(kept), len(text.split("\n")) - len(kept))
    assert got[20].text == "" and got[20].n_lines == 3000


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_of_blocks_unite(spark, monkeypatch, seed):
    """Many items in many blocks, whose spans overlap, touch and contain each other, equal one block's result."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(words[a : a + rng.randint(1, 20)])) for k in range(60) for a in [rng.randrange(280)]] + [(99, ""), (100, None)]
    rows = [(i, " ".join(rng.choice([" ".join(words[a : a + rng.randint(1, 60)]), "x y z"]) for a in [rng.randrange(280) for _ in range(rng.randint(0, 30))])) for i in range(40)]
    docs = spark.createDataFrame([*rows, (77, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    whole = sorted(map(repr, decontam.find_passages(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 600)
    blocks = list(decontam.item_blocks(bench))
    assert len(blocks) > 3 and all(sum(len(t) for _, t in b) <= 600 or len(b) == 1 for b in blocks)
    assert sorted((n, t.decode()) for b in blocks for n, t in b) == sorted((str(k), t or "") for k, t in items)
    assert sorted(map(repr, decontam.find_passages(docs, bench).collect())) == whole


def test_a_text_with_very_many_spans(spark, monkeypatch):
    n = 30_000
    text = " ".join(f"alpha{k % 5} beta{k % 5} gamma{k % 5} other" for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k}") for k in range(5)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    row = decontam.find_passages(docs, bench).first()
    assert (row.n_words, row.n_hit, len(row.word_begins), row.items) == (4 * n, 3 * n, n, ["0", "1", "2", "3", "4"])
    assert row.word_begins[-1] == 4 * (n - 1) and row.byte_ends[0] == len("alpha0 beta0 gamma0")


def partial_copies(seed, n=150):
    """Texts with parts of templates, near the border of containment, between other words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        out = []
        for name in rng.sample(sorted(license_scan.TEMPLATES), 2):
            w = license_scan.TEMPLATES[name].split()
            cut = round(len(w) * rng.uniform(0.7, 1.0))
            at = rng.randrange(len(w) - cut + 1)
            out += [f"n{rng.randrange(999)}" for _ in range(rng.randint(0, 200))] + w[at : at + cut]
        rows.append((i, " ".join(out)))
    return rows


def test_licenses_in_blocks_and_at_the_border(spark, monkeypatch):
    rows = partial_copies(3) + [(500, None), (501, ""), (501, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    columns = ["doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ";").alias("licenses"), F.coalesce(F.round(F.array_max("containment"), 6), F.lit(0.0)).alias("best_containment")]
    found = license_scan.scan_documents(docs, license_scan.TEMPLATES)
    whole = sorted(map(repr, found.collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    exact = {(i, name) for i, _, names, _ in con.execute(license_scan.OP7_SQL).fetchall() for name in names.split(";") if name}
    got = {(r.doc_id, name) for r in found.select(*columns).collect() for name in r.licenses.split(";") if name}
    assert got <= exact and len(got) >= 0.99 * len(exact) and 50 < len(exact) < 280  # a miss has a chance below 0.0001
    monkeypatch.setattr(license_scan, "MOST_TEMPLATE_WORDS", 100)
    blocks = license_scan.template_blocks(license_scan.TEMPLATES)
    assert len(blocks) > 2 and [n for b in blocks for n in b] == sorted(license_scan.TEMPLATES)
    assert sorted(map(repr, license_scan.scan_documents(docs, license_scan.TEMPLATES).collect())) == whole


def compiled_map(rules: dict[bytes, bytes]) -> bytes:
    """A double array of the keys and the table of their replacements, in the layout that models carry."""
    table, where = b"", {}
    for new in rules.values():
        where.setdefault(new, len(table))
        if where[new] == len(table):
            table += new + b"\0"
    trie: dict = {}
    for key, new in rules.items():
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[0] = where[new]
    units, used, bases = {0: 0}, {0}, set()
    todo = [(0, trie)]
    while todo:
        at, node = todo.pop(0)
        base = next(b for b in range(1, 1 << 20) if at ^ b not in bases and not used & {at ^ b ^ c for c in node})
        bases.add(at ^ base)  # a label tells the parent only where no two nodes have one base
        units[at] |= base << 10 | (0 in node) << 8
        for c, below in node.items():
            place = at ^ base ^ c
            used.add(place)
            if c == 0:
                units[place] = below | 1 << 31
            else:
                units[place] = c
                todo.append((place, below))
    size = (max(units) // 256 + 1) * 256
    return struct.pack(f"<I{size}I", 4 * size, *(units.get(i, 0) for i in range(size))) + table


RULES = {
    b"a": b"b", b"ab": b"<ab>", b"abcd": b"", b"abx": b"y", "é".encode(): b"e", "é".encode(): b"e", "ﬁ".encode(): b"fi", b"\t": b" ",
    "Ａ".encode(): b"A", "Ｂ".encode(): b"B", "　".encode(): b" ", b"zz": b"z", b"z": "ä".encode(), b"\xf0\x9f\x98\x80": b":-)",
}


def test_longest_prefixes_of_a_character_map():
    known = sentencepiece_codec.CharacterMap(compiled_map(RULES))
    rng = random.Random(4)
    pieces = [*RULES, b"c", b"d", b"x", b"abc", b" ", "́".encode(), b"\xc3", b"q"]
    for _ in range(300):
        text = b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        for at in range(len(text)):
            best = max((k for k in RULES if text.startswith(k, at)), key=len, default=None)
            assert known.longest(text, at) == (None if best is None else (len(best), RULES[best]))


def message(number: int, data: bytes) -> bytes:
    size, n = b"", len(data)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return bytes([number << 3 | 2]) + size + bytes([n]) + data


def test_encoding_through_a_character_map(spark, tmp_path):
    """A model with that map in the library and here: same ids, and every piece spans the bytes its letters came from."""
    import sentencepiece

    with open(sentencepiece_codec.default_model(), "rb") as f:
        model = f.read()
    rest = b"".join(message(k, v) for k, v in sentencepiece_codec._fields(model) if isinstance(v, bytes) and k != 3)
    spec = message(1, b"test") + message(2, compiled_map(RULES)) + bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1])
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(rest + message(3, spec))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    pieces = [k.decode() for k in RULES] + ["c", "word", " ", "  ", "the ", "é́", "x"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "   ", "Ａ Ｂ"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(d, path).collect()}
    for i, text in enumerate(texts):
        r, raw = got[i], text.encode()
        ids = library.encode(text, add_eos=True)
        assert list(r.ids) == ids and r.decoded == library.decode(ids)
        spans = list(zip(r.begins, r.ends))
        assert all(a <= b for a, b in spans) and [a for a, _ in spans] == sorted(a for a, _ in spans) and spans[-1][0] == spans[-1][1] <= len(raw)
        for k, (a, b) in zip(ids[:-1], spans):
            piece = library.id_to_piece(k).replace("▁", "")
            if piece and set(piece) <= set("cdhortw"):  # letters that the map leaves alone and makes of nothing
                assert piece in raw[a:b].decode().replace("abcd", "")  # what the map deletes goes with its neighbour


def test_runs_are_dealt_in_blocks_and_merged_in_order(spark, monkeypatch):
    """A third of the captures alike in all but their place: they fill several ranges, and no sort of captures is in the plan."""
    from muniscope.llm import warc

    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 7)
    rng = random.Random(6)
    runs = []
    for archive in range(9):
        rows = [("same", "2020", 5) if rng.random() < 0.33 else (f"u{rng.randrange(40)}", str(2000 + rng.randrange(30)), rng.choice([None, *range(9)])) for _ in range(rng.choice([1, 60, 300]))]
        rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
        runs += [(*r, 1, "d", "response", None, f"a{archive}", k) for k, r in enumerate(rows)]
    d = warc.materialise(spark.createDataFrame(runs, warc.CAPTURE_DDL).coalesce(1), "test-runs")
    merged = warc.merge_runs(d)
    got = [tuple(r) for r in merged.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, runs))
    keys = [warc._order(r) for r in got]
    assert keys == sorted(keys)
    parts = merged.withColumn("p", F.spark_partition_id()).where("url_key = 'same'").select("p").distinct().count()
    assert parts > 2
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "url_key" not in "".join(line for line in plan.split("\n") if "Sort " in line)


def test_a_written_table_leaves_no_shuffle_files(spark):
    """The jobs of materialise (and of shared_table) take their shuffle files with them, whatever the driver's garbage."""
    from muniscope.llm import common
    from muniscope.operators import graph

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def left():
        return {f for f in map(str, env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "/shuffle_" in f}

    before, setting = left(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    rows = spark.range(40_000).groupBy((F.col("id") % 20_011).alias("g")).agg(F.sum("id").alias("s"))
    for write in (common.materialise, graph.shared_table):
        assert write(rows, "test-shuffle").count() == 20_011
    for _ in range(50):  # files go a moment after the job; that of the count stays
        new = left() - before
        if len(new) <= 2 * 8:
            break
        time.sleep(0.1)
    sizes = [os.path.getsize(f) for f in new if f.endswith(".data") and os.path.exists(f)]
    assert sum(sizes) < 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
