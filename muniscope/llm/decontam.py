"""Benchmark decontamination with an FM-index per training shard.

Words are maximal runs of 0-9, a-z (after lower-casing A-Z) and characters beyond ASCII.
Each task cuts its documents into shards of about SHARD_WORDS words and indexes a shard's
words: a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet
matrix, and suffix positions at every SAMPLE-th text position. All test phrases are
searched backwards at once, one symbol of every still living phrase per step; the
rows of those found are located by walking to sampled positions. Occurrences are merged into
spans of words and of UTF-8 bytes for removal.

Words outside the phrases' vocabulary, and the ends of documents, are separators that
match nothing and differ from one another, so no occurrence crosses a document and the
doubling ends early.

The phrases are a stated query set, read item by item in blocks of at most BLOCK_BYTES of text (or
one item). A block is sent to the workers, which build its windows, searched against all
documents, its hits are written, and it is destroyed before the next one is read; what
several blocks found in a row is united by the row's key.

Other columns of a table are not read and may have any name; the pipeline stage passes them on as they are.

Defined results: null and empty texts have no words and no hits; an item without words
has no window; an item shorter than 13 words is one window; every row is judged by its own
text, whether its doc_id is null, repeated or its own; repeated item ids count once in a list, a null
one as the empty string; empty tables give empty results or documents without hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_arrow, discard, give_back, materialise, record_batch, row_keyed, shared_dir, table, utf8

WINDOW = 13
SHARD_WORDS = 1 << 18
SAMPLE = 8
BLOCK_BYTES = 4 << 20

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Phrases:
    """The distinct windows of some items, as symbol rows, with the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({name for name, _ in items})  # sorted as strings
        number = {x: i for i, x in enumerate(self.items)}
        rows, lengths, owners = [], [], []
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            if not ids.size:
                continue
            if ids.size >= window:
                mine = np.lib.stride_tricks.sliding_window_view(ids, window)
            else:
                mine = np.concatenate([np.zeros(window - ids.size, dtype=np.int32), ids])[None, :]
            rows.append(mine)
            lengths.append(np.full(len(mine), min(window, ids.size), dtype=np.int64))
            owners.append(np.full(len(mine), number[name], dtype=np.int64))
        every = np.concatenate(rows) if rows else np.zeros((0, window), dtype=np.int32)
        # Right-aligned rows of symbols above zero: equal rows have equal lengths.
        self.symbols, first, which = np.unique(every, axis=0, return_index=True, return_inverse=True)
        self.lengths = np.concatenate(lengths)[first] if rows else np.zeros(0, dtype=np.int64)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)]), axis=1) if rows else np.zeros((2, 0), dtype=np.int64)
        self.first = np.searchsorted(pairs[0], np.arange(len(self.symbols) + 1))
        self.owners = pairs[1]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse. Zeros are distinct separators, ordered by position;
    the last symbol must be one."""
    n = text.size
    zeros = np.flatnonzero(text == 0)
    first = text.astype(np.int64) + zeros.size
    first[zeros] = np.arange(zeros.size)
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(start, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(start, size)  # a group's rank is its first row
    active = order[np.repeat(size > 1, size)]
    step = 1
    while active.size:
        # A repeated suffix never holds the last separator, so active + step stays in the text.
        key = rank[active] << 32 | rank[active + step]
        by = np.argsort(key, kind="stable" if active.size < 64 else None)
        active, key = active[by], key[by]
        group = key >> 32
        new = np.concatenate([[True], key[1:] != key[:-1]])
        old = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(active.size)
        begin = at[new]
        offset = begin - np.maximum.accumulate(np.where(old, at, 0))[begin]
        size = np.diff(np.append(begin, active.size))
        rank[active] = np.repeat(group[begin] + offset, size)
        active = active[np.repeat(size > 1, size)]
        step *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank


class WaveletMatrix:
    """rank(symbol, i): how often the symbol stands before row i, for vectors of both."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        x = text.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            count = np.zeros(x.size + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(int(x.size - count[-1]))
            x = np.concatenate([x[~bit], x[bit]])
        every = np.arange(symbols + 1, dtype=np.int64)
        self.origin = self._descend(every, np.zeros(symbols + 1, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = ones[row].astype(np.int64)
            row = np.where(symbol >> level & 1, zeros + up, row - up)
        return row

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self._descend(symbol, row) - self.origin[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: symbols 1..symbols with 0 for separators, the last of them a separator."""
        suffixes, _ = suffix_array(text)
        before = np.where(suffixes > 0, suffixes - 1, text.size - 1)
        self.last = text[before]
        self.tree = WaveletMatrix(self.last, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        # Rows whose position is a multiple of SAMPLE or follows a separator: a walk never crosses one.
        marked = (suffixes % SAMPLE == 0) | (self.last == 0)
        self.marked = marked
        self.sample_of = np.cumsum(marked) - 1
        self.samples = suffixes[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high) of the patterns that occur; rows are right-aligned."""
        width = patterns.shape[1]
        live = np.flatnonzero(lengths > 0)
        low = np.zeros(live.size, dtype=np.int64)
        high = np.full(live.size, self.last.size, dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(width):
            c = patterns[live, width - 1 - step]
            low = self.first[c] + self.tree.rank(c, low)
            high = self.first[c] + self.tree.rank(c, high)
            found = low < high
            live, low, high = live[found], low[found], high[found]
            ended = lengths[live] == step + 1
            if ended.any():
                done.append((live[ended], low[ended], high[ended]))
                live, low, high = live[~ended], low[~ended], high[~ended]
            if not live.size:
                break
        if not done:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows = rows.copy()
        steps = np.zeros(rows.size, dtype=np.int64)
        going = np.flatnonzero(~self.marked[rows])
        while going.size:
            c = self.last[rows[going]]
            rows[going] = self.first[c] + self.tree.rank(c, rows[going])
            steps[going] += 1
            going = going[~self.marked[rows[going]]]
        return self.samples[self.sample_of[rows]] + steps


def merge_spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def search_shard(texts: list[list[int]], phrases: Phrases) -> list[tuple[np.ndarray, set[int]]]:
    """For each document (its symbols): a mask of hit words and the items found."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(int(starts[-1]), dtype=np.int64)
    for at, t in zip(starts, texts):
        text[at : at + len(t)] = t
    edge = np.zeros(text.size + 1, dtype=np.int32)
    items: list[set[int]] = [set() for _ in texts]
    if phrases.lengths.size and text.size:
        index = FMIndex(text, len(phrases.vocabulary))
        pattern, low, high = index.search(phrases.symbols, phrases.lengths)
        if pattern.size:
            count = high - low
            which = np.repeat(pattern, count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            at = index.locate(rows)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + phrases.lengths[which], -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            pairs = np.unique(doc * np.int64(phrases.lengths.size) + which)
            for d, p in zip((pairs // phrases.lengths.size).tolist(), (pairs % phrases.lengths.size).tolist()):
                items[d].update(phrases.owners[phrases.first[p] : phrases.first[p + 1]].tolist())
    hit = np.cumsum(edge[:-1]) > 0
    return [(hit[a : a + n], found) for a, n, found in zip(starts.tolist(), sizes.tolist(), items)]


SCHEMA = pa.schema(
    [("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]
    + [(c, pa.list_(pa.int64())) for c in ("word_begins", "word_ends", "byte_begins", "byte_ends")]
)
DDL = (
    "row long, n_words long, n_hit long, items array<string>, word_begins array<long>, word_ends array<long>, "
    "byte_begins array<long>, byte_ends array<long>"
)


def _rows(keys: list, raw: list[bytes], texts: list[np.ndarray], phrases: Phrases, all_rows: bool) -> pa.RecordBatch:
    out = []
    for key, text, symbols, (hit, items) in zip(keys, raw, texts, search_shard(texts, phrases), strict=True):
        begins, ends = merge_spans(hit)
        byte_begins, byte_ends = [], []
        if begins.size:
            spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_TABLE))]
            byte_begins = [spans[b][0] for b in begins]
            byte_ends = [spans[e - 1][1] for e in ends]
        elif not all_rows:
            continue
        names = [phrases.items[i] for i in sorted(items)]
        out.append((key, len(symbols), int(hit.sum()), names, begins, ends, byte_begins, byte_ends))
    return record_batch(SCHEMA, *zip(*out, strict=True)) if out else record_batch(SCHEMA, *[[]] * len(SCHEMA))


_built: list[tuple[bytes, Phrases]] = []  # the block this worker has windows of


def _phrases(items: list[tuple[str, bytes]], mark: bytes) -> Phrases:
    if not _built or _built[0][0] != mark:
        _built[:] = [(mark, Phrases(items))]
    return _built[0][1]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about BLOCK_BYTES of text at most, or of one item; at least one block.

    Tasks cut the items into blocks and write each to a folder of its own; the driver reads one after another."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8().alias("b"))
    total, most = items.agg(F.sum(F.length("b"))).first()[0] or 0, BLOCK_BYTES

    def cut(batches):
        task, block, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            marks = []
            for n in pc.binary_length(batch.column(1)).to_pylist():
                if size and size + n > most:
                    block, size = block + 1, 0
                size += n
                marks.append(f"{task}-{block}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], ["item", "b", "block"])

    bound_arrow(benchmark.sparkSession)
    path = shared_dir(benchmark.sparkSession, "decontam-items")
    parts = max(1, -(-total // most))
    items.repartition(parts).mapInArrow(cut, "item string, b binary, block string").write.partitionBy("block").parquet(path)
    if not total:  # no item has a word
        yield []
        return
    written = benchmark.sparkSession.read.schema("item string, b binary, block string").parquet(path)
    for (block,) in written.select("block").distinct().orderBy("block").collect():
        yield [(r.item, bytes(r.b)) for r in written.where(F.col("block") == block).select("item", "b").collect()]
    discard(written)


def _search_block(source: DataFrame, items: list[tuple[str, bytes]], all_rows: bool, k: int) -> DataFrame:
    """What one block finds in (row, _b), written to the shared folder."""
    spark = source.sparkSession
    mark = uuid.uuid4().bytes
    sent = spark.sparkContext.broadcast(items)  # BLOCK_BYTES of text at most, or one item

    def run(batches):
        from muniscope.llm.decontam import SHARD_WORDS, _phrases, _rows, words_of

        known = _phrases(sent.value, mark)
        get = known.vocabulary.get
        keys, raw, texts, held = [], [], [], 0
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols = [get(w, 0) for w in words_of(data)]
                keys.append(key)
                raw.append(data)
                texts.append(np.array(symbols, dtype=np.int32))
                held += len(symbols) + 1
                if held >= SHARD_WORDS:
                    yield _rows(keys, raw, texts, known, all_rows)
                    keys, raw, texts, held = [], [], [], 0
        if keys:
            yield _rows(keys, raw, texts, known, all_rows)
        give_back()

    bound_arrow(spark)
    found = materialise(source.mapInArrow(run, DDL), f"decontam-{k}")
    sent.destroy()
    return found


def _passages(source: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of (row, _b): n_words, n_hit, the items found and the merged spans to remove."""
    parts = [_search_block(source, items, k == 0, k) for k, items in enumerate(item_blocks(benchmark))]
    if len(parts) == 1:
        return parts[0]
    merged = materialise(_merge_blocks(parts), "decontam-merged")
    discard(*parts)
    return merged


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, the items found and the merged spans to remove."""
    keyed, key = row_keyed(docs)
    found = _passages(keyed.select(F.col(key).alias("row"), utf8().alias("_b")), benchmark)
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return found.join(ids, "row").select("doc_id", *found.columns[1:])


def _merge_blocks(parts: list[DataFrame]) -> DataFrame:
    """Unite what the blocks found in each row; a row's hits are bounded by its length."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    facts = both.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    ends = ["word_begins", "word_ends", "byte_begins", "byte_ends"]
    spans = both.select("row", F.explode(F.arrays_zip(*ends)).alias("s")).select("row", "s.*")
    # Spans in order of their begin; one that begins after all before it have ended starts a new one.
    order = Window.partitionBy("row").orderBy("word_begins", "word_ends")
    reach = F.max("word_ends").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((reach < F.col("word_begins")).cast("int"), F.lit(1))
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("row", "run").agg(*((F.min if c.endswith("begins") else F.max)(c).alias(c) for c in ends))
    lists = whole.groupBy("row").agg(F.sum(F.col("word_ends") - F.col("word_begins")).alias("n_hit"), F.sort_array(F.collect_list(F.struct(*ends))).alias("s"))
    none = F.array().cast("array<struct<word_begins:long,word_ends:long,byte_begins:long,byte_ends:long>>")
    merged = facts.join(lists, "row", "left").withColumn("s", F.coalesce("s", none))
    return merged.select("row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "items", *(F.col(f"s.{c}").alias(c) for c in ends))


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of whose words a twentieth or more are benchmark words go."""
    keyed, key = row_keyed(docs)
    found = _passages(keyed.select(F.col(key).alias("row"), utf8().alias("_b")), table(spark, sf_dir, "benchmark"))
    bad = found.where(contaminated()).select(F.col("row").alias(key))
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, pos, pos + least(len(w), 13) - 1), ' ') AS phrase
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS r(pos) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS phrase
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(pos) WHERE len(w) >= n
),
occ AS (SELECT spots.doc_id, spots.pos, spots.n, win.item_id FROM spots JOIN win ON spots.n = win.n AND spots.phrase = win.phrase),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT doc_id, pos, n FROM occ) o, unnest(range(pos, pos + n)) AS r(k) GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
