"""Exact deduplication by composable polynomial fingerprints.

A text's normalised UTF-8 bytes (A-Z lower-cased, nothing else) are cut into chunks
of 128 KiB. Each chunk is hashed independently as a polynomial over its 16-bit symbols,
modulo four primes; the hashes of neighbouring chunks combine by length-shifted
arithmetic, ``H(xy) = H(x) * r**len(y) + H(y)``, so chunks can be hashed in any grouping.
Those of a text above HUGE bytes are dealt to all tasks and their hashes combined
afterwards; a shorter text is hashed where it is read. The byte length is part of the fingerprint.

Rows with equal fingerprints are only candidates: their texts are compared chunk by
chunk. The comparison groups (fingerprint, chunk number, chunk) with a map-side combine,
so a group holding a third of all rows moves one copy of each chunk per task. Should two
different chunks ever meet under one fingerprint, that fingerprint's rows are regrouped
by SHA-256 of the text.

Other columns of a table are not read and may have any name; the pipeline stage passes them on as they are.

Defined results: null text counts as empty; empty texts are equal to each other; of a group
the row with the largest doc_id stays, rows without a doc_id only where the group has no other;
of several such rows (same id and text) one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_groups, map_rows, materialise, record_batch, row_keyed, table, utf8

CHUNK = 1 << 17  # bytes, an even number
HUGE = 1 << 22
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525, 22695477, 134775813)

_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers r**(n-1) ... r**0 for a whole chunk, by prime; built once in each worker."""
    if not _powers:
        n = CHUNK // 2
        for p, r in zip(PRIMES, BASES, strict=True):
            up = np.ones(1, dtype=np.uint64)
            step = r
            while up.size < n:  # doubling: up[k:2k] = up[:k] * r**k
                up = np.concatenate([up, up * np.uint64(step) % np.uint64(p)])
                step = step * step % p
            _powers.append(up[:n][::-1].copy())
    return _powers


def chunk_hash(data: bytes) -> tuple[int, ...]:
    """The hashes of one chunk (at most CHUNK bytes; an odd length gets one zero byte)."""
    x = np.frombuffer(data if len(data) % 2 == 0 else data + b"\0", dtype="<u2").astype(np.uint64)
    n = x.size
    return tuple(int(np.dot(x, t[t.size - n :])) % p for t, p in zip(_tables(), PRIMES, strict=True))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_symbols: int) -> tuple[int, ...]:
    """The hashes of a concatenation from those of its parts."""
    return tuple(
        (a * pow(r, right_symbols, p) + b) % p for a, b, r, p in zip(left, right, BASES, PRIMES, strict=True)
    )


def _packed(h: tuple[int, ...]) -> tuple[int, int]:
    return (h[0] << 31 | h[1]), (h[2] << 31 | h[3])


def fingerprint(data: bytes) -> tuple[int, int]:
    """Two longs for normalised bytes; the caller keeps the length beside them."""
    h = chunk_hash(data[:CHUNK])
    for at in range(CHUNK, len(data), CHUNK):
        part = data[at : at + CHUNK]
        h = combine(h, chunk_hash(part), (len(part) + 1) // 2)
    return _packed(h)


FP_SCHEMA = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "fp_hi", "fp_lo", "n_bytes")] + [("sha", pa.binary())])
FP_DDL = "row long, doc_id long, fp_hi long, fp_lo long, n_bytes long, sha binary"
PART_SCHEMA = pa.schema([("row", pa.int64()), ("no", pa.int64()), ("symbols", pa.int64()), ("h", pa.list_(pa.int64()))])
CHUNK_SCHEMA = pa.schema([(c, pa.int64()) for c in ("fp_hi", "fp_lo", "n_bytes", "chunk_no")] + [("chunk", pa.binary())])


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    hi, lo, size, sha = [], [], [], []
    for raw in batch.column(2).to_pylist():
        data = raw.lower()  # bytes.lower() changes A-Z only
        a, b = fingerprint(data)
        hi.append(a)
        lo.append(b)
        size.append(len(data))
        sha.append(hashlib.sha256(data).digest())
    return record_batch(FP_SCHEMA, batch.column(0), batch.column(1), hi, lo, size, sha)


def _part_hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = [p.lower() for p in batch.column(2).to_pylist()]
    hashes = [chunk_hash(p) for p in parts]
    return record_batch(PART_SCHEMA, batch.column(0), batch.column(1), [(len(p) + 1) // 2 for p in parts], hashes)


def _combined(batch: pa.RecordBatch) -> pa.RecordBatch:
    hi, lo = [], []
    for parts in batch.column(4).to_pylist():
        h = tuple(parts[0]["h"])
        for p in parts[1:]:
            h = combine(h, tuple(p["h"]), p["symbols"])
        a, b = _packed(h)
        hi.append(a)
        lo.append(b)
    return record_batch(FP_SCHEMA, batch.column(0), batch.column(1), hi, lo, batch.column(2), batch.column(3))


def _normal(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def fingerprints(source: DataFrame) -> DataFrame:
    """(row, doc_id, fp_hi, fp_lo, n_bytes, sha) per row of (row, doc_id, text)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    whole = source.where(size <= HUGE).select("row", "doc_id", utf8().alias("_b"))
    huge = source.where(size > HUGE)
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.length("_b") - 1) / CHUNK))
    parts = huge.select("row", utf8().alias("_b")).select("row", F.explode(starts).alias("no"), "_b")
    parts = parts.select("row", "no", F.expr(f"substring(_b, cast(no * {CHUNK} + 1 as int), {CHUNK})").alias("part"))
    hashed = map_rows(parts.repartition("row", "no"), _part_hashes, "row long, no long, symbols long, h array<long>")
    per_row = hashed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "symbols", "h"))).alias("parts"))
    facts = huge.select("row", "doc_id", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2(_normal().cast("binary"), 256)).alias("sha"))
    joined = facts.join(per_row, "row").select("row", "doc_id", "n", "sha", "parts")
    return map_rows(whole, _fingerprints, FP_DDL).unionByName(map_rows(joined, _combined, FP_DDL))


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    hi, lo, size, text = (batch.column(i).to_pylist() for i in range(4))
    rows: list[tuple] = []
    held = 0
    for a, b, n, raw in zip(hi, lo, size, text, strict=True):
        data = raw.lower()
        for k in range(0, max(len(data), 1), CHUNK):
            rows.append((a, b, n, k // CHUNK, data[k : k + CHUNK]))
            held += min(CHUNK, len(data) - k)
            if held > 8 << 20:
                yield record_batch(CHUNK_SCHEMA, *zip(*rows, strict=True))
                rows, held = [], 0
    if rows:
        yield record_batch(CHUNK_SCHEMA, *zip(*rows, strict=True))


KEY = ["fp_hi", "fp_lo", "n_bytes"]


def conflicting(source: DataFrame, marked: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Fingerprints under which chunkwise comparison finds different texts."""
    several = groups.where("group_size > 1").select(*KEY, "group_size")
    members = join_groups(marked.select("row", *KEY), several, KEY, "group_size", total).select("row", *KEY)
    texts = source.select("row", utf8().alias("_b")).join(members, "row").select(*KEY, "_b")
    chunks = map_rows(texts, _chunks, "fp_hi long, fp_lo long, n_bytes long, chunk_no long, chunk binary")
    distinct = chunks.groupBy(*KEY, "chunk_no", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    return distinct.groupBy(*KEY, "chunk_no").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(*KEY).distinct()


def _judged(source: DataFrame) -> DataFrame:
    """(row, doc_id, keep_id, keep_row, group_size, sha) per row of (row, doc_id, text)."""
    marked = materialise(fingerprints(source), "exact-fp")
    total = marked.count()
    first = F.max(F.struct("doc_id", "row"))  # a null doc_id is the least
    keep = [first.getField("doc_id").alias("keep_id"), first.getField("row").alias("keep_row"), F.count(F.lit(1)).alias("group_size")]
    groups = materialise(marked.groupBy(*KEY).agg(*keep), "exact-groups")
    clash = materialise(conflicting(source, marked, groups, total), "exact-clash")
    judged = join_groups(marked, groups.join(clash, KEY, "left_anti"), KEY, "group_size", total)
    odd = marked.join(clash, KEY, "left_semi")
    odd = odd.join(odd.groupBy(*KEY, "sha").agg(*keep), [*KEY, "sha"])
    columns = ["row", "doc_id", "keep_id", "keep_row", "group_size", "sha"]
    return judged.select(*columns).unionByName(odd.select(*columns))


def _source(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    keyed, key = row_keyed(docs)
    return keyed, keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), key


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    _, source, _ = _source(docs)
    return _judged(source).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row stays, that with the largest doc_id."""
    keyed, source, key = _source(docs)
    gone = materialise(_judged(source).where("row <> keep_row").select(F.col("row").alias(key)), "exact-gone")
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


OP8_SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
), n AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS place FROM t)
SELECT n.doc_id, g.keep_id, g.group_size, n.place = 1 AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
