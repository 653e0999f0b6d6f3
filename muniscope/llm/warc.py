"""WARC archives: writing, reading back, and one ordered index over all captures.

Writing: each row is a WARC/1.1 record with an HTTP response as its block, in a gzip member of
its own. Of equal payloads the row with the largest page_id is the response; the others are
revisits that name it and carry headers only. Archives are written by Spark's text writer,
whose atomic commit and retry they inherit: a member's last byte is zero as long as a record is
under 16 MiB, so that byte is the line separator and the file holds the members alone (a
larger record is followed by an empty member). TIERS bounds the records of a file by their size,
so that a file holds 256 MiB of payload, or one page. Payloads are equal when their SHA-256 is: SHA-1
alone, which records carry, can be made to collide.

Reading: each archive file is parsed member by member, digests are verified, and its captures
are sorted by URL key and timestamp: a run. Ranges of (URL key, timestamp, page_id, place in the archives) are cut at keys
of a sample, SAMPLED for each range of about RANGE_ROWS captures - a URL captured very often spans several ranges. Each run is cut where
ranges end, and its pieces travel as blocks of sorted rows, packed: no capture is sorted again. A range
holds its packed blocks; a loser tree merges the k runs of them, one block of each unpacked at a time, so the index
as a whole is ordered.

Other columns of a table are not read and may have any name.

Defined results: null html is an empty payload, equal to other empty ones; of rows that repeat both
page_id and payload one is the response where that page is; a null url has no target, a null page_id is named
None and sorts first; an empty table writes no record and gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow, give_back, join_groups, map_rows, materialise, record_batch, row_keyed, shared_dir, table, utf8

#: (largest payload in bytes, records in a file)
TIERS = ((1 << 18, 1_000), (1 << 23, 32), (1 << 62, 1))
RANGE_ROWS = 100_000
EPOCH = datetime(2024, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, lower case, no www, port 80/443 or fragment."""
    parts = urlsplit(url.strip())
    host = (parts.hostname or "").removeprefix("www.")
    key = ",".join(reversed(host.split("."))) if host else ""
    try:
        port = parts.port
    except ValueError:
        port = None
    if port and port not in (80, 443):
        key += f":{port}"
    path = parts.path or "/"
    return f"{key}){path}" + (f"?{parts.query}" if parts.query else "")


def _key(url: str | None) -> str:
    try:
        return url_key(url or "")
    except ValueError:  # brackets that are no address
        return url or ""


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, revisit: bool | None = None
) -> bytes:
    """One WARC record; a revisit when it is said to be one or response_id is given."""
    revisit = response_id is not None if revisit is None else revisit
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    when = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {when}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response_id}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member, or two, that end in a zero byte."""
    def pack(x: bytes) -> bytes:
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    packed = pack(data)
    return packed if packed[-1] == 0 else packed + pack(b"")


def members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of an archive."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        begin, d, parts = at, zlib.decompressobj(31), []
        while not d.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError(f"archive ends inside the member at {begin}")
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield begin, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    return fields, rest[:n]


def _page(value: str) -> int | None:
    name = value.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "None" else int(name)


def _order(row: tuple) -> tuple:
    """URL key, timestamp, page_id; a null page_id first."""
    return row[0], row[1], -(1 << 63) if row[2] is None else row[2]


def _place(row: tuple) -> tuple:
    """The same, then the place in the archives: captures that are alike in all else may go to several ranges."""
    return *_order(row), row[7], row[8]


class LoserTree:
    """k-way merge: losers stay at inner nodes, the winner is replayed along one path."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.k = max(1, len(runs))
        self.runs = [iter(r) for r in runs] or [iter(())]
        self.key = key
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k  # None: exhausted, loses to all
        for i in range(self.k):
            self._pull(i)
        self.tree = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _pull(self, i: int) -> None:
        self.heads[i] = head = next(self.runs[i], None)
        self.keys[i] = None if head is None else (self.key(head), i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return self.keys[a] < self.keys[b]

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.tree[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.keys[self.winner] is not None:
            yield self.heads[self.winner]
            i = self.winner
            self._pull(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.winner = i


RECORDS = pa.schema([("value", pa.binary())])
CAPTURES = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured_at", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("archive", pa.string()),
        ("offset", pa.int64()),
    ]
)
CAPTURE_DDL = (
    "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, offset long"
)


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives with a record per row of (page_id, url, html), under ``path``."""
    keyed, key = row_keyed(pages, "page_id")
    source = keyed.select(
        F.col(key).alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("_b")
    )
    digests = materialise(source.select("row", "page_id", F.sha2("_b", 256).alias("_d"), F.length("_b").alias("_n")), "warc-digests")
    total = digests.count()
    last = F.max(F.struct("page_id", "row"))  # a null page_id is the least
    groups = digests.groupBy("_d").agg(last.alias("_keep"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    members = join_groups(digests.select("row", "_d"), materialise(groups, "warc-groups"), ["_d"], "_copies", total)
    revisits = members.where("row <> _keep.row").select("row", F.lit(True).alias("_again"), F.col("_keep.page_id").alias("_keep"))
    revisits = materialise(revisits, "warc-revisits")

    def records(batch):
        out = []
        for page_id, url, payload, again, keep_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.append(member(record(page_id, url, payload, base32_sha1(payload), keep_id, bool(again)))[:-1])
        return record_batch(RECORDS, out)

    low = -1
    sizes = digests.agg(*(F.count_if((F.col("_n") > a) & (F.col("_n") <= b)) for a, b in zip([-1, *(t[0] for t in TIERS)], [t[0] for t in TIERS])))
    for (high, most), n in zip(TIERS, sizes.first()):
        if n or low < 0:  # the first tier makes the folder, records or not
            mine = source.where((F.length("_b") > low) & (F.length("_b") <= high)).join(revisits, "row", "left")
            made = map_rows(mine.select("page_id", "url", "_b", "_again", "_keep"), records, "value binary")
            lines = made.select(F.col("value").cast("string").alias("value"))
            lines.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", most).text(path)
        low = high


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of every archive, those of one archive together and sorted."""

    def run(batch):
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = []
            for offset, content in members(data):
                if not content:
                    continue
                head, block = parse(content)
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                length = int(http.rpartition(b"Content-Length: ")[2])
                kind = head["warc-type"]
                if kind == "response" and (len(payload), base32_sha1(payload)) != (length, digest):
                    raise ValueError(f"payload of {head['warc-record-id']} is not what its digest says")
                refers = _page(head["warc-refers-to"]) if kind == "revisit" else None
                key = _key(head.get("warc-target-uri"))
                when, page = head["warc-date"], _page(head["warc-record-id"])
                found.append((key, when, page, length, digest, kind, refers, name, offset))
            found.sort(key=_order)
            for at in range(0, len(found), 10_000):
                yield record_batch(CAPTURES, *zip(*found[at : at + 10_000], strict=True))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_rows(files, run, CAPTURE_DDL)


#: Keys looked at to place the end of a range, and rows in a block.
SAMPLED, BLOCK_ROWS = 20, 2_000


def range_ends(captures: DataFrame, total: int, ranges: int) -> list[tuple]:
    """The first keys of all ranges but the first, from about SAMPLED keys a range."""
    every = max(1, total // (SAMPLED * ranges))
    chosen = captures.where(F.pmod(F.xxhash64("archive", "offset"), F.lit(every)) == 0)
    keys = sorted(_place(tuple(r)) for r in chosen.collect())
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CAPTURES) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


BLOCKS = pa.schema([("range", pa.int32()), ("run", pa.string()), ("no", pa.int64()), ("block", pa.binary())])


def merge_runs(captures: DataFrame) -> DataFrame:
    """All captures ordered by (url_key, captured_at, page_id) across and within partitions.

    captures: sorted runs, the rows of each together, as read_runs gives them. What one task reads of an
    archive is a run."""
    spark = captures.sparkSession
    total = captures.count()
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    ends = range_ends(captures, total, ranges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=CAPTURES)
            keys = [_place(row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            names = batch.column(7).to_pylist()
            out: list[tuple] = []
            at = 0
            while at < len(keys):
                part = bisect.bisect_right(ends, keys[at])
                name, end = names[at], at + 1
                while end < len(keys) and end - at < BLOCK_ROWS and names[end] == name and (part == len(ends) or keys[end] < ends[part]):
                    end += 1
                no += 1
                out.append((part, f"{name}#{task}", no, _packed(batch.slice(at, end - at))))
                at = end
            yield record_batch(BLOCKS, *zip(*out, strict=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[bytes]] = {}
        for batch in batches:
            for run, block in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                runs.setdefault(run, []).append(block)

        def rows(blocks: list[bytes]) -> Iterator[tuple]:
            for k, block in enumerate(blocks):
                blocks[k] = b""
                for batch in pa.ipc.open_stream(block):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out = []
        for row in LoserTree([rows(r) for r in runs.values()], _order):
            out.append(row)
            if len(out) == 10_000:
                yield record_batch(CAPTURES, *zip(*out, strict=True))
                out = []
        if out:
            yield record_batch(CAPTURES, *zip(*out, strict=True))
        give_back()

    bound_arrow(spark)
    blocks = captures.mapInArrow(cut, "range int, run string, no long, block binary")
    dealt = blocks.repartitionById(ranges, F.col("range")).sortWithinPartitions("run", "no")  # names of blocks, no captures
    return dealt.mapInArrow(merge, CAPTURE_DDL)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    index = merge_runs(materialise(read_runs(spark, path), "warc-runs"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_QUADS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {s}) & 31) AS INTEGER), 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h, sha256(body) AS same FROM p),
k AS (SELECT same, max(page_id) AS keep FROM d GROUP BY same)
SELECT page_id, payload_bytes, {_QUADS} AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM d JOIN k USING (same)
"""
