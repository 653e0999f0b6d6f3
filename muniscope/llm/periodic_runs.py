"""Periodic run detection by Crochemore's partition refinement, and collapse of the runs found.

A run is a stretch of words with smallest period q, maximal to both sides, of at least max(6, 4q) words. For
each length l the positions of a text fall into classes of equal factors of l words. Going from l to l + 1, a
class is split by the classes that follow its members; of the parts of a former class all but the largest
are used for that (smaller half), so a position is moved O(log n) times. Members of a class are linked in text order:
two neighbours at distance l are a square of period l, and squares grow left and right into runs. As the root of a run
stands at least four times in it, classes of fewer than four members are given up, and so are lengths above n / 4.

Before that, whole texts are searched in bulk for stretches in which every word occurs four times and every three
neighbouring words three times; a run lies in one such stretch with all its words, so nothing is lost, and most texts have none.

Defined results: a null or empty text, or one of white space, has no run and collapses to the empty text; repeated rows are
judged each by itself; an empty table gives an empty result; other columns are passed on under their own names, those
called ``runs`` and ``collapsed`` are replaced. A text is one row: memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, map_rows, record_batch, table, utf8

LEAST_WORDS, LEAST_POWER = 6, 4


def refine(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of small numbers, by period and start."""
    n = len(words)
    most = n // LEAST_POWER
    following, before = [n] * (n + 1), [-1] * (n + 1)
    of = [-1] * (n + 1)  # class of a position; -1: given up
    size: list[int] = []
    head: list[int] = []  # first member of a class
    at_distance: dict[int, list[int]] = {}

    def note(i: int, j: int, length: int) -> None:
        if length < j - i <= most:
            at_distance.setdefault(j - i, []).append(i)

    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(w, []).append(i)
    # What splits classes: (members of a class or lost positions, whether they are given up); position n is the end.
    splitters: list[tuple[list[int], bool]] = [([n], True)]
    largest = max(groups.values(), key=len)
    for members in groups.values():
        small = len(members) < LEAST_POWER
        if not small:
            for i, j in zip(members, members[1:]):
                following[i], before[j] = j, i
                note(i, j, 0)
            for i in members:
                of[i] = len(size)
            head.append(members[0])
            size.append(len(members))
        if small or members is not largest:
            splitters.append((members, small))

    found: list[tuple[int, int, int]] = []
    alive = sum(size)
    for length in range(1, most + 1):
        if not alive:
            break
        found += _grown(words, length, [i for i in at_distance.pop(length, ()) if of[i] >= 0 and following[i] - i == length])
        parts: dict[int, list[int]] = {}  # class -> classes that part from it in this step
        lost: list[int] = []
        for members, dead in splitters:
            into: dict[int, int] = {}  # class -> its part before these members
            tail: dict[int, int] = {}
            for i in members:
                j = i - 1
                if j < 0 or (c := of[j]) < 0:
                    continue
                made = parts.setdefault(c, [])
                a, b = before[j], following[j]  # j leaves its class
                if a >= 0:
                    following[a] = b
                    if b < n:
                        note(a, b, length)
                else:
                    head[c] = b
                if b < n:
                    before[b] = a
                size[c] -= 1
                if dead:
                    of[j] = -1
                    lost.append(j)
                    continue
                part = into.get(c)
                if part is None:
                    part = into[c] = len(size)
                    size.append(0)
                    head.append(j)
                    made.append(part)
                a = tail.get(part, -1)
                if a >= 0:
                    following[a] = j
                    note(a, j, length)
                before[j], following[j] = a, n
                of[j], tail[part] = part, j
                size[part] += 1
        alive -= len(lost)
        # Of the parts of one former class the largest splits nothing; small ones are given up, once and for all.
        splitters = [([j], True) for j in lost]
        for c, made in parts.items():
            family = [c, *made]
            big = max(family, key=lambda x: size[x])
            for x in family:
                small = size[x] < LEAST_POWER
                if not size[x] or x == big and not small:
                    continue
                members, i = [], head[x]
                while i < n:
                    members.append(i)
                    i = following[i]
                splitters.append((members, small))
                if small:
                    for i in members:
                        of[i] = -1
                    alive -= len(members)
    return found


def _grown(words: list[int], q: int, starts: list[int]) -> list[tuple[int, int, int]]:
    """Runs of period q around the squares that begin at ``starts``."""
    out, end, n = [], -1, len(words)
    for i in sorted(starts):
        if i + 2 * q <= end:
            continue
        begin, end = i, i + 2 * q
        while begin and words[begin - 1] == words[begin - 1 + q]:
            begin -= 1
        while end < n and words[end] == words[end - q]:
            end += 1
        if end - begin >= max(LEAST_WORDS, LEAST_POWER * q):
            out.append((begin, end - begin, q))
    return out


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of parts of a text, given as word numbers from 0, outside which no run can have a word."""
    n = ids.size
    if n < LEAST_WORDS:
        return []
    often = np.bincount(ids)[ids] >= LEAST_POWER
    three = often[:-2] & often[1:-1] & often[2:]
    at = np.flatnonzero(three)
    if at.size < LEAST_WORDS - 2:
        return []
    # Equal triples: neighbouring words pair into dense numbers, then pairs with the third word; both fit 64 bits.
    kinds = int(ids.max()) + 1
    pair = np.unique(ids[at].astype(np.int64) * kinds + ids[at + 1], return_inverse=True)[1]
    _, triple, count = np.unique(pair.astype(np.int64) * kinds + ids[at + 2], return_inverse=True, return_counts=True)
    at = at[count[triple] >= 3]
    if not at.size:
        return []
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    firsts, lasts = at[np.r_[0, cut]], at[np.r_[cut - 1, at.size - 1]]
    return [(int(a), int(b) + 3) for a, b in zip(firsts, lasts) if b - a + 3 >= LEAST_WORDS]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    out = []
    for a, b in stretches(ids):
        out += [(a + s, length, q) for s, length, q in refine(ids[a:b].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


RUNS = "runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (every run's start, length, period in words, by start and period) and
    ``collapsed`` (the text's words joined by one space, each run cut to its first period)."""
    rest = [c for c in docs.columns if c.lower() not in ("runs", "collapsed", text.lower())]
    source = free_name(docs, "_text")
    given = docs.select(*(F.col(f"`{c}`") for c in rest), utf8(f"`{text}`").alias(source))
    schema = given.select(*(F.col(f"`{c}`") for c in rest)).schema
    schema = StructType([*schema, *StructType.fromDDL(RUNS)])

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, left = [], []
        for raw in batch.column(batch.num_columns - 1).to_pylist():
            words = raw.split()  # bytes: at white space of ASCII, \x20 and \x09-\x0D
            mine = runs_of(words)
            runs.append([dict(zip(("start", "length", "period"), r)) for r in mine])
            left.append(b" ".join(collapse(words, mine)))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        fields = [batch.schema.field(i) for i in range(batch.num_columns - 1)]
        return record_batch(pa.schema([*fields, ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())]), *kept, runs, left)

    return map_rows(given, rows, schema)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, where crc32 of the id in decimal ends in 0 with its words from a on repeated in a period p.

    h the checksum, g = floor(h / 10), n words: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Texts without words
    and rows without an id stay as they are."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.size(words).cast("long")
    a = F.pmod(g, n)
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("long")
    # Whole words of the head, then the p words from a on as often as they fit, and what is left over.
    facts = F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"), n.cast("int").alias("n"))
    built = F.transform(
        F.array(facts),
        lambda f: F.array_join(F.transform(F.sequence(F.lit(0), f.n - 1), lambda i: F.get(f.w, F.when(i < f.a, i).otherwise(f.a + (i - f.a) % f.p))), " "),
    )
    return F.when((h % 10 == 0) & F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.get(built, F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    longest = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda best, r: F.when(best.isNull() | (r.length > best.length), r).otherwise(best),  # runs come by start and period
    )
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    best = found.withColumn("_best", longest)
    return best.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
