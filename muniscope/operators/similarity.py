"""Similarity joins: equal hashes, Hamming distance by bands, near-equal texts within bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching
from ..functions.scores import hamming
from ..session import ship_package
from .graph import discard, shared_table


def pair_up(df: DataFrame, key: list[str], item: str, group: str) -> DataFrame:
    """Groups of equal keys that span several items: (keys, representative, n, members).

    One row per key, not one per pair; cross_links and members_of tell the members."""
    return df.groupBy(*key).agg(
        F.count_distinct(item).alias("n"), F.min(item).alias("first"), F.count_distinct(group).alias("groups")
    ).where("n > 1")


def cross_links(df: DataFrame, key: list[str], item: str, group: str) -> DataFrame:
    """(keys, a, b): every item of a key that spans several groups, with the least item of another group of its key.

    One row for a member, none of which is lost: with its class every pair across groups follows."""
    rows = df.select(*key, item, group).distinct()
    per_group = rows.groupBy(*key, group).agg(F.min(item).alias("_least"))
    # Per key the least item, and the least of any other group: two rows at most, by aggregates alone.
    first = per_group.groupBy(*key).agg(F.min(F.struct("_least", group)).alias("_first"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    others = per_group.alias("p").join(first.alias("f"), same).where(~F.col(f"p.{group}").eqNullSafe(F.col(f"f._first.{group}")))
    second = others.groupBy(*(F.col(f"p.{k}").alias(k) for k in key)).agg(F.min("_least").alias("_second"), F.first("_first").alias("_first"))
    met = rows.alias("p").join(second.alias("f"), same)
    other = F.when(F.col(f"p.{group}").eqNullSafe(F.col(f"f._first.{group}")), F.col("_second")).otherwise(F.col("_first._least"))
    return met.select(*(F.col(f"p.{k}").alias(k) for k in key), F.col(f"p.{item}").alias("a"), other.alias("b"))


def members_of(df: DataFrame, key: list[str], item: str, group: str, across: str) -> DataFrame:
    """(class, item, group): all members of the classes of equal keys that span several values of ``across``.

    A class is named by its least item. One row per member, so that every pair can be had from it."""
    rows = df.select(*key, item, group).distinct()
    spans = rows.groupBy(*key).agg(F.min(item).alias("class"), F.count_distinct(across).alias("_n")).where("_n > 1")
    spans = spans.select(*(F.col(k).alias(f"_{k}") for k in key), "class")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return rows.join(spans, same).select("class", item, group)


def hamming_pairs(df: DataFrame, item: str, bits: str, distance: int, width: int = 64) -> DataFrame:
    """(a, b, distance): all pairs of 64-bit values at most ``distance`` apart, without loss.

    The bits are cut into distance + 1 bands; of two such values at least one band is
    equal, so an equi-join on (band, value) finds them. A pair is kept at the first band it shares.
    Equal values are joined once per distinct value by the caller's choice of rows."""
    bands = distance + 1
    edges = [round(i * width / bands) for i in range(bands + 1)]

    def cut(x: Column, i: int) -> Column:
        size = edges[i + 1] - edges[i]
        moved = F.shiftrightunsigned(x, edges[i])
        return moved if size >= 64 else moved.bitwiseAND(F.lit((1 << size) - 1))

    x = F.col(bits)
    keyed = df.select(F.col(item).alias("id"), x.alias("x"), F.posexplode(F.array(*(cut(x, i) for i in range(bands)))).alias("band", "part"))
    a, b = keyed.alias("a"), keyed.alias("b")
    d = hamming(F.col("a.x"), F.col("b.x"))
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id")))
    first = F.lit(None).cast("int")
    for i in reversed(range(bands)):
        first = F.when(cut(F.col("a.x"), i) == cut(F.col("b.x"), i), i).otherwise(first)
    return met.where((d <= distance) & (first == F.col("a.band"))).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.cast("int").alias("distance")
    )


def hash_pairs(df: DataFrame, item: str, bits: str, distance: int) -> DataFrame:
    """(a, b, distance): pairs of distinct values, each named by its least item, and every other item of a
    value with that item at distance 0. Copies never meet as pairs."""
    named = df.groupBy(bits).agg(F.min(item).alias("first"))
    copies = df.join(named, bits).where(F.col(item) != F.col("first"))
    near = hamming_pairs(named, "first", bits, distance)
    return near.unionByName(copies.select(F.col("first").alias("a"), F.col(item).alias("b"), F.lit(0).alias("distance")))


def with_neighbour(asked: DataFrame, df: DataFrame, item: str, bits: str, distance: int, width: int = 64) -> DataFrame:
    """(item): those of ``asked`` that have another item of ``df`` at most ``distance`` bits away, itself left out.

    A search of few values in many, by the bands of hamming_pairs: rows of df meet no other rows of df."""
    edges = [round(i * width / (distance + 1)) for i in range(distance + 2)]
    x = F.col(bits)
    parts = F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)).alias("part")) for i, (a, b) in enumerate(zip(edges, edges[1:]))))
    cut = lambda d: d.select(F.col(item).alias("id"), x.alias("x"), F.explode(parts).alias("at"))
    met = cut(df).alias("b").join(cut(asked).alias("a"), F.col("a.at") == F.col("b.at"))
    near = (F.col("a.id") != F.col("b.id")) & (hamming(F.col("a.x"), F.col("b.x")) <= distance)
    return met.where(near).select(F.col("a.id").alias(item)).distinct()


#: Distinct hashes in a block: two blocks make one tile of distance_histogram.
BLOCK = 4096


def _tile(x: np.ndarray, c: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Pairs by distance between two lists of hashes with their numbers of copies; at most 256 rows are spread out at once."""
    out = np.zeros(65, dtype=np.int64)
    single = (c == 1).all() and (d == 1).all()
    for at in range(0, len(x), 256):
        far = np.bitwise_count(x[at : at + 256, None] ^ y[None, :]).ravel()
        if single:
            out += np.bincount(far, minlength=65)
        else:
            np.add.at(out, far, (c[at : at + 256, None] * d[None, :]).ravel())
    return out


def distance_histogram(df: DataFrame, item: str, bits: str, block: int = BLOCK) -> DataFrame:
    """(distance, n) over all pairs of items, n(n - 1)/2 of them: exact, whatever their number.

    Equal hashes count as one value with its copies, so a hot hash is one row. Distinct values are dealt by a digest to blocks of
    about ``block``; every two blocks make a tile, a task's work of fixed size, of which 65 sums remain. The work grows with the square of
    the distinct values, as the question does; memory does not. Nulls are in no pair."""
    spark = df.sparkSession
    ship_package(spark)
    values = df.where(F.col(item).isNotNull() & F.col(bits).isNotNull()).groupBy(F.col(bits).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    values = shared_table(values, "hash-values")
    blocks = max(1, -(-values.count() // block))
    packed = values.groupBy(F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("x").alias("x"), F.collect_list("c").alias("c"))
    packed = shared_table(packed, "hash-blocks")
    meets = packed.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))))
    other = packed.select(F.col("block").alias("other"), F.col("x").alias("y"), F.col("c").alias("d"))
    tiles = meets.join(other, "other").repartition("block", "other")

    def count(batches):
        total = np.zeros(65, dtype=np.int64)
        for batch in batches:
            for a, b, *lists in zip(*(batch[k] for k in ("block", "other", "x", "c", "y", "d"))):
                x, c, y, d = (np.asarray(v, dtype=np.int64) for v in lists)
                found = _tile(x.view(np.uint64), c, y.view(np.uint64), d)
                if a == b:  # every pair came twice, and each value met itself
                    found[0] -= (c * c).sum()
                    found //= 2
                    found[0] += (c * (c - 1) // 2).sum()
                total += found
        yield pd.DataFrame([(k, int(n)) for k, n in enumerate(total) if n], columns=["distance", "n"])

    counted = tiles.mapInPandas(count, "distance int, n long").groupBy("distance").agg(F.sum("n").alias("n"))
    counted = shared_table(counted, "hash-distances")
    discard(values, packed)
    return counted


def last_per_work(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key in ``order``; ties go by the other columns."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("v")).select(*key, "v.*")


def identical_photos(images: DataFrame, least: int = 150) -> DataFrame:
    """(md5, class, work): works that share an image, one row a member; class is the least work.

    images: (md5, work, seq, width, height). Of a work's equal images the last counts. A group whose first image
    has a side under ``least`` pixels is a stamp and no evidence: see stamp_groups."""
    last, first = _first_of_group(images)
    large = first.where((F.col("width") >= least) & (F.col("height") >= least)).select("md5", "class")
    return last.join(large, "md5").select("md5", "class", "work")


def stamp_groups(images: DataFrame, least: int = 150) -> DataFrame:
    """(md5, works): groups over several works that are too small to be a photograph."""
    _, first = _first_of_group(images)
    return first.where((F.col("width") < least) | (F.col("height") < least)).select("md5", "works")


def _first_of_group(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    last = last_per_work(images, ["md5", "work"], "seq")
    head = F.min(F.struct("seq", "work", "width", "height")).alias("h")
    first = images.groupBy("md5").agg(head, F.min("work").alias("class"), F.count_distinct("work").alias("works"))
    return last, first.where("works > 1").select("md5", "class", "works", "h.width", "h.height")


def sign_hash(vector: Column) -> Column:
    """64 bits of a 64-vector: bit i tells whether element i is above the 32nd smallest."""
    middle = F.get(F.sort_array(vector), F.lit(31))
    return F.aggregate(
        F.transform(vector, lambda x, i: F.when(x > middle, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda acc, bit: acc.bitwiseOR(bit),
    )


def adaptive_threshold(histogram: DataFrame, share: float = 0.01) -> DataFrame:
    """(threshold): min(6, max(2, p // 2)), p the distance below which ``share`` of the pairs lie.

    histogram: (distance, n), at most 65 rows."""
    w = Window.orderBy("distance")
    run = histogram.withColumn("run", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    p = run.where(F.col("run") >= F.greatest(F.lit(1), F.col("all") * share)).agg(F.min("distance").alias("p"))
    return p.select(F.least(F.lit(6), F.greatest(F.lit(2), F.floor(F.col("p") / 2))).cast("int").alias("threshold"))


#: Texts and characters of a group that are compared with one another where they are; what has more meets on an index.
GROUP, CHARACTERS = 2048, 4 << 20
#: Pairs that are looked at together, and that make a task.
PAIRS, TASK = 1 << 17, 1 << 20


def _numbered(*columns: pa.Array) -> list[np.ndarray]:
    """Equal values of all columns as equal numbers, nulls as -1; the last is the list of values."""
    coded = pa.concat_arrays(columns).dictionary_encode()
    codes = np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
    return [*np.split(codes, np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary]


def _near_in_groups(rows: pa.Table, starts: np.ndarray, apart: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """The near pairs of whole groups, the earlier row first."""
    text, texts = _numbered(rows["t"].combine_chunks())
    low, high, _ = _numbered(rows["low"].combine_chunks(), rows["high"].combine_chunks())
    known = matching.Texts(texts.to_pylist())
    ids = rows["id"].combine_chunks()
    ends = np.append(starts[1:], len(text))
    after = np.repeat(ends, ends - starts) - np.arange(len(text)) - 1  # rows of its group that follow a row
    before = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(at, to), after[at:to])
        j = i + 1 + np.arange(len(i)) - (before[i] - before[at])
        if apart:
            far = (np.minimum(low[i], low[j]) >= 0) & ((low[i] != high[j]) | (high[i] != low[j]))
            i, j = i[far], j[far]
        place, ratio = matching.near(known, text[i], text[j], threshold)
        if len(place):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[place])), ids.take(pa.array(j[place])), pa.array(ratio)], ["a", "b", "ratio"])
        at = to


def _compare_groups(group: str, apart: bool, threshold: float):
    """Rows sorted by group to near pairs. Of a group that goes on in the next batch the rows are held until it ends."""

    def compare(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            key = rows[group].combine_chunks()
            starts = np.append(0, np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1)
            last = int(starts[-1])
            if last:
                yield from _near_in_groups(rows[:last], starts[:-1], apart, threshold)
            held = rows[last:]
        if held is not None:
            yield from _near_in_groups(held, np.zeros(1, dtype=np.int64), apart, threshold)

    return compare


def _compare_pairs(threshold: float):
    """(a, b, t_a, t_b) to those that are near."""

    def compare(batches):
        for batch in batches:
            i, j, texts = _numbered(batch["t_a"], batch["t_b"])
            place, ratio = matching.near(matching.Texts(texts.to_pylist()), i, j, threshold)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(place)), batch["b"].take(pa.array(place)), pa.array(ratio)], ["a", "b", "ratio"])

    return compare


def _gram_size(threshold: float) -> tuple[int, float]:
    """(q, share): texts of n and m characters above the threshold have more than share * (n + m) - (q - 1) q-grams in common.

    What the ratio matches is a common subsequence of more than threshold / 2 of both lengths; each character outside of it
    touches q grams of its own text and q - 1 of the other."""
    for q in (3, 2, 1):
        share = 1 - q + (q - 0.5) * threshold
        if share >= 0.1 or q == 1:
            return q, share
    raise AssertionError


def _indexed(one: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, k, gram, nth): of each text the rarest q-grams of its group, so many that two texts above the
    threshold share one of them. k: a number that no two texts share."""
    q, share = _gram_size(threshold)
    least = threshold / (2 - threshold)
    rows = one.select(group, "k", "n", F.explode(F.sequence(F.lit(1), F.col("n") - q + 1)).alias("p"), "t").where(F.col("n") >= q)
    grams = rows.groupBy(group, "k", "n", F.expr(f"substring(t, p, {q})").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    grams = shared_table(grams.select(group, "k", "n", "gram", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("nth")), "grams")
    often = grams.groupBy(group, "gram", "nth").agg(F.count(F.lit(1)).alias("often"))
    met = grams.join(often, [group, "gram", "nth"])
    place = F.row_number().over(Window.partitionBy("k").orderBy("often", "gram", "nth"))
    common = F.floor(F.col("n") * (1 + least) * share - (q - 1) - 1e-9) + 1  # at least so many with any partner
    ranked = met.select(group, "k", "n", "gram", "nth", "often").withColumn("place", place)
    return ranked.where(F.col("place") <= F.col("n") - q + 1 - common + 1).select(group, "k", "gram", "nth")


def _indexed_pairs(one: DataFrame, group: str, threshold: float, apart: bool) -> DataFrame:
    """(a, b, ratio) of groups too large to be compared as a whole: candidates from an index, without loss."""
    q, share = _gram_size(threshold)
    least = threshold / (2 - threshold)  # the shorter length over the longer is above this
    if apart:  # a text that no other year can meet is no one's partner
        years = one.groupBy(group).agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low < _high").select(group)
        one = one.join(years, group, "left_semi")
    one = shared_table(one.withColumn("n", F.length("t")).withColumn("k", F.monotonically_increasing_id()), "large-groups")
    index = shared_table(_indexed(one, group, threshold), "text-index")
    key = [group, "gram", "nth"]
    x, y = index.select(*key, F.col("k").alias("x")), index.select(*key, F.col("k").alias("y"))
    pairs = x.join(y, key).where("x < y").select("x", "y")
    # Texts so short that no gram need be common, and what is short enough to be near them.
    short = int((q - 1) / ((1 + least) * share))
    tiny = one.where(F.col("n") <= short / least).select(group, "k", "n")
    u, v = tiny.select(group, F.col("k").alias("x"), "n"), tiny.select(group, F.col("k").alias("y"), F.col("n").alias("m"))
    close = u.join(v, group).where("x < y").where(2.0 * F.least("n", "m") / (F.col("n") + F.col("m")) > threshold)
    pairs = pairs.unionByName(close.select("x", "y")).distinct()
    side = lambda k: one.select(F.col("k").alias(k), F.struct("id", "t", "low", "high", "n").alias(f"_{k}"))
    met = pairs.join(side("x"), "x").join(side("y"), "y")
    first = F.struct("_x.id", "_x.t") < F.struct("_y.id", "_y.t")
    met = met.select(F.when(first, F.col("_x")).otherwise(F.col("_y")).alias("p"), F.when(first, F.col("_y")).otherwise(F.col("_x")).alias("q"))
    if apart:
        met = met.where("p.low <> q.high OR p.high <> q.low")
    met = met.where(2.0 * F.least("p.n", "q.n") / (F.col("p.n") + F.col("q.n")) > threshold)
    met = met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.t").alias("t_a"), F.col("q.t").alias("t_b"))
    kind = one.schema["id"].dataType.simpleString()
    return met.mapInArrow(_compare_pairs(threshold), f"a {kind}, b {kind}, ratio double")


def text_pairs(df: DataFrame, item: str, text: str, group: str, threshold: float = 0.9, across: str | None = None, most: int = GROUP) -> DataFrame:
    """(a, b, ratio): texts of one group with a Ratcliff-Obershelp ratio above the threshold, the text of the lesser item first.

    Distinct texts only, one row per pair of them, each named by its least item; two texts with the same least item are a pair too, in
    the order of the texts. With ``across`` only texts that stand under different values of that column, a fiscal year say. Null
    items and groups are in no pair. A group of up to ``most`` texts is compared within a task, whole groups at a time, bounds from lengths
    and letter counts before the exact ratio. The texts of a larger one meet on an index of their rarest q-grams, without loss;
    texts too short for that meet by their length."""
    ship_package(df.sparkSession)
    year = F.col(across) if across else F.lit(0)
    one = df.where((F.length(text) > 0) & F.col(group).isNotNull()).groupBy(group, text).agg(F.min(item).alias("id"), F.min(year).alias("low"), F.max(year).alias("high"))
    one = one.where("id IS NOT NULL").select(group, "id", "low", "high", F.col(text).alias("t"))
    one = shared_table(one, "texts")
    sizes = one.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("t")).alias("_chars"))
    sizes = sizes.withColumn("_large", (F.col("_n") > most) | (F.col("_chars") > CHARACTERS))
    work = F.sum(F.when(~F.col("_large"), F.col("_n") * (F.col("_n") - 1) / 2 + 16 * F.col("_n")))
    tasks, large = sizes.agg(F.ceil(F.coalesce(work, F.lit(0)) / TASK), F.count_if("_large")).first()
    small = one
    if large:
        names = shared_table(sizes.where("_large").select(group), "large-groups")
        small = one.join(names, group, "left_anti")
    kind = one.schema["id"].dataType.simpleString()
    small = small.repartition(max(1, int(tasks)), group).sortWithinPartitions(group, "id", "t")
    found = small.mapInArrow(_compare_groups(group, across is not None, threshold), f"a {kind}, b {kind}, ratio double")
    return found.unionByName(_indexed_pairs(one.join(names, group, "left_semi"), group, threshold, across is not None)) if large else found
