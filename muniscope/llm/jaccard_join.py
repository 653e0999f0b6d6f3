"""Exact n-gram Jaccard self-join of a corpus with signature trees.

1.  Every text becomes the set of its distinct word shingles (64-bit hashes). Rows with
    equal sets are one node, so copies never meet as pairs; of sets that hold more than a
    thousandth of all rows only the node's own row posts what follows.
2.  Blocking without loss. Two sets whose similarity reaches the threshold differ in at most
    k shingles, k following from their sizes. A set is cut by hash into k + 1 + spare parts; then
    more than ``spare`` parts of such a pair are equal, so each set posts the sums of its parts,
    tagged by a size class (and the next one if a partner may be there). Parts mix shingles from
    the whole text: a passage shared by many texts makes few of their parts equal, and documents
    with fewer meeting posts than a link needs drop out.
3.  Star edges to the least node of a post, where two nodes share as many as a link needs,
    give the first blocks. Once these are joined, only posts count where different
    components meet, and nodes that still have enough of those: they give the last blocks.
    No link is outside both.
4.  In a block, a signature tree: sets ordered by size and least hash, nodes holding the OR of their
    members' token bitmaps and their size range. A dual traversal of the tree against
    itself drops node pairs whose sizes are incompatible, whose largest possible overlap is
    too small, or whose members are all connected already; what remains is verified by
    exact intersection.
5.  A block above CHUNK_SHINGLES is cut by size class and hash. Chunks are joined alone,
    some members of each chunk's largest component against one another, and then every
    chunk that still has members outside the block's largest component against each chunk of compatible
    size, a pair of chunks being a task. That loses no link between components.
6.  Every link lies within a component, so links are counted there: a dual traversal of the trees
    without regard to what is connected, and exact intersections of the leaves that remain as
    products of small 0/1 matrices. A large component is cut into chunks as above and every pair of
    compatible chunks is a task, so memory is bounded; the work in a component grows with the
    square of its distinct sets, as its links do.

Other columns of a table are not read and may have any name; the pipeline stage passes them on as they are.

Defined results: null, empty and blank texts have no shingles and no links; a text of fewer
words than a shingle is one shingle; every row counts, whether its doc_id is null, repeated or its
own; a component is named by its least doc_id, null if it has none; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, bound_arrow, discard, give_back, join_groups, map_rows, materialise, record_batch, row_keyed, table, utf8
from .components import components

CHUNK_SHINGLES = 200_000
LEAF = 16
FAN = 4
PIVOTS = 8

_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Word hashes seen by this worker; emptied when it grows large."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles. bytes.lower() and bytes.split() know
    A-Z and the six ASCII white-space characters only."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    width = min(n, size)
    s = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        s = mix(s + h[i : n - width + 1 + i] * _ODD[i % 4] + _U(i))
    return np.unique(s)


class Similarity:
    """Jaccard >= numerator / denominator, in whole numbers, and what follows for sizes."""

    def __init__(self, numerator: int, denominator: int):
        self.p, self.q = numerator, denominator
        #: Parts of fewer shingles are weak; parts hold (q + p) / 2(q - p) of them if all goes well.
        strict = (self.q + self.p) >= 16 * (self.q - self.p)
        self.tiny, self.spare = (3, 8) if strict else (1, 4)
        self.bounds = [1]  # size classes [bounds[t], bounds[t+1]), wider than any pair's size ratio
        ratio = max(1.5, 1.05 * denominator / numerator)
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(ratio * self.bounds[-1])))

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.q * common >= self.p * (a + b - common)

    def tags(self, n: int) -> list[tuple[int, int, int]]:
        """(size class, number of parts, spare parts) under which a set of n shingles posts."""
        t = bisect.bisect_right(self.bounds, n) - 1
        found = [t]
        if self.q * n >= self.p * self.bounds[t + 1]:
            found.append(t + 1)
        out = []
        for k in found:
            differ = 2 * (self.bounds[k + 1] - 1) * (self.q - self.p) // (self.q + self.p)
            spare = differ // self.spare + 3 if differ > 8 else 0
            out.append((k, differ + 1 + spare, spare))
        return out

    def posts(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(size class, need, posts): a linked pair has at least ``need`` of a set's posts in common.

        Of the parts of a linked pair, spare + 1 at least are equal. Parts too small to tell texts
        apart are not posted, and lower the need by their number, unless nothing would be left: then
        all are posted. A partner that posts no weak parts leaves out spare of them at most; where
        the shingles it may have besides can make it one, one post in common is all that is sure."""
        out = []
        for tag, parts, spare in self.tags(s.size):
            part = (((s * _ODD[1]) >> _U(33)) % _U(parts)).astype(np.int64)
            count = np.bincount(part, minlength=parts)
            order = np.argsort(part, kind="stable")
            begins = np.cumsum(count) - count
            full = count > 0
            sums = np.zeros(parts, dtype=np.uint64)
            sums[full] = np.add.reduceat(mix(s[order] ^ _ODD[2]), begins[full])
            post = mix(sums + mix(np.arange(parts, dtype=np.uint64) + (_U(tag) << _U(40)) + _U(1)))
            weak = count < self.tiny
            few = int(weak.sum())
            if few <= spare:
                out.append((tag, spare + 1 - few, post[~weak]))
                continue
            more = s.size * (self.q - self.p) // self.p  # shingles of a partner that are not in this set
            filled = int(np.searchsorted(np.cumsum(np.sort(self.tiny - count[weak])), more, side="right"))
            out.append((tag, 1 if few - filled <= spare else spare + 1, post))
        return out


def bitmap_width(sizes: np.ndarray) -> int:
    width = 256
    while width < 2 * np.median(sizes) and width < 1 << 14:
        width *= 2
    return width


def tree_order(sets: list[np.ndarray]) -> list[int]:
    """Positions by size, in steps of a tenth, and least hash: what is alike is near."""
    return sorted(range(len(sets)), key=lambda i: (int(math.log(sets[i].size) / 0.105), int(sets[i][0])))


class SignatureTree:
    """Sets in an order; level 0 holds runs of LEAF sets, each level above runs of FAN nodes."""

    def __init__(self, sets: list[np.ndarray], width: int | None = None):
        self.sets = sets
        self.sizes = np.array([s.size for s in sets], dtype=np.int64)
        width = width or bitmap_width(self.sizes)
        bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
        for row, s in zip(bits, sets):
            token = s % _U(width)
            np.bitwise_or.at(row, (token >> _U(6)).astype(np.int64), _U(1) << (token & _U(63)))
        self.bits = bits
        #: Shingles that share a bit with another of their set: what a bitmap cannot tell apart.
        self.slack = self.sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels: list[tuple[np.ndarray, ...]] = []
        step = LEAF
        while True:
            at = np.arange(0, len(sets), step)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at, axis=0),
                    np.minimum.reduceat(self.sizes, at),
                    np.maximum.reduceat(self.sizes, at),
                    np.maximum.reduceat(self.slack, at),
                )
            )
            if at.size == 1:
                break
            step *= FAN

    def span(self, level: int, node: int) -> tuple[int, int]:
        step = LEAF * FAN**level
        return node * step, min(len(self.sets), (node + 1) * step)

    def kids(self, level: int, node: int) -> range:
        return range(node * FAN, min(self.levels[level - 1][1].size, (node + 1) * FAN))

    def apart(self, level: int, node: int, other: SignatureTree, its_level: int, its_node: int, sim: Similarity) -> bool:
        """No member of one node can be linked with one of the other: sizes or the largest overlap forbid it."""
        ors, least, most, slacks = (x[node] for x in self.levels[level])
        its_ors, its_least, its_most, its_slacks = (x[its_node] for x in other.levels[its_level])
        if sim.q * most < sim.p * its_least or sim.q * its_most < sim.p * least:
            return True
        overlap = int(np.bitwise_count(ors & its_ors).sum()) + min(slacks, its_slacks)
        return overlap < sim.p / (sim.p + sim.q) * (least + its_least) - 1e-6


def leaf_pairs(x: SignatureTree, y: SignatureTree, sim: Similarity) -> dict[int, list[int]]:
    """For leaves of x those of y that may hold a linked partner; of a tree with itself each pair once."""
    found: dict[int, list[int]] = {}
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        i, a, j, b = stack.pop()
        same = x is y and i == j and a == b
        if not same and x.apart(i, a, y, j, b, sim):
            continue
        if i == j == 0:
            found.setdefault(a, []).append(b)
        elif x is y:  # both sides go down together
            stack += [(i - 1, k, j - 1, m) for k in x.kids(i, a) for m in y.kids(j, b) if not same or k <= m]
        elif i >= j:
            stack += [(i - 1, k, j, b) for k in x.kids(i, a)]
        else:
            stack += [(i, a, j - 1, m) for m in y.kids(j, b)]
    return found


CELLS = 1 << 20


def count_links(
    left: list[np.ndarray], right: list[np.ndarray] | None, weight: np.ndarray, other: np.ndarray | None, sim: Similarity
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the linked partners of every set of both sides; without ``right`` of one side with itself."""
    alone = right is None
    sides = [left] if alone else [left, right]
    width = bitmap_width(np.array([s.size for side in sides for s in side]))
    orders = [tree_order(side) for side in sides]
    trees = [SignatureTree([side[i] for i in order], width) for side, order in zip(sides, orders)]
    weights = [w[order].astype(np.float64) for w, order in zip((weight, other), orders)]
    # Shingles as numbers of this task; columns of a leaf's matrix are the shingles the leaf has.
    names, number = np.unique(np.concatenate([s for t in trees for s in t.sets]), return_inverse=True)
    ends = np.cumsum([s.size for t in trees for s in t.sets])
    number = [number[e - s.size : e] for e, s in zip(ends.tolist(), (s for t in trees for s in t.sets))]
    numbers = [number[: len(left)], number[len(left) :]] if not alone else [number]
    column = np.full(names.size, -1, dtype=np.int64)
    counts = [np.zeros(len(side)) for side in sides]
    x, y = trees[0], trees[-1]
    sizes = [t.sizes for t in trees]

    def dense(rows: list[np.ndarray], wide: int) -> np.ndarray:
        at = np.repeat(np.arange(len(rows)), [r.size for r in rows])
        col = column[np.concatenate(rows)]
        out = np.zeros((len(rows), wide), dtype=np.float32)
        out[at[col >= 0], col[col >= 0]] = 1
        return out

    for a, leaves in leaf_pairs(x, y, sim).items():
        low, high = x.span(0, a)
        mine = numbers[0][low:high]
        own = np.unique(np.concatenate(mine))
        column[own] = np.arange(own.size)
        matrix = dense(mine, own.size)
        places = np.concatenate([np.arange(*y.span(0, b)) for b in sorted(leaves)])
        step = max(LEAF, CELLS // max(1, own.size))
        for at in range(0, places.size, step):
            js = places[at : at + step]
            common = matrix @ dense([numbers[-1][j] for j in js.tolist()], own.size).T
            both = sizes[0][low:high, None] + sizes[-1][js][None, :]
            linked = sim.q * common.astype(np.int64) >= sim.p * (both - common.astype(np.int64))
            if alone:
                linked &= np.arange(low, high)[:, None] < js[None, :]
            counts[0][low:high] += linked @ weights[-1][js]
            counts[-1][js] += weights[0][low:high] @ linked
        column[own] = -1
    out = []
    for count, order in zip(counts, orders):
        back = np.zeros(len(order), dtype=np.int64)
        back[order] = np.rint(count).astype(np.int64)
        out.append(back)
    return out[0], out[-1]


def link_group(sets: list[np.ndarray], labels: np.ndarray, sim: Similarity) -> list[tuple[int, int]]:
    """Links (positions) that, with ``labels`` as known components, connect all linked sets.

    Every linked pair of different components is found or made redundant by other links."""
    if len(sets) < 2:
        return []
    order = tree_order(sets)
    tree = SignatureTree([sets[i] for i in order])
    label = labels[order].copy()
    sizes, bits, slack = tree.sizes, tree.bits, tree.slack
    found: list[tuple[int, int]] = []

    def settled(a: tuple[int, int], b: tuple[int, int]) -> bool:
        one = label[a[0]]
        return bool((label[a[0] : a[1]] == one).all() and (label[b[0] : b[1]] == one).all())

    def leaves(a: tuple[int, int], b: tuple[int, int]) -> None:
        for i in range(*a):
            lo = max(b[0], i + 1)
            if lo >= b[1]:
                continue
            js = np.arange(lo, b[1])
            js = js[label[js] != label[i]]
            if not js.size:
                continue
            common = np.bitwise_count(bits[js] & bits[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(common + np.minimum(slack[js], slack[i]), np.minimum(sizes[js], sizes[i]))
            for j in js[sim.q * most >= sim.p * (sizes[js] + sizes[i] - most)].tolist():
                if label[i] == label[j]:
                    continue
                x, y = tree.sets[i], tree.sets[j]
                if sim.linked(np.intersect1d(x, y, assume_unique=True).size, x.size, y.size):
                    found.append((order[i], order[j]))
                    label[label == label[j]] = label[i]

    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        a, b = tree.span(level, x), tree.span(level, y)
        if settled(a, b):
            continue
        if x != y and tree.apart(level, x, tree, level, y, sim):
            continue
        if level == 0:
            leaves(a, b)
            continue
        kids = [tree.kids(level, n) for n in (x, y)]
        pairs = [(i, j) for i in kids[0] for j in kids[1] if x != y or i < j]
        stack += [(level - 1, i, j) for i, j in pairs]
        if x == y:  # own pairs come off the stack first: what is alike gets connected early
            stack += [(level - 1, i, i) for i in kids[0]]
    return found


SET_SCHEMA = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "n_shingles", "set_hi", "set_lo")])
POST_SCHEMA = pa.schema([("row", pa.int64()), ("post", pa.int64()), ("tag", pa.int32()), ("need", pa.int32())])
SET = ["n_shingles", "set_hi", "set_lo"]


def set_key(s: np.ndarray) -> tuple[int, int, int]:
    """A set's size and two sums of its hashes."""
    return s.size, int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ _ODD[3]).sum(dtype=np.uint64).view(np.int64))


def shingle_sets(base: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, n_shingles, set_hi, set_lo) per row."""

    def rows(batch):
        keys = [set_key(shingles(text, size)) for text in batch.column(2).to_pylist()]
        return record_batch(SET_SCHEMA, batch.column(0), batch.column(1), *zip(*keys, strict=True))

    ddl = "row long, doc_id long, n_shingles long, set_hi long, set_lo long"
    return map_rows(base.select("row", "doc_id", utf8().alias("_b")), rows, ddl)


def posted(base: DataFrame, size: int, sim: Similarity, hot: dict[tuple[int, int, int], int]) -> DataFrame:
    """(row, post, tag, need), as many rows per document as its set posts parts.

    hot: the node's row of each set that very many rows have; the others of its rows post nothing."""

    def rows(batch):
        keys, posts, tags, needs = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingles(text, size)
            if not s.size or hot and hot.get(set_key(s), key) != key:
                continue
            for tag, need, mine in sim.posts(s):
                keys.append(np.full(mine.size, key, dtype=np.int64))
                posts.append(mine.view(np.int64))
                tags.append(np.full(mine.size, tag, dtype=np.int32))
                needs.append(np.full(mine.size, need, dtype=np.int32))
        if keys:
            yield record_batch(POST_SCHEMA, *(np.concatenate(c) for c in (keys, posts, tags, needs)))

    return map_rows(base.select("row", utf8().alias("_b")), rows, "row long, post long, tag int, need int")


def _over_post(column: Column) -> Column:
    return column.over(Window.partitionBy("post"))


def _enough(met: DataFrame) -> DataFrame:
    """Without the nodes that meet fewer times than a link needs."""
    return met.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("node", "tag"))).where("_n >= need").drop("_n")


def meeting_posts(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, post, tag, need): posts that meet another node's, of nodes with enough of them.

    A document has a post for every part of its set, so a group of copies, however large,
    spreads over as many keys; within a key the window passes over sorted rows and spills."""

    def shared(met: DataFrame) -> DataFrame:
        return met.withColumn("_n", _over_post(F.count(F.lit(1)))).where("_n > 1").drop("_n")

    once = shared(posts).join(nodes.select("node"), F.col("row") == F.col("node"))
    once = materialise(_enough(once.select("node", "post", "tag", "need")), "jaccard-met")
    met = materialise(_enough(shared(once)), "jaccard-met")
    discard(once)
    return met


def strong_stars(met: DataFrame) -> DataFrame:
    """Edges from a node to the least node of its posts, where these are as many as a link needs."""
    met = met.withColumn("head", _over_post(F.min("node"))).where("node <> head")
    often = met.groupBy("node", "head", "tag").agg(F.count(F.lit(1)).alias("_n"), F.min("need").alias("need"))
    return often.where("_n >= need").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()


def unsettled_stars(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges over posts where different components still meet often enough for a link."""
    met = met.join(roots.select("node", F.col("root").alias("_root")), "node", "left")
    met = met.withColumn("label", F.coalesce("_root", "node")).drop("_root")
    rounds = []
    for k in range(2):
        mixed = _over_post(F.min("label")) != _over_post(F.max("label"))
        met = _enough(met.withColumn("_m", mixed).where("_m").drop("_m"))
        met = materialise(met, f"jaccard-unsettled-{k}")
        rounds.append(met)
    met = met.withColumn("head", _over_post(F.min("node"))).where("node <> head")
    stars = materialise(met.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "jaccard-rest")
    discard(*rounds)
    return stars


def _link_sorted(members: DataFrame, hashes: DataFrame, sim: Similarity) -> DataFrame:
    """Edges (a, b) from rows (block, chunk, node, label), a group being one (block, chunk).

    members: read from files, so that their size is known before all hashes would be shuffled to meet them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, labels, sets = None, [], [], []

        def close():
            links = link_group(sets, np.array(labels, dtype=np.int64), sim)
            return record_batch(schema, [nodes[a] for a, _ in links], [nodes[b] for _, b in links])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for block, chunk, node, label, hashes in zip(*columns, strict=True):
                if (block, chunk) != key:
                    if len(nodes) > 1:
                        yield close()
                    key, nodes, labels, sets = (block, chunk), [], [], []
                nodes.append(node)
                labels.append(label)
                sets.append(np.frombuffer(hashes, dtype=np.uint64))
        if len(nodes) > 1:
            yield close()
        nodes, labels, sets = [], [], []
        give_back()

    bound_arrow(members.sparkSession)
    rows = members.select("block", "chunk", "node", "label").join(hashes, "node")
    placed = rows.select("block", "chunk", "node", "label", "hashes").repartition("block", "chunk")
    return placed.sortWithinPartitions("block", "chunk", "node").mapInArrow(run, "a long, b long").where("a <> b")


def _cut(nodes: DataFrame, group: str, sim: Similarity, chunk: int) -> DataFrame:
    """nodes (group, node, n_shingles, ...) with big, band and chunk: where a group is too large for one
    task, its chunks go by size class and hash and hold about ``chunk`` shingles."""
    whole = nodes.groupBy(group).agg(F.sum("n_shingles").alias("_all"))
    # Few groups are large; written, so that their size is known and their nodes stay where they are.
    large = materialise(whole.where(F.col("_all") > chunk).select(group, F.lit(True).alias("big")), "jaccard-large")
    band = F.floor(F.log("n_shingles") / F.lit(math.log(sim.q / sim.p))).cast("int")
    sized = nodes.withColumn("band", band).join(large, group, "left")
    totals = sized.where("big").groupBy(group, "band").agg(F.ceil(F.sum("n_shingles") / F.lit(chunk)).cast("long").alias("cuts"))
    totals = materialise(totals, "jaccard-cuts")
    name = F.concat_ws(":", "band", F.pmod(F.xxhash64("node"), "cuts"))
    return sized.join(totals, [group, "band"], "left").withColumn("chunk", F.when(F.col("big"), name).otherwise("")).drop("cuts")


def _near(chunks: DataFrame) -> DataFrame:
    """chunks (.., band) once for each band that holds sets of compatible size."""
    return chunks.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))


def link_blocks(blocks: DataFrame, hashes: DataFrame, known: DataFrame | None, sim: Similarity, chunk: int) -> DataFrame:
    """Edges (a, b) that with the components in ``known`` connect all linked nodes of each block.

    blocks: (node, block, n_shingles)."""
    if known is not None:
        blocks = blocks.join(known.withColumnRenamed("root", "label"), "node", "left")
        blocks = blocks.withColumn("label", F.coalesce("label", "node"))
    else:
        blocks = blocks.withColumn("label", F.col("node"))
    placed = materialise(_cut(blocks, "block", sim, chunk), "jaccard-chunks")
    links = materialise(_link_sorted(placed, hashes, sim), "jaccard-links")
    if not placed.where("big").limit(1).count():
        return links
    before = links if known is None else links.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return links.unionByName(_link_large(placed.where("big").drop("label"), hashes, before, sim))


def _link_large(placed: DataFrame, hashes: DataFrame, links: DataFrame, sim: Similarity) -> DataFrame:
    """The links between chunks of the same block, given those already known."""

    def labelled(known: DataFrame, tag: str) -> DataFrame:
        roots = components(known, tag).withColumnRenamed("root", "label")
        named = placed.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return materialise(named, f"{tag}-named")

    def largest(named: DataFrame, *key: str) -> DataFrame:
        sizes = named.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("_n"))
        return sizes.groupBy(*key).agg(F.max_by("label", F.struct("_n", "label")).alias("main"))

    named = labelled(links, "jaccard-within")
    main = named.join(largest(named, "block", "chunk"), ["block", "chunk"]).where("label = main")
    slot = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(PIVOTS))
    pivots = main.groupBy("block", "chunk", slot.alias("_slot")).agg(F.min("node").alias("node"))
    pivots = pivots.select("node").join(named, "node").withColumn(
        "chunk", F.concat(F.lit("pivots:"), F.pmod(F.xxhash64("chunk"), F.lit(64)).cast("string"))
    )
    between = materialise(_link_sorted(materialise(pivots, "jaccard-pivots"), hashes, sim), "jaccard-between")

    named = labelled(links.unionByName(between), "jaccard-between")
    outside = named.join(largest(named, "block"), "block").where("label <> main")
    # Chunks without outsiders have one component, the block's largest: two of them need no comparison.
    homes = _near(outside.select("block", "band", F.col("chunk").alias("home")).distinct())
    pairs = homes.join(named.select("block", "band", "chunk").distinct(), ["block", "band"]).where("home <> chunk")
    pairs = pairs.select("block", F.least("home", "chunk").alias("x"), F.greatest("home", "chunk").alias("y")).distinct()
    pairs = pairs.select("block", F.concat_ws("|", "x", "y").alias("pair"), F.explode(F.array("x", "y")).alias("chunk"))
    members = named.join(pairs, ["block", "chunk"]).select("block", F.col("pair").alias("chunk"), "node", "label")
    return between.unionByName(materialise(_link_sorted(materialise(members, "jaccard-guests"), hashes, sim), "jaccard-last"))


COUNT_SCHEMA = pa.schema([("node", pa.int64()), ("links", pa.int64())])


def link_numbers(members: DataFrame, hashes: DataFrame, sim: Similarity, chunk: int) -> DataFrame:
    """(node, links): rows whose set is another one and linked, for the nodes of each component.

    members: (root, node, n_shingles, copies)."""
    placed = materialise(_cut(members, "root", sim, chunk), "jaccard-members")
    small = placed.where("big IS NULL").select("root", F.lit("").alias("x"), F.lit("").alias("y"), F.lit(0).alias("side"), "node", "copies")
    chunks = placed.where("big").select("root", "band", "chunk").distinct()
    pairs = _near(chunks.withColumnRenamed("chunk", "x")).join(chunks.withColumnRenamed("chunk", "y"), ["root", "band"])
    pairs = pairs.where("x <= y").select("root", "x", "y").distinct()
    sides = F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))
    pairs = pairs.select("root", "x", "y", F.posexplode(sides).alias("side", "chunk"))
    large = placed.where("big").join(pairs, ["root", "chunk"]).select("root", "x", "y", "side", "node", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, copies = None, ([], []), ([], []), ([], [])

        def close():
            if not sets[0]:
                return
            two = bool(sets[1])
            other = np.array(copies[1], dtype=np.int64) if two else None
            mine, its = count_links(sets[0], sets[1] if two else None, np.array(copies[0], dtype=np.int64), other, sim)
            yield record_batch(COUNT_SCHEMA, nodes[0], mine)
            if two:
                yield record_batch(COUNT_SCHEMA, nodes[1], its)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for root, x, y, side, node, weight, raw in zip(*columns, strict=True):
                if (root, x, y) != key:
                    yield from close()
                    key, nodes, sets, copies = (root, x, y), ([], []), ([], []), ([], [])
                nodes[side].append(node)
                sets[side].append(np.frombuffer(raw, dtype=np.uint64))
                copies[side].append(weight)
        yield from close()
        nodes, sets, copies = ([], []), ([], []), ([], [])
        give_back()

    bound_arrow(members.sparkSession)
    key = ["root", "x", "y"]
    both = materialise(small.unionByName(large), "jaccard-sides")
    rows = both.join(hashes, "node").select(*key, "side", "node", "copies", "hashes")
    placed_rows = rows.repartition(*key).sortWithinPartitions(*key, "side", "node")
    return placed_rows.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _judged(base: DataFrame, size: int, sim: Similarity, chunk: int, count: bool) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, keep_row, n_links) per row of (row, doc_id, text).

    n_links is null unless asked for."""
    sets = materialise(shingle_sets(base, size), "jaccard-sets")
    total = sets.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = sets.where("n_shingles > 0").groupBy(*SET).agg(first, F.count(F.lit(1)).alias("copies"))
    groups = materialise(groups.withColumn("node", F.col("first.row")), "jaccard-groups")
    nodes = groups.select("node", "n_shingles")
    hot = groups.where((F.col("copies") * HOT_SHARE >= total) & (F.col("copies") > 1)).collect()  # HOT_SHARE at most
    met = meeting_posts(posted(base, size, sim, {(r.n_shingles, r.set_hi, r.set_lo): r.node for r in hot}), nodes)

    def hashed(batch):
        schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])
        return record_batch(schema, batch.column(0), [shingles(t, size).tobytes() for t in batch.column(1).to_pylist()])

    # Written first, so that its size is known before the texts would be shuffled to meet it.
    meets = materialise(met.select(F.col("node").alias("row")).distinct(), "jaccard-meets")
    texts = base.join(meets, "row")
    hashes = materialise(map_rows(texts.select("row", utf8().alias("_b")), hashed, "node long, hashes binary"), "jaccard-hashes")

    def joined(stars: DataFrame, known: DataFrame | None) -> DataFrame:
        blocks = components(stars, "jaccard-blocks").select("node", F.col("root").alias("block")).join(nodes, "node")
        return link_blocks(blocks, hashes, known, sim, chunk)

    links = joined(strong_stars(met), None)
    roots = components(links, "jaccard-roots")
    rest = unsettled_stars(met, roots)
    discard(met)
    if rest.limit(1).count():
        links = links.unionByName(joined(rest, roots))
        roots = components(links, "jaccard-roots")
    named = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("_least"))
    named = named.join(least, "root").select(
        *SET, "node", "copies", F.col("_least.doc_id").alias("component_id"), F.col("_least.row").alias("keep_row")
    )
    if count:
        members = roots.join(groups.select("node", "n_shingles", "copies"), "node")
        numbers = materialise(link_numbers(members, hashes, sim, chunk), "jaccard-numbers")
        named = named.join(numbers, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    else:
        named = named.withColumn("n_links", F.lit(None).cast("long"))
    named = materialise(named.select(*SET, "copies", "component_id", "keep_row", "n_links"), "jaccard-named")
    discard(hashes, roots, groups)
    out = ["row", "doc_id", "n_shingles", "component_id", "keep_row", "n_links"]
    none = sets.where("n_shingles = 0").select(
        "row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("keep_row"),
        F.lit(0 if count else None).cast("long").alias("n_links"),
    )
    return join_groups(sets.where("n_shingles > 0"), named, SET, "copies", total).select(*out).unionByName(none)


def _source(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    keyed, key = row_keyed(docs)
    return keyed, keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), key


def jaccard_components(
    docs: DataFrame, size: int = 5, numerator: int = 4, denominator: int = 5, chunk: int = CHUNK_SHINGLES
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row: links at Jaccard >= numerator / denominator.

    n_links is the number of other rows linked with it, equal sets among them."""
    _, base, _ = _source(docs)
    judged = _judged(base, size, Similarity(numerator, denominator), chunk, count=True)
    return judged.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, numerator=90, denominator=100)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component (five words, similarity 0.8) one row stays, that with the least
    id, a row without one only where the component has no other. Link numbers are not asked for."""
    keyed, base, key = _source(docs)
    judged = _judged(base, 5, Similarity(4, 5), CHUNK_SHINGLES, count=False)
    gone = materialise(judged.where("row <> keep_row").select(F.col("row").alias(key)), "jaccard-gone")
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + least(len(w), 3) - 1), ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS r(pos) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), link AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS seen FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen),
root AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
many AS (SELECT a, count(*) AS n_links FROM edge GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.component_id, w.doc_id) AS component_id, coalesce(many.n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.node = w.doc_id LEFT JOIN many ON many.a = w.doc_id
"""
