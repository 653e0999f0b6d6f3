"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon, the share of lexicon words near a
second-person pronoun, rates of capitals, punctuation and obfuscation. The lexicon is
learned: words and word beginnings that are far likelier in toxic training texts. While
fitting, a text is measured with the lexicon of the other half of the training rows, so the
trees see densities as they will be on new texts. The calibration map comes from
out-of-fold scores.

Fitting uses at most TRAIN_ROWS labelled rows, those first by a hash of their id, one text for
each (of repeated ids the least text); counts for the lexicon are made on the executors, and
at most LEXICON terms and TRAIN_ROWS rows of features reach the driver.
Scoring covers every row and the whole text.

Other columns of a table are not read and may have any name; the pipeline stage passes them on as they are.

Defined results: null and empty texts have zero features and get a score like any other;
without labelled texts of both kinds every score is 0; null labels are no labels; a null id
is not held out; repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow, map_rows, materialise, record_batch, table, utf8

TRAIN_ROWS = 20_000
LEXICON = 2_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
FOLDS = 3

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro".split()
)
FEATURES = (
    "lexicon_weight", "lexicon_density", "lexicon_strong", "lexicon_distinct", "lexicon_most", "lexicon_surest",
    "surest_density", "near_second_person",
    "second_person", "capitals", "shouting", "punctuation", "exclamations", "obfuscation", "digits", "log_words",
)

_SPACED = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_UPPER = bytes(range(0x41, 0x5B))
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD = re.compile(rb"[a-z][0-9@$*!#]+[a-z]|(?<![a-z])(?:[a-z][.\-_ ]){3,}[a-z](?![a-z])|([a-z])\1{3,}")
_SHOUT = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
_PREFIXES = (4, 5, 6)


def words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_SPACED).split()


def terms(word: bytes) -> list[str]:
    """A word and its beginnings, which stand for its inflected forms."""
    w = word.decode("utf-8", "replace")
    return [w, *(f"{w[:n]}*" for n in _PREFIXES if len(w) >= n)]


class Weights(dict):
    """Lexicon weight of a word, worked out once for each word seen."""

    MOST = 100_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.sure = 0.75 * max(lexicon.values(), default=math.inf)

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        return value


_you = frozenset(w.encode() for w in SECOND_PERSON)


def features(text: bytes, weights: Weights) -> list[float]:
    found = words(text)
    n = len(found)
    size = max(len(text), 1)
    w = np.fromiter(map(weights.__getitem__, found), dtype=np.float64, count=n)
    hits = np.flatnonzero(w)
    near = second = 0.0
    if not _you.isdisjoint(found):
        you = np.array([i for i, x in enumerate(found) if x in _you])
        second = you.size / n
        if hits.size:
            after = np.searchsorted(you, hits)
            gap = np.minimum(
                np.abs(hits - you[np.minimum(after, you.size - 1)]), np.abs(hits - you[np.maximum(after - 1, 0)])
            )
            near = float((gap <= 5).mean())
    low = text.lower()
    letters = size - len(text.translate(None, _UPPER))
    strong = w[hits] >= 2.0
    surest = hits[w[hits] >= weights.sure]
    return [
        float(w.sum()) / max(n, 1),
        hits.size / max(n, 1),
        float(strong.sum()) / max(n, 1),
        float(len({found[i] for i in hits.tolist()})),
        float(w.max()) if n else 0.0,
        float(len({found[i] for i in surest.tolist()})),
        surest.size / max(n, 1),
        near,
        second,
        letters / size,
        len(_SHOUT.findall(text)) / max(n, 1) if letters > 2 else 0.0,
        (size - len(text.translate(None, _PUNCT))) / size,
        text.count(b"!") / max(n, 1),
        len(_ODD.findall(low)) / max(n, 1),
        (size - len(text.translate(None, b"0123456789"))) / size,
        math.log1p(n),
    ]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth, stored as complete binary trees."""

    split: list[np.ndarray] = field(default_factory=list)  # feature of each inner node
    cut: list[np.ndarray] = field(default_factory=list)  # goes right when the value is above
    leaf: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, split[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on quantile histograms with second-order leaf values."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(base=math.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Where most values are equal the quantiles are too: add some among the rest.
    edges = [
        np.unique(np.concatenate([e, np.quantile(c[c > 0], np.linspace(0, 0.9, 9))])) if (c > 0).any() else e
        for e, c in zip(edges, x.T)
    ]
    width = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n, f = x.shape
    score = np.full(n, model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        split, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            slot = (((node - first)[:, None] * f + np.arange(f)) * width + binned).ravel()
            hist = [
                np.bincount(slot, np.repeat(v, f), many * f * width).reshape(many, f, width).cumsum(axis=2)
                for v in (g, h)
            ]
            gl, hl = hist[0][:, :, :-1], hist[1][:, :, :-1]
            gt, ht = hist[0][:, :, -1:], hist[1][:, :, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                feature, at = divmod(b, width - 1)
                if gain[k, feature, at] > 1e-6 and at < len(edges[feature]):
                    split[first + k], cut[first + k] = feature, edges[feature][at]
            node = 2 * node + 1 + (x[np.arange(n), split[node]] > cut[node])
        at = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        score = score + leaf[at]
        model.split.append(split)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; knots (score, probability) to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of scores
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([t, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    knots = np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
    return knots


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


_HALF = 2


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, _b, toxic, half): the labelled texts to learn from."""
    key = F.col("doc_id").cast("string")
    usable = labels.where(F.col("toxic").isNotNull() & (F.crc32(key) % 3 != 1))
    # A sample of a stated size is small enough to send to every executor.
    chosen = usable.select(
        F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64(key).alias("_h")
    ).orderBy("_h", "_id", "toxic").limit(TRAIN_ROWS)
    half = F.pmod(F.shiftright("_h", 7), F.lit(_HALF)).cast("int")
    rows = docs.select("doc_id", utf8().alias("_b")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "toxic", half.alias("half")).agg(F.min("_b").alias("_b"))
    return one.select("doc_id", "_b", "toxic", "half")


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, half, toxic, n): in how many training texts a term stands."""
    schema = pa.schema([("term", pa.string()), ("half", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total.update((t, half, toxic) for t in {t for w in set(words(text)) for t in terms(w)})
            if len(total) > 300_000:
                yield record_batch(schema, *zip(*((*k, n) for k, n in total.items()), strict=True))
                total = Counter()
        if total:
            yield record_batch(schema, *zip(*((*k, n) for k, n in total.items()), strict=True))

    bound_arrow(rows.sparkSession)
    found = rows.select("_b", "toxic", "half").mapInArrow(count, "term string, half int, toxic int, n long")
    return found.groupBy("term", "half", "toxic").agg(F.sum("n").alias("n"))


def learn_lexicons(rows: DataFrame) -> tuple[list[dict[str, float]], dict[str, float]]:
    """A lexicon from each half, and one from all rows."""
    sizes = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = _term_counts(rows).groupBy("term").agg(
        *(
            F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{h}{t}")
            for h in range(_HALF)
            for t in (0, 1)
        )
    )
    wide = materialise(wide.where(" + ".join(f"n{h}1" for h in range(_HALF)) + " >= 2"), "toxicity-terms")

    def lexicon(halves: list[int]) -> dict[str, float]:
        pos, neg = (sum(sizes.get((h, t), 0) for h in halves) for t in (1, 0))
        a, b = (sum((F.col(f"n{h}{t}") for h in halves), F.lit(0)) for t in (1, 0))
        weight = F.log((a + 0.5) / (pos + 1.0)) - F.log((b + 0.5) / (neg + 1.0))
        support = max(2, round(0.004 * pos))
        best = wide.select("term", weight.alias("w"), a.alias("a")).where((F.col("a") >= support) & (F.col("w") > 1.0))
        rank = F.col("w") * F.sqrt("a")
        return {r.term: float(r.w) for r in best.orderBy(rank.desc(), "term").limit(LEXICON).collect()}

    return [lexicon([h]) for h in range(_HALF)], lexicon(list(range(_HALF)))


def _measure(rows: DataFrame, lexicons: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds of the training rows, each with the other half's lexicon."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batch):
        known = [Weights(x) for x in lexicons]
        x = [features(t, known[1 - h]) for t, h in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
        return record_batch(schema, batch.column(0), batch.column(2), x)

    got = map_rows(rows, run, "doc_id long, toxic int, x array<double>")
    data = got.orderBy("doc_id", "toxic").toArrow()  # TRAIN_ROWS short rows at most
    x = np.array(data["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    fold = np.arange(len(x)) % FOLDS
    return x, data["toxic"].to_numpy().astype(np.float64), fold


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = materialise(training_rows(docs, labels), "toxicity-train")
    lexicons, lexicon = learn_lexicons(rows)
    x, y, fold = _measure(rows, lexicons)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, None, None)
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        out = fold == k
        rest = y[~out]
        raw[out] = fit_trees(x[~out], rest).raw(x[out]) if len(rest) else 0.0
    return Model(lexicon, fit_trees(x, y), isotonic(raw, y))


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of LEXICON terms and TREES small trees
    held: list[Weights] = []

    def rows(batch):
        known = sent.value
        if not held:
            held.append(Weights(known.lexicon))
        x = np.array([features(t, held[0]) for t in batch.column(1).to_pylist()])
        return record_batch(SCORES, batch.column(0), known.score(x))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_b"))
    return map_rows(source, rows, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text is scored at the threshold or above go, each judged by itself,
    so rows without an id or with a repeated one need no other rule."""
    sent = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")
    held: list[Weights] = []

    def rows(batch):
        if not held:
            held.append(Weights(sent.value.lexicon))
        x = np.array([features((t or "").encode(), held[0]) for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array(sent.value.score(x) < THRESHOLD))

    return map_rows(docs, rows, docs.schema)
