"""Isolation forest: trees grown on a bounded sample, every row scored in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import quantiles
from .graph import shared_table

TREES, SAMPLE, SEED = 150, 256, 42


def path_norm(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # at leaves: depth and what is below


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    nodes: list[list[float]] = []
    limit = math.ceil(math.log2(max(len(x), 2)))

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, depth + path_norm(len(rows))])
        spread = np.flatnonzero(x[rows].max(axis=0) > x[rows].min(axis=0)) if len(rows) else []
        if depth < limit and len(rows) > 1 and len(spread):
            f = int(rng.choice(spread))
            low, high = x[rows, f].min(), x[rows, f].max()
            cut = float(rng.uniform(low, high))
            under = x[rows, f] <= cut
            nodes[at][:4] = [f, cut, build(rows[under], depth + 1), build(rows[~under], depth + 1)]
        return at

    build(np.arange(len(x)), 0)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])


def in_one(trees: list[Tree]) -> tuple[Tree, np.ndarray, int]:
    """All trees in one, their roots, and the steps that reach every leaf. A leaf leads to itself, so all rows go down all
    trees together, step by step."""
    sizes = [len(t.feature) for t in trees]
    starts = np.cumsum([0, *sizes[:-1]])
    leaf = np.concatenate([t.feature < 0 for t in trees])
    feature = np.where(leaf, 0, np.concatenate([t.feature for t in trees]))
    left, right = (np.concatenate([getattr(t, c) + at for t, at in zip(trees, starts)]) for c in ("left", "right"))
    whole = Tree(feature, np.concatenate([t.cut for t in trees]), left, right, np.concatenate([t.length for t in trees]))
    at, steps = starts, 0
    while not leaf[at].all():
        at, steps = np.concatenate([left[at], right[at]]), steps + 1
        at = np.unique(at)
    return whole, starts, steps


def mean_depth(x: np.ndarray, whole: Tree, roots: np.ndarray, steps: int) -> np.ndarray:
    """The mean path length of each row over all trees, for a few thousand rows at a time."""
    out = np.empty(len(x))
    for begin in range(0, len(x), 2048):
        part = x[begin : begin + 2048]
        row = np.arange(len(part))[:, None]
        at = np.repeat(roots[None, :], len(part), axis=0)
        for _ in range(steps):
            at = np.where(part[row, whole.feature[at]] <= whole.cut[at], whole.left[at], whole.right[at])
        out[begin : begin + 2048] = whole.length[at].mean(axis=1)
    return out


def isolation_scores(df: DataFrame, key: str, features: list[str], contamination: float = 0.05) -> DataFrame:
    """(key, score, flag): robustly scaled features, a score per row, the top ``contamination`` share flagged.

    Each of TREES trees needs SAMPLE rows, so TREES * SAMPLE rows first by a hash are the sample, a bound that
    does not grow with the data; quartiles and the score's cut-off are exact over all rows."""
    ship_package(df.sparkSession)
    rows = df.select(key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).alias("v")) for i, f in enumerate(features)))))
    found = quantiles.grouped_percentiles(long, "v", ["f"], {"low": 0.25, "middle": 0.5, "high": 0.75}).orderBy("f").collect()
    if not found:
        return rows.select(key, F.lit(0.0).alias("score"), F.lit(False).alias("flag"))
    quartiles = [(r.low, r.middle, r.high) for r in found]
    middle = np.array([q[1] for q in quartiles])
    spread = np.array([(q[2] - q[0]) or 1.0 for q in quartiles])
    chosen = rows.orderBy(F.xxhash64(F.col(key), F.lit(SEED)), key).limit(TREES * SAMPLE).select(*features).toPandas()
    x = (chosen.to_numpy(dtype=float) - middle) / spread
    rng = np.random.default_rng(SEED)
    trees = [grow(x[rng.choice(len(x), min(SAMPLE, len(x)), replace=False)], rng) for _ in range(TREES)]
    norm = path_norm(min(SAMPLE, len(x))) or 1.0
    whole = in_one(trees)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        v = (np.column_stack([c.to_numpy(dtype=float) for c in columns]) - middle) / spread
        return pd.Series(2.0 ** (-mean_depth(v, *whole) / norm))

    scored = shared_table(rows.select(key, score(*features).alias("score")), "forest")  # read twice
    cut = quantiles.grouped_percentiles(scored, "score", [], {"cut": 1 - contamination})
    return scored.withColumn("flag", F.col("score") > cut.scalar())
