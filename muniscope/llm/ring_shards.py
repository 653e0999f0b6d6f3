"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on a ring of 64-bit numbers at VIRTUAL_NODES places; a row goes to the first place clockwise from the
hash of its text, so equal texts go together and a shard more or less moves few rows. No shard takes more than its
capacity: rows that overflow continue clockwise to the next shard with room. Without slack the capacities sum to the number of
rows, so counts are at most one apart, whatever the hashes are; with slack ``e`` a shard holds (1 + e) times its share at most.

Between two places (an arc) rows are in order of hash, id and place in the table. Overflow is decided arc by arc from counts
alone: in every round each arc offers what it still has to one shard, that of its own place first, then of the next one
clockwise. So the driver sees counts of arcs and of sorted partitions, a number that does not grow with the rows, and a row's
shard follows from its rank within its arc. Ranks come from one sort by ranges; a text that a third of all rows share is
cut by the rows' own places and flows over as many shards as it takes.

Defined results: a null text has no bytes, is placed as the empty text and has crc32 0; null ids come first; repeated rows are
rows like any other; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise, table, utf8

SHARDS, VIRTUAL_NODES = 16, 512


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """(places, shard of each arc): signed 64-bit numbers in order. An arc ends at its place; the last one, after
    all places, goes on to the first place. A further shard adds places and moves none."""
    names = [(k, v) for k in range(shards) for v in range(virtual_nodes)]
    at = [int.from_bytes(hashlib.blake2b(f"{k}:{v}".encode(), digest_size=8).digest(), "big", signed=True) for k, v in names]
    order = sorted(range(len(at)), key=lambda i: (at[i], names[i]))
    return np.array([at[i] for i in order], dtype=np.int64), np.array([names[i][0] for i in (*order, order[0])], dtype=np.int64)


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows a shard may take: without slack ``rows`` in all, at most one apart."""
    if slack > 0:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def flow(counts: np.ndarray, owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot): where the rows of each arc go.

    Round by round, arcs in ring order offer what they still have to the shard of the next place clockwise."""
    room, filled = list(room), [0] * len(room)
    arcs = len(owner)
    given = np.zeros(arcs, dtype=np.int64)
    at = np.arange(arcs)
    waiting = np.flatnonzero(counts).tolist()
    out = []
    while waiting:
        for a in waiting:
            k = int(owner[at[a]])
            n = min(int(counts[a] - given[a]), room[k] - filled[k])
            if n > 0:
                out.append((a, int(given[a]), int(given[a]) + n, k, filled[k]))
                given[a] += n
                filled[k] += n
            at[a] = (at[a] + 1) % arcs
        waiting = [a for a in waiting if given[a] < counts[a]]
    return out


def ring_shards(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, home, shard, slot) for every row of (doc_id, text).

    home is the shard of the ring alone, shard the one that had room, slot a number from 0 without gaps in it."""
    spark = docs.sparkSession
    ship_package(spark)
    places, owner = ring(shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, h.to_numpy())).astype("int32")

    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(utf8("text")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["h", "doc_id", "row"]
    dealt = narrow.withColumn("arc", arc_of("h")).repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a sorted row: its partition above 33 bits, its place in the partition below.
    placed = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "ring-rows")
    part, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # Partitions are ranges of the ring, so there are no more counts than arcs and partitions together.
    counted = placed.groupBy(part.alias("part"), "arc").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect()
    begin: list[tuple[int, int, int]] = []  # (partition, arc, rank in the arc of its first row there - its place)
    total = np.zeros(len(owner), dtype=np.int64)
    for part_no, arc, n, first in sorted(counted, key=lambda r: r["first"]):
        begin.append((part_no, arc, int(total[arc]) - (first & ((1 << 33) - 1))))
        total[arc] += n
    goes = flow(total, owner, capacities(int(total.sum()), shards, slack))
    shift = spark.createDataFrame(begin, "part int, arc int, shift long")
    goes = spark.createDataFrame(goes, "arc int, low long, high long, shard int, slot long")
    homes = spark.createDataFrame([(a, int(k)) for a, k in enumerate(owner)], "arc int, home int")
    ranked = placed.withColumn("part", part).join(F.broadcast(shift), ["part", "arc"]).withColumn("rank", place + F.col("shift"))
    cut = (F.col("g.arc") == F.col("r.arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    met = ranked.alias("r").join(F.broadcast(goes).alias("g"), cut).select("r.*", "shard", (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"))
    return met.join(F.broadcast(homes), "arc").select("doc_id", "size", "text_crc32", "home", "shard", "slot")


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts are at most one apart; ``home`` tells rows that overflowed."""
    found = ring_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")
