"""Connected components by min-label hooking and pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is its component's least node.

    Each round links every node's root to the least root beside it, then jumps pointers
    once, so path lengths shrink geometrically; state is written to the shared folder
    every round and deleted when the next one stands. A node with many edges meets map-side
    minima; the joins of all nodes with their roots are written as they come, so AQE can
    split the side of a giant component's root.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = materialise(both, f"{tag}-edges")
    label = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    # First labels: the least neighbour at hand.
    first = both.groupBy("a").agg(F.min("b").alias("root"))
    state = materialise(
        label.join(first, label["node"] == first["a"], "left").select(
            "node", F.coalesce("root", F.col("node")).alias("root")
        ),
        f"{tag}-labels",
    )
    live = both
    while True:
        # Edges between roots; an edge inside a component is finished.
        left = state.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = state.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        before, live = live, (
            live.join(left, "a")
            .join(right, "b")
            .where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
            .distinct()
        )
        live = materialise(live, f"{tag}-live")
        discard(before)
        hook = live.groupBy("a").agg(F.min("b").alias("to"))
        hooked = (
            state.join(hook, state["root"] == hook["a"], "left")
            .select("node", F.coalesce("to", "root").alias("root"))
        )
        hooked = materialise(hooked, f"{tag}-hooked")
        up = hooked.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = materialise(
            hooked.join(up, hooked["root"] == up["_n"], "left").select(
                "node", F.coalesce("_r", F.col("root")).alias("root")
            ),
            f"{tag}-labels",
        )
        up = jumped.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        unsettled = jumped.join(up, jumped["root"] == up["_n"]).where("root <> _r").limit(1).count()
        discard(state, hooked)
        state = jumped
        if not unsettled and live.limit(1).count() == 0:
            discard(live)
            return state
