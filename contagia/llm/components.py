"""Connected components of an edge table, by alternating large and small stars.

Each round is a grouped minimum and a join on the shared folder's copy of the
edges. A hub with a large share of the edges is split by the salted join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contagia.functions.joins import spread_join
from contagia.llm.common import stash
from contagia.sources.workspace import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b).

    The large step looks at all neighbours of a node and moves the greater ones
    to the least; the small step does so for the lesser ones and the node.
    """
    pairs = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m") if large else F.col("m"))
    met = spread_join(pairs, least, ["a"], ["b"])
    moved = met.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.where("a <> m").select("a", F.col("m").alias("b"))
    return moved.unionByName(kept).where("a <> b").distinct()


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not the least of its component."""
    step = 0
    current = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    workspace, "edges")
    while True:
        after = stash(_star(_star(current, True), False), workspace, f"stars{step}")
        # Stable once every node hangs on one root and no root hangs on another.
        state = after.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        hanging = after.select("a").join(after.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        if state.n == state.nodes and hanging:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current, step = after, step + 1
