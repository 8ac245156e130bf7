"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orequarry.llm.storage import materialize

#: Edges of which one task makes a forest; its memory is bounded by them.
TASK_EDGES = 500_000


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) with the same components as the edges a-b, at most one per node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (rx := find(x)) != (ry := find(y)):
            parent[max(rx, ry)] = min(rx, ry)
    nodes = list(parent)
    return np.array(nodes, np.int64), np.array([find(x) for x in nodes], np.int64)


def _contract(batches):
    """A spanning forest of the edges that one task holds."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column("u").to_numpy())
        b.append(batch.column("v").to_numpy())
    if a:
        u, v = spanning_edges(np.concatenate(a), np.concatenate(b))
        keep = u != v
        yield pa.RecordBatch.from_arrays([pa.array(u[keep], pa.int64()), pa.array(v[keep], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component (its smallest node): one row per node of edges(a long, b long).

    Rows with a null end and loops are left out; repeated edges count once; no edges give no rows.
    Tasks of about `task_edges` edges first reduce them to spanning forests; the forest of a single task
    is the answer. Else a round is two aggregations by node, each written to the shared folder and
    joined back, with map-side combining and partitions that adaptive execution can split, so a node
    with very many neighbours is not gathered in one task.
    """
    two = "u long, v long"
    start = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    tasks = -(-max(1, start.count()) // task_edges)
    now = materialize(start.repartition(tasks).mapInArrow(_contract, two))
    while tasks > 1:
        # done when every node points at one node that points nowhere
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.select("v", F.lit(0), F.lit(1)))
        open_ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)")
        if open_ends.isEmpty():
            break
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct().mapInArrow(_contract, two))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
