"""Connected components by local union-find and contraction; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges (16 bytes each) that one task may finish alone; more are contracted in rounds first.
ONE_TASK_EDGES = 1_000_000


def union_find(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each node's component), by hooking and path halving on whole arrays."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v = at[: len(src)], at[len(src) :]
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return nodes, nodes[parent]
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as a forest of depth one, kept small while they come in."""
    nodes = roots = np.empty(0, np.int64)
    for b in batches:
        src, dst = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(src):
            nodes, roots = union_find(np.concatenate([nodes, src]), np.concatenate([roots, dst]))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "label"])


def connected_components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """edges (two long columns without nulls) to (node, label): label is the component's smallest node.

    Nodes without an edge don't appear; an empty input gives an empty frame. Each round
    links a node with its smallest neighbour, jumps twice, and keeps the edges between
    what is still apart, so their number falls at least by half.
    """
    a, b = edges.columns
    forest = edges.mapInArrow(_forest, "node long, label long")
    maps: list[DataFrame] = []
    while True:
        forest = scratch.table(forest.where("node != label"), "edges")
        n = forest.count()
        if n <= one_task:
            maps.append(forest.coalesce(1).mapInArrow(_forest, "node long, label long"))
            break
        both = forest.unionByName(forest.select(F.col("label").alias("node"), F.col("node").alias("label")))
        up = both.groupBy("node").agg(F.least("node", F.min("label")).alias("label"))
        up = scratch.table(up, "parents")
        for _ in range(2):
            over = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
            up = scratch.table(up.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "parents")
        maps.append(up)
        left = forest.join(up.withColumnRenamed("label", "p"), "node").select("label", "p")
        left = left.join(up.select(F.col("node").alias("label"), F.col("label").alias("q")), "label")
        forest = left.where("p != q").select(F.greatest("p", "q").alias("node"), F.least("p", "q").alias("label")).distinct()
        forest = forest.mapInArrow(_forest, "node long, label long")
    out = maps[0]
    for deeper in maps[1:]:
        over = deeper.select(F.col("node").alias("label"), F.col("label").alias("top"))
        out = out.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return out
