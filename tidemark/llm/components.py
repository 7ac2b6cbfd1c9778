"""Connected components: union-find within partitions, then rounds of minimum parents over what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, written


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node that each is connected with."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]] if len(nodes) else nodes


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as one edge from every node to the least that it is connected with."""
    for batch in batches:
        nodes, root = union_find(*(batch.column(i).to_numpy() for i in range(2)))
        away = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(root[away])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of every node in edges (two long columns) the least node that it is connected with.

    Each round points every node to its least neighbour, follows the pointers twice more and contracts the edges, so
    rounds grow with the logarithm of the longest path. Tables between rounds are written to the shared folder and deleted
    when the result, a table there too, is written. Hubs are aggregated before the shuffle and joined on unique keys.
    Self-loops give nothing.
    """
    edges = edges.toDF("a", "b").where("a <> b")
    edges = written(edges.mapInArrow(_forest, "a long, b long"), "edges")
    labels, parents = None, []
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("next"))
            parent = parent.join(above, "up").select("node", F.col("next").alias("up"))
        parent = written(parent, "parents")
        parents.append(parent)
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "up")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        down = parent.select(F.col("node").alias("a"), F.col("up").alias("x"))
        over = parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        contracted = edges.join(down, "a").join(over, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        fresh = written(contracted, "edges")
        drop_written(edges)
        edges = fresh
    out = written(labels, "components")
    for table in (edges, *parents):
        drop_written(table)
    return out
