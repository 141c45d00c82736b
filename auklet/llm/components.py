"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.llm.common import small, stored

#: Edges that one task joins, whatever the input's size; more take rounds over all partitions.
FEW_EDGES = 20_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of few edges (a, b), by union with the smaller root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, and then twice that label's own label, so chains
    shrink to a fourth. The smallest is taken by an aggregate that combines before the shuffle, so a node with a third of all edges
    does no harm; in the joins labels have one row a node, so adaptive execution can split the edges of a hub. Labels are
    broadcast where they are few. Rounds end when no label changes. Null ends are ignored; self-edges keep their node.
    FEW_EDGES at most are joined by one task, because rounds would cost more than the work in them.
    """
    edges = stored(edges.select("a", "b").where("a is not null and b is not null"), "edges")
    if edges.count() <= FEW_EDGES:
        return stored(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "labels")
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    hint = small(labels)
    while True:
        near = both.join(hint(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        best = near.join(hint(labels), "node").select("node", F.least("component", "near").alias("best"), F.col("component").alias("old"))
        up, top = (labels.select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("best", "upper"), ("upper", "top")))
        moved = stored(best.join(hint(up), "best").join(hint(top), "upper").select("node", F.col("top").alias("component"), "old"), "labels")
        if moved.where("component <> old").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")


def regrouped(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups (node, component) after further edges, whose ends may be new nodes; both are stored.

    Only components that an edge joins are looked at: edges become edges between components, which are few once most of
    a graph is known.
    """
    if edges.isEmpty():
        return groups
    hint = small(groups)
    of = lambda c: hint(groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")))
    known = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(*[F.coalesce(f"of_{c}", c).alias(c) for c in "ab"])
    joined = components(known)  # a component is its smallest node, so what isn't a node yet is a new one
    hint, names = small(joined), joined.select(F.col("node").alias("component"), F.col("component").alias("new_"))
    moved = groups.join(hint(names), "component", "left").select("node", F.coalesce("new_", "component").alias("component"))
    fresh = joined.join(small(groups)(groups.select("node")), "node", "left_anti").select("node", "component")
    return stored(moved.union(fresh), "groups")
