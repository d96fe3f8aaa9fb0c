"""Connected components of an edge table by contracting neighbourhoods.

An edge goes to the partitions of both its ends. A partition joins what its edges connect (a
vectorised union of whatever met there, not of single neighbourhoods) and replaces the edges by
stars around the least node. That is repeated until no partition finds a new edge; then every node
has one edge, to the least node of its component. A round is one exchange of two numbers an edge;
it is written to the shared folder, and only a count reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

EDGES = "a long, b long, fresh boolean"


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node but the least ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # Labels of both ends and of their present labels go down; then each label is followed once.
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches):
    """Stars of the edges (a, b, end) of a partition, ``end`` being what brought an edge here.

    An edge that was here before and belongs to a node that is looked after elsewhere is left to
    that partition, so a star isn't written by both its centre's partition and its leaves'.
    """
    found = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not found:
        return
    a, b, end = (np.concatenate(x) for x in zip(*found, strict=True))
    node, least = local_stars(a, b)
    kind = np.dtype([("a", np.int64), ("b", np.int64)])
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    made = np.ascontiguousarray(np.stack([node, least], axis=1)).view(kind).ravel()
    fresh = ~np.isin(made, np.ascontiguousarray(pairs).view(kind).ravel())
    kept = fresh | np.isin(node, end)
    yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(least[kept]), pa.array(fresh[kept])], names=["a", "b", "fresh"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b of long); label is the smallest node that can be reached.

    The first round goes by ``b`` alone: where ``a`` are centres and ``b`` members, a member's
    several centres become one edge for it and few between centres. Leaves, which then have one edge
    and are nobody's centre, wait for their centre's label; only the rest takes part in the rounds,
    so a centre's many leaves never meet in one task.
    """
    first = edges.where("a <> b").select("a", "b", F.col("b").alias("end")).repartition("end")
    now = shared.materialize(first.mapInArrow(_contract, EDGES), name).select("a", "b")
    centres = now.select(F.col("b").alias("a")).distinct()
    single = now.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1").select("a", "b")
    leaves = shared.materialize(single.join(centres, "a", "left_anti"), f"{name}-leaves")
    now = shared.materialize(now.join(leaves.select("a"), "a", "left_anti"), f"{name}-inner")
    while not now.isEmpty():
        both = now.select("a", "b", F.explode(F.array("a", "b")).alias("end"))
        new = shared.materialize(both.repartition("end").mapInArrow(_contract, EDGES), name)
        now = new.select("a", "b")
        if new.where("fresh").isEmpty():
            break
    inner = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    inner = inner.union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
    inner = shared.materialize(inner.union(centres.select(F.col("a").alias("node")).join(inner, "node", "left_anti").select("node", F.col("node").alias("label"))), f"{name}-inner-labels")
    outer = leaves.join(inner.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
    return inner.union(outer)
