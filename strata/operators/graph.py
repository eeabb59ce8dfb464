"""Connected components by repeated contraction.

Each round points every node at its smallest neighbour, follows such pointers once more,
renames the edges' ends and drops those that became loops; so the edge table shrinks, and a
chain's length falls by a factor each round.  Once no more than ``SMALL`` edges are left, one
task of that bounded size solves the rest, which saves the last rounds' many small jobs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.plans.lineage import durable

SMALL = 1 << 20


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    to = np.arange(len(nodes))
    while len(x):
        low = np.minimum(to[x], to[y])
        for spot in (to[x], to[y]):  # only roots are hooked, so no pointer that joins two nodes is lost
            np.minimum.at(to, spot, low)
        while (to[to] < to).any():
            to = to[to]
        open_ = to[x] != to[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[to]


def _solved(edges: DataFrame) -> DataFrame:
    def run(it):
        import pyarrow as pa

        batches = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in it]
        if batches:
            nodes, to = solve(*(np.concatenate(c) for c in zip(*batches, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(to, pa.int64())], ["node", "to"])

    return edges.coalesce(1).mapInArrow(run, "node long, to long")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``edges``: columns a, b (long).  Returns ``node, component`` (the smallest node reachable) for all nodes with an edge to another.

    Loops, nulls and repeated edges are ignored; an empty table gives an empty table.  ``small``: the most edges that one task takes.
    """
    left = durable(edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    labels = None
    while n := left.count():
        if n <= small:
            near = durable(_solved(left))
        else:
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("to"))
            further = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
            near = durable(near.join(further, "to").select("node", F.col("next").alias("to")))
        if labels is None:
            labels = near.select("node", F.col("to").alias("component"))
        else:
            moved = near.select(F.col("node").alias("component"), F.col("to").alias("next"))
            labels = durable(labels.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        if n <= small:
            return labels
        to_a, to_b = near.select(F.col("node").alias("a"), F.col("to").alias("ta")), near.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = durable(left.join(to_a, "a").join(to_b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
