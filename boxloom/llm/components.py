"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Between rounds each task replaces the edges that it holds by stars around the smallest node that they reach, in bounded
chunks, so that few rounds are left. Edges are stored as tables and not checkpointed: a small table is read in few tasks, while
a checkpoint keeps the partitions of its last shuffle, and tables that nothing reads any more are deleted at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, released, written

#: A task contracts its edges in chunks of about this many.
CHUNK = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, centre) of the nodes that these edges link to a smaller one: the smallest that they reach."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        new = root.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, root):
            break
        root = new
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges (u, v) of each task's chunks as stars, stored."""

    def contract(batches):
        def out():
            node, centre = stars(*(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(centre, pa.int64())], names=["u", "v"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return written(edges.mapInArrow(released(contract), "u long, v long"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) pairs of longs -> (node, component): the smallest node that each linked node can reach, a stored table.

    Nodes without a link do not appear. Each round is two aggregates and two joins on the edges; a star's centre is
    reduced to its minimum first, in a table of its own, so that the join can split the edges of a hub over many tasks.
    Rounds end when each node either has larger neighbours only, or one smaller and no other.
    """
    edges = _contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(rounds):
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = written(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), ((F.min("v") < F.col("u")) & (F.min("v") < F.max("v"))).alias("open")))
        if low.where("open").isEmpty():
            discard(edges)
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = written(edges.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")))
        discard(edges)
        discard(low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        small = written(small.select("e.u", "e.v").where("u <> v").distinct())
        discard(large)
        discard(low)
        edges = _contracted(small)  # of the stored table: in fewer and larger parts than the shuffle's
        discard(small)
    raise RuntimeError(f"no star forest after {rounds} rounds")
