"""Exact top-k search by inner product: a ball tree per shard, branch and bound, shared k-th scores.

Vectors are dealt into cells by the nearest of some pivot vectors (at most ``PIVOTS``, drawn from the table), and large cells
into shards of about ``shard_rows`` rows. A cell is a ball around its pivot; these balls are few enough for every task to
know them all. A shard's task builds a ball tree and answers a stream of query blocks by descent from the root, always
into the open node of the greatest upper bound ``q . centre + |q| * radius``, until no open node's bound reaches the
query's k-th score.

That score is shared between three rounds: each query is answered in its own cell, then in the other cell of the greatest
bound, and then in those cells alone whose bounds reach the k-th score found so far.

A shard's task holds its own rows and one block of queries. Equal vectors of a shard are one point of the tree with its
k + 1 smallest ids, which are all that a result can name, so a vector that fills a third of the table costs nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, released, shuffle_partitions

#: At most so many cells; their pivots and radii are sent to every task.
PIVOTS = 1024
#: Inner products stay below this, so that they are exact as whole numbers and as bounds.
LARGEST = 2.0**53


class BallTree:
    """Balls over the rows of an integer matrix: node arrays, and the rows in leaf order."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        x = points.astype(np.float64)
        self.rows = np.arange(len(x))
        centres, radii, parents, spans = [], [], [], []
        stack = [(0, len(x), -1)]
        self.leaves: list[int] = []
        while stack:
            lo, hi, parent = stack.pop()
            own = x[self.rows[lo:hi]]
            centre = own.mean(axis=0)
            node = len(centres)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            parents.append(parent)
            spans.append((lo, hi))
            if hi - lo <= leaf or radii[-1] == 0:
                self.leaves.append(node)
                continue
            a = own[((own - centre) ** 2).sum(axis=1).argmax()]  # two far points span the split
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            side = own @ (b - a)
            order = np.argsort(side, kind="stable")
            self.rows[lo:hi] = self.rows[lo:hi][order]
            mid = (lo + hi) // 2
            stack += [(lo, mid, node), (mid, hi, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.parents, self.spans = parents, spans
        self.children: list[list[int]] = [[] for _ in parents]
        for node, parent in enumerate(parents):
            if parent >= 0:
                self.children[parent].append(node)
        self.sorted = points[self.rows]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds (queries x nodes) of the inner product, never above an ancestor's; a little slack for rounding."""
        ub = queries @ self.centres.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radii
        ub += 1e-9 * np.abs(ub) + 1e-6
        for node, parent in enumerate(self.parents):  # parents come first
            if parent >= 0:
                np.minimum(ub[:, node], ub[:, parent], out=ub[:, node])
        return ub


class Shard:
    """One shard's distinct vectors, with the smallest ids of each, and the tree over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids)
        v, i = vectors[order], ids[order]
        first = np.concatenate(([True], (v[1:] != v[:-1]).any(axis=1)))
        at = np.flatnonzero(first)
        self.k = k
        self.ids = [i[a : min(b, a + k + 1)] for a, b in zip(at, [*at[1:], len(i)])]
        self.tree = BallTree(v[at])
        self.of_row = [self.ids[r] for r in self.tree.rows]
        self.least = np.array([x[0] for x in self.of_row])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query_id, vec_id, score): each query's k best here of at least its floor, the query's own id apart."""
        tree, k = self.tree, self.k
        ub = tree.bounds(queries.astype(np.float64))
        for q, (own, query) in enumerate(zip(query_ids, queries)):
            kth, best, bound = floors[q], [], ub[q].tolist()
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= kth:
                _, node = heappop(heap)
                if tree.children[node]:
                    for child in tree.children[node]:
                        if bound[child] >= kth:
                            heappush(heap, (-bound[child], child))
                    continue
                lo, hi = tree.spans[node]
                scores = tree.sorted[lo:hi] @ query
                for j in np.flatnonzero(scores >= kth):
                    best += [(-int(scores[j]), int(i)) for i in self.of_row[lo + j] if i != own]
                if len(best) > k:
                    best = sorted(best)[:k]
                if len(best) == k:
                    kth = max(kth, -max(best)[0])
            for s, i in sorted(best)[:k]:
                yield int(own), i, -s


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows that are null or hold null or non-finite ones are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def placed(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, list[list[int]]]]:
    """The rows with the number of the nearest pivot of their length (cell) and the distance to it; the pivots by
    length. Pivots are the vectors of the least hashes of ids, at most PIVOTS in all, one for ``shard_rows`` rows."""
    rows = checkpointed(rows)
    size = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))  # whole numbers that are too large are as large as they can be
    total, most = rows.agg(F.count(F.lit(1)), F.max(F.col("dim") * size * size)).first()
    if most is not None and most >= LARGEST:
        raise ValueError(f"inner products may reach {most:.3g}, beyond what is exact here (2^53): use a smaller scale or smaller vectors")
    most = max(1, min(PIVOTS, -(-total // shard_rows)))
    pivots: dict[int, list[list[int]]] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * most).collect():  # equal vectors are drawn, but not used, twice
        own = pivots.setdefault(r["dim"], [])
        if sum(map(len, pivots.values())) < most and r["v"] not in own:
            own.append(r["v"])

    def nearest(batches):
        for batch in batches:
            n, vectors = batch.num_rows, batch.column("v").to_pylist()
            dims = np.array(batch.column("dim").to_pylist(), dtype=np.int64)
            cell, far = np.zeros(n, dtype=np.int32), np.zeros(n)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.array([vectors[i] for i in at], dtype=float).reshape(len(at), -1)
                own = pivots.get(int(d)) or [[0] * int(d)]
                c = np.array(own, dtype=float).reshape(len(own), int(d))
                square = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
                cell[at] = square.argmin(axis=1)
                far[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(axis=1))
            yield batch.append_column("cell", pa.array(cell)).append_column("far", pa.array(far))

    out = checkpointed(rows.mapInArrow(released(nearest), "vec_id long, v array<long>, dim int, cell int, far double"))
    for r in rows.select("dim").distinct().collect():  # the lengths of vectors that there are
        if not pivots.get(r["dim"]):
            pivots[r["dim"]] = [[0] * r["dim"]]
    return out, pivots


def numbered_cells(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """dim, cell, radius, parts (the shards of the cell) and first (the number of its first shard), a row for each cell; the
    number of shards."""
    own, shards = [], 0
    for r in rows.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("dim", "cell").collect():
        parts = -(-r["n"] // shard_rows)
        own.append((r["dim"], r["cell"], r["radius"], shards, parts))
        shards += parts
    return rows.sparkSession.createDataFrame(own, "dim int, cell int, radius double, first int, parts int"), shards


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query row, ties to the smaller id.

    ``is_query`` is a condition on the column vec_id. Vectors that are null, or hold null or non-finite components,
    take no part; a vector meets those of its own length only. Rows without an id take no part. Of rows that repeat an
    id, each is a candidate for other queries, and each query id is answered once, for its least vector. An empty table
    gives an empty result; other columns are ignored. Vectors so large that an inner product may reach 2^53 (length times
    the square of the greatest component) are refused with a ValueError.
    """
    rows = integer_vectors(table, id_col, vector_col, scale).where("vec_id is not null").withColumn("dim", F.size("v"))
    rows, pivots = placed(rows, shard_rows)
    cells, shards = numbered_cells(rows, shard_rows)
    rows = rows.join(F.broadcast(cells.select("dim", "cell", "first", "parts")), ["dim", "cell"])  # at most PIVOTS rows and one a length
    rows = checkpointed(rows.select("vec_id", "v", "dim", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard")))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "cell")).alias("x")).select("vec_id", "x.*")
    queries = checkpointed(queries)
    parts = max(1, min(shards, 4 * shuffle_partitions(table.sparkSession)))
    balls = {(r["dim"], r["cell"]): (r["first"], r["parts"], r["radius"]) for r in cells.collect()}

    def answer(batches):
        """A partition holds, in order, each shard's rows (kind 0) and then its queries (kind 1)."""
        at, ids, vectors, shard = None, [], [], None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("dim", "shard", "kind", "vec_id", "floor", "v")]
            out: list[tuple[int, int, int]] = []
            asked: list[tuple] = []

            def flush():
                nonlocal shard
                if asked and ids:
                    if shard is None:
                        shard = Shard(np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.int64).reshape(len(ids), -1), k)
                    for a in range(0, len(asked), block):
                        q, f, v = zip(*asked[a : a + block])
                        low = np.array([-np.inf if x is None else x for x in f], dtype=float)
                        out.extend(shard.search(np.array(q, dtype=np.int64), np.array(v, dtype=np.int64).reshape(len(q), -1), low))
                asked.clear()

            for dim, own, kind, vec_id, floor, v in zip(*cols):
                if (dim, own) != at:
                    flush()
                    at, ids, vectors, shard = (dim, own), [], [], None
                if kind == 0:
                    ids.append(vec_id)
                    vectors.append(v)
                else:
                    asked.append((vec_id, floor, v))
            flush()
            yield pa.RecordBatch.from_pydict(
                {c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))}
            )

    def search(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score from the shards that the queries (dim, shard, vec_id, floor, v) name."""
        both = rows.select("dim", "shard", F.lit(0).alias("kind"), "vec_id", F.lit(None).cast("double").alias("floor"), "v").unionByName(
            asked.select("dim", "shard", F.lit(1).alias("kind"), "vec_id", "floor", "v")
        )
        dealt = both.withColumn("part", F.col("shard") % parts).repartitionById(parts, "part").drop("part").sortWithinPartitions("dim", "shard", "kind", "vec_id")
        return dealt.mapInArrow(released(answer), "query_id long, vec_id long, score long")

    def routed(asked: DataFrame, which: str) -> DataFrame:
        """A row for each shard of the cells that each query visits: its own, the best other one, or the rest that can matter."""

        def route(batches):
            of_dim = {d: ([c for x, c in balls if x == d]) for d in {d for d, _ in balls}}
            tables = {d: (c, np.array([pivots[d][x] for x in c], dtype=float).reshape(len(c), -1), np.array([balls[d, x][2] for x in c])) for d, c in of_dim.items()}
            for batch in batches:
                out: list[tuple] = []
                for vec_id, dim, v, own, floor in zip(*[batch.column(c).to_pylist() for c in ("vec_id", "dim", "v", "cell", "floor")]):
                    names, centres, radii = tables[dim]
                    if which == "own":
                        chosen = [own]
                    else:
                        x = np.array(v, dtype=float)
                        ub = centres @ x + np.sqrt(x @ x) * radii
                        ub += 1e-9 * np.abs(ub) + 1e-6
                        ub[names.index(own)] = -np.inf
                        order = np.argsort(-ub, kind="stable")
                        order = order[ub[order] >= (-np.inf if floor is None else floor)]
                        order = order[ub[order] > -np.inf]
                        chosen = [names[i] for i in (order[:1] if which == "best" else order)]
                    for c in chosen:
                        start, n, _ = balls[dim, c]
                        out += [(dim, start + k, c, vec_id, floor, v) for k in range(n)]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["dim", "shard", "cell", "vec_id", "floor", "v"])

        return asked.select("vec_id", "dim", "v", "cell", "floor").mapInArrow(released(route), "dim int, shard int, cell int, vec_id long, floor double, v array<long>")

    def with_floor(found: DataFrame) -> DataFrame:
        """The queries with the k-th score among what is found, null while there are fewer."""
        top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id")
        floors = top.agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        return queries.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = checkpointed(search(routed(queries.withColumn("floor", F.lit(None).cast("double")), "own")))
    if len(balls) > 1:
        best = checkpointed(routed(with_floor(found), "best"))
        found = checkpointed(found.unionByName(search(best)))
        seen = best.select("vec_id", "cell").distinct()
        rest = routed(checkpointed(with_floor(found)), "rest").join(seen, ["vec_id", "cell"], "left_anti")
        found = found.unionByName(search(rest))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
