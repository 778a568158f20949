"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and their groups.

Candidates come in two steps. First SimHash: fingerprints of the shingle sets are joined on pigeonhole blocks, pairs
within a few bits are verified by their Hamming distance, and then on the sets themselves. Sets that are 0.8 similar differ
in some ten of 64 bits, which no choice of blocks can serve, so a second step finds the rest, and makes the result exact: a
join by prefixes. If all shingles have one order, two sets that are that similar share one of their first
``n - ceil(0.8 n) + 1``. Any order will do, so shingles that are frequent in a sample of the texts come last, which
keeps common passages out of the prefixes; the rest is ordered by hash. Pairs that meet at a shingle pass a length and a
position bound, and what is left is verified on the sets. Documents of equal sets are one node.

A second exact bound needs no texts: a node's sketch holds, for each of 512 buckets of shingle hashes, whether the number of
its shingles there is odd. Two sets differ in at least as many shingles as their sketches differ in bits, and similarity
0.8 allows a ninth of both sizes.

Pairs are verified in rounds. In each, a node is verified against one other at most: the closest by sketch of the hubs (one
drawn for each shingle and round) that it meets and isn't linked to, directly or not. Shingles at which all nodes are
linked are left out, so a large group of near copies shrinks to what is not yet linked, and takes rows in proportion to its
size. When rounds bring no more links, or after a few, all pairs of different groups that the bounds leave are verified;
the largest group at a shingle is not paired with itself. So the result is exact. These pairs are many and seldom near: before
their texts are joined, a sketch of 4096 bits, by the same exact bound, takes most of them away.

Disk: a table goes when nothing reads it any more, and the shuffle files of each query go with its end (``tables.shuffles_removed``).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import shuffles_removed
from .common import discard, released, written
from .components import connected_components
from .simhash import fingerprint_links, folded

WORDS = 5
#: Similarity 0.8 as a fraction, so that bounds are whole numbers.
NUM, DEN = 4, 5
#: One of SAMPLE texts is counted for the frequent shingles; at most FREQUENT of them are kept.
SAMPLE, FREQUENT = 16, 1 << 16
#: Bits of the fine sketch.
FINE = 4096
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@lru_cache(1 << 16)
def _word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_word, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        x = h[k : k + n] ^ (h[k : k + n] >> np.uint64(31))
        out += x * _MIX[k]
        out ^= out >> np.uint64(29)
        out *= _MIX[(k + 1) % WORDS]
    return np.unique(out ^ (out >> np.uint64(32)))


def node_of(found: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(found.tobytes())
    return h - (1 << 64) if h >> 63 else h


def prefix(found: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles: by hash, then the frequent ones from the rarest on."""
    if not len(found):
        return found
    own = np.zeros(len(found), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        own = np.where(frequent[at] == found, ranks[at], 0)
    return found[np.argsort(own, kind="stable")][: len(found) - -(-NUM * len(found) // DEN) + 1]


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of nodes that are near, from the texts of both, stored."""

    def measure(batches):
        sets = lru_cache(64)(shingles)
        for batch in batches:
            near = [is_near(sets(x.as_py()), sets(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    pairs = written(pairs.distinct())
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    out = written(joined.mapInArrow(released(measure), "a long, b long"))
    discard(pairs)
    return out


def unlike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) without those whose fine sketches differ in too many bits to be near."""

    def bits(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, FINE // 64)

    def measure(batches):
        for batch in batches:
            apart = np.bitwise_count(bits(batch.column(4)) ^ bits(batch.column(5))).sum(axis=1, dtype=np.int64)
            both = sum(batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(apart * (NUM + DEN) <= both))

    left = texts.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("fine").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("fine").alias("right"))
    pairs = written(pairs.distinct())
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "left", "right")
    out = written(joined.mapInArrow(released(measure), "a long, b long"))
    discard(pairs)
    return out


def _bounds(a: str, b: str):
    """Whether two sets that meet at their places ``pos`` can be near: by length, and by what follows the place."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    after = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    before = F.least(F.col(f"{a}.pos"), F.col(f"{b}.pos"))
    return (F.greatest(n, m) * NUM <= F.least(n, m) * DEN) & ((before + after) * (NUM + DEN) >= NUM * (n + m))


def sketch(found: np.ndarray, size: int = 512) -> np.ndarray:
    """512 bits, as eight longs: of each bucket of hashes, whether an odd number of shingles falls into it."""
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCH = tuple(f"s{i}" for i in range(8))


def _apart(a: str, b: str):
    """In how many bits the sketches differ: the sets differ in at least as many shingles."""
    bits = [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH]
    return sum(bits[1:], bits[0])


def _open(a: str, b: str):
    """Whether two nodes of different groups may be near."""
    return (F.col(f"{a}.comp") != F.col(f"{b}.comp")) & _bounds(a, b) & (_apart(a, b) * (NUM + DEN) <= F.col(f"{a}.n") + F.col(f"{b}.n"))


def _split(places: DataFrame) -> DataFrame:
    """The places of shingles at which nodes of several components meet."""
    sizes = places.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # apart from the aggregate, so that the join can split a hot shingle
    several = written(sizes.where("lo <> hi").select("shingle"))
    out = written(places.join(several, "shingle"))
    discard(several)
    return out


def _joined(comps: DataFrame, near: DataFrame) -> DataFrame:
    """The stored components with more links (a, b); both tables go."""
    out = connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(near))
    discard(comps)
    discard(near)
    return out


def near_copy_links(places: DataFrame, comps: DataFrame, sketches: DataFrame, texts_of, rounds: int = 4) -> DataFrame:
    """(node, component) of all links, from places (shingle, node, n, pos), the components that the first links give, the
    sketch of each node, and ``texts_of``, which gives the (node, text) of a table of nodes."""

    def grouped(own: DataFrame) -> DataFrame:
        return own.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")

    split = _split(grouped(places))
    discard(places)
    places = written(split.join(sketches, "node"))
    discard(split)

    def finer(batches):
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            fine = pa.array([sketch(s, FINE).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), fine], names=["node", "text", "n", "fine"])

    texts = written(texts_of(places.select("node").distinct()).mapInArrow(released(finer), "node long, text string, n long, fine binary"))
    for r in range(rounds):
        if places.isEmpty():
            discard(texts)
            return comps
        drawn = places.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node", "shingle", F.lit(r)).alias("lot"), "node", "n", "pos", "comp", *SKETCH)).alias("hub"))
        hubs = written(drawn.select("shingle", "hub.*").drop("lot"))
        met = places.alias("x").join(hubs.alias("y"), "shingle").where(_open("x", "y"))
        best = met.groupBy(F.col("x.node").alias("node")).agg(F.min(F.struct(_apart("x", "y").alias("bits"), F.col("y.node").alias("to"))).alias("best"))
        pairs = best.select(F.least("node", "best.to").alias("a"), F.greatest("node", "best.to").alias("b"))
        near = verified(pairs, texts)
        discard(hubs)
        if near.isEmpty():
            break
        comps = _joined(comps, near)
        split = _split(grouped(places))
        discard(places)
        places = split
    # what is left: each node outside of the largest group at a shingle, with all others there
    sizes = places.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("shingle").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"))
    sizes = written(sizes)
    topped = places.join(sizes, "shingle")
    rest = (
        topped.where("comp <> top").alias("x").join(topped.alias("y"), "shingle")
        .where(_open("x", "y") & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    )
    rest = unlike(rest, texts)
    discard(sizes)
    discard(places)
    near = verified(rest, texts)
    discard(rest)
    discard(texts)
    return comps if near.isEmpty() else _joined(comps, near)


def near_copy_groups(rows: DataFrame, distance: int = 2, rounds: int = 4) -> DataFrame:
    """(key, id) and text -> (key, id, component): near copies, and what near copies link, share a component.

    ``key`` (long) stands for a row, rows of one key must have one text. Texts without words are equal. Nothing is left
    out but pairs under similarity 0.8; sets are compared by 64-bit hashes.
    """
    with shuffles_removed(rows.sparkSession):
        members, linked = _linked(rows, distance, rounds)
    return members.join(linked, "node", "left").select("key", "id", F.coalesce("component", "node").alias("component"))


def _linked(rows: DataFrame, distance: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(key, id, node) of all rows, and (node, component) of the nodes that are linked, both stored."""
    spark = rows.sparkSession
    text = rows.select("key", "id", "text")

    def listed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(0)], pa.list_(pa.int64()))], names=["s"])

    sample = text.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counts = sample.mapInArrow(released(listed), "s array<long>").select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    top = counts.orderBy(F.desc("c"), "s").limit(FREQUENT).toArrow()  # at most FREQUENT rows
    values = np.array(top.column("s").to_pylist(), dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    shared = spark.sparkContext.broadcast((values[order], (len(values) - np.arange(len(values)))[order]))

    def mark(batches):
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            columns = [
                pa.array([node_of(s) for s in sets], pa.int64()),
                pa.array(np.array([folded(s) for s in sets], dtype=np.uint64).view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([prefix(s, *shared.value).view(np.int64) for s in sets], pa.list_(pa.int64())),
                *[pa.array(x) for x in np.array([sketch(s) for s in sets], dtype=np.int64).reshape(len(sets), 8).T.copy()],
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "id", "node", "fp", "n", "prefix", *SKETCH])

    longs = ", ".join(f"{s} long" for s in SKETCH)
    marked = written(text.mapInArrow(released(mark), f"key long, id long, node long, fp long, n long, prefix array<long>, {longs}"))
    # rows of one node differ in key and id only
    nodes = written(marked.groupBy("node").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("fp", "n", "prefix", *SKETCH)]))
    members = written(marked.select("key", "id", "node"))
    discard(marked)
    slim = written(nodes.select("node", "key", "fp", *SKETCH))

    def texts_of(own: DataFrame) -> DataFrame:
        reps = slim.join(own, "node", "left_semi").select("node", "key")
        # a node has one key: the rows of a key lie together after the join, and need no second shuffle
        return text.join(written(reps), "key").select("key", "node", "text").dropDuplicates(["key"]).select("node", "text")

    # candidates by SimHash: within a few bits, or with one fingerprint
    fps = written(slim.groupBy("fp").agg(F.min("node").alias("rep")))
    links = fingerprint_links(fps.select("fp"), distance)
    a, b = fps.select(F.col("fp").alias("a"), F.col("rep").alias("x")), fps.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    close = links.join(a, "a").join(b, "b").select("x", "y").union(slim.join(fps, "fp").where("node <> rep").select("rep", "node"))
    # and each node's best meeting with the least node of a shingle of its prefix
    places = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    common = written(places.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n", "pos")).alias("hub")).where("m > 1").select("shingle", "hub"))
    places = written(places.join(common, "shingle"))
    discard(common)
    discard(nodes)
    met = places.select("node", "n", "pos", F.col("hub.node").alias("to"), F.struct("hub.*").alias("y"), F.struct("n", "pos").alias("x")).where(F.col("node") != F.col("to"))
    met = met.where(_bounds("x", "y")).groupBy("node", "to").agg(F.count(F.lit(1)).alias("met"))
    best = met.groupBy("node").agg(F.max(F.struct("met", "to")).alias("best")).select(F.col("best.to").alias("x"), F.col("node").alias("y"))
    close = written(close.union(best).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    texts = written(texts_of(close.select(F.col("a").alias("node")).union(close.select("b")).distinct()))
    first = verified(close, texts)
    for table in (texts, close, fps):
        discard(table)
    comps = connected_components(first)
    discard(first)
    met = written(places.drop("hub"))
    discard(places)
    return members, near_copy_links(met, comps, slim.select("node", *SKETCH), texts_of, rounds)
