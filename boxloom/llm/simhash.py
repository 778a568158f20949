"""SimHash near-dedup with pigeonhole blocks.

Fingerprints that differ in at most ``distance`` bits agree in at least ``blocks - distance`` of the ``blocks`` bit
blocks. For each choice of that many blocks the fingerprints are grouped by those blocks' bits, and pairs within a
group are verified by their Hamming distance. Only *distinct* fingerprints take part, so a group of copies is one row.

A group with more than ``dense`` fingerprints is split by longer keys: the bits that its key leaves open are cut into blocks
of two bits, and the fingerprints meet again for each choice of all but ``distance`` of these. Such a key leaves
``2 * distance`` bits open, so at most ``4 ** distance`` fingerprints share it, and rows grow with the group, not with its
square. Every pair within the distance still shares a key, and is verified like any other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released
from .components import connected_components


def folded(values: np.ndarray) -> int:
    """The 64-bit SimHash of some hashes: a bit is 1 if set in over half of them; 0 for none."""
    ones = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    body = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(found) - words + 1)
    ends = ends[-n:] - 1
    view = memoryview(body)
    h = xxhash.xxh64_intdigest
    ones, at = np.zeros(64, dtype=np.int64), 0
    for at in range(0, n, 65536):  # a bounded slice of a very long text at a time
        values = np.array([h(view[a:b], seed) for a, b in zip(starts[at : min(n, at + 65536)].tolist(), ends[at : at + 65536].tolist())], dtype=">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a long."""

    def make(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py() or "", words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(make), "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_masks(distance: int, blocks: int) -> list[int]:
    """The bits of each choice of blocks - distance blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(masks[k] for k in pick) for pick in combinations(range(blocks), blocks - distance)]


def longer_masks(mask: int, distance: int) -> list[int]:
    """The mask with each choice of all but ``distance`` two-bit blocks of the bits that it leaves open."""
    rest = [b for b in range(64) if not mask >> b & 1]
    small = [sum(1 << b for b in rest[i : i + 2]) for i in range(0, len(rest), 2)]
    return [mask | sum(pick) for pick in combinations(small, max(0, len(small) - distance))]


def _keys(fp: Column, masks: list[int]) -> Column:
    """The array of structs (choice, key): the fingerprint's bits under each mask."""
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])


def _close(keys: DataFrame, on: list[str], distance: int) -> DataFrame:
    """The pairs (a, b) that share a key and lie within the distance."""
    a, b = keys.select(*on, F.col("fp").alias("a")), keys.select(*on, F.col("fp").alias("b"))
    return a.join(b, on).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")


def fingerprint_links(fps: DataFrame, distance: int = 2, blocks: int = 5, dense: int = 64) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (column fp) at most distance bits apart."""
    masks = block_masks(distance, blocks)
    keys = fps.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("k")).select("fp", "k.choice", "k.key")
    # apart from the aggregate, so that the join can split a hot key
    sizes = checkpointed(keys.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    keys = checkpointed(keys.join(sizes, ["choice", "key"]))
    few = _close(keys.where(F.col("n") <= dense), ["choice", "key"], distance)
    longer = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in longer_masks(mask, distance)]) for mask in masks])
    own = F.posexplode(F.transform(F.element_at(longer, F.col("choice") + 1), lambda m: F.col("fp").bitwiseAND(m))).alias("sub", "long_key")
    many = keys.where(F.col("n") > dense).select("fp", "choice", own)
    return few.unionByName(_close(many, ["choice", "sub", "long_key"], distance)).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, distance: int = 2, blocks: int = 5, dense: int = 64) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links).

    Null and empty texts have no words: fingerprint zero, linked like any other. A null doc_id stays in the result and
    is no component's name unless its component has null ids only. Repeated rows appear as often as they came. An
    empty table gives an empty result; other columns are ignored.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, words, seed))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = connected_components(fingerprint_links(distinct.select("fp"), distance, blocks, dense))
    # component is the least fingerprint of the group; the least document of all its fingerprints names it
    of = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = checkpointed(of.groupBy("component").agg(F.min("least_id").alias("component_id")))  # apart, so that the joins can split hot keys
    table = checkpointed(of.join(names, "component").select("fp", "component_id"))
    return marked.join(table, "fp").select("doc_id", "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    out = simhash_components(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
