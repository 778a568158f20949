"""Exact dedup by skew-safe combining.

Equal texts are found by three combines, each of which groups by the digest *and* the full normalised text, so that a
digest collision can never merge two texts:

1. local: each input partition combines its own rows (Spark's map-side partial aggregate),
2. salted: the local winners meet by (digest, salt); the salt is the input partition's number modulo ``salts``, so a
   text that fills a third of the table is spread over ``salts`` tasks and each task gets one row a partition at most,
3. global: the salt winners, ``salts`` rows a text at most, meet by digest.

Members then find their group by digest. Only where two different texts share a digest does the member's own text
decide as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: digest, body, keep_id, group_size, n_bodies (texts that share the digest)."""
    body = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    whole = salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return whole


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row, dropped ones too: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` has become one space; null is the empty
    text. Of equal texts the row with the smallest id stays. Rows that repeat an id are all marked kept if that id is
    the group's smallest; a null id is larger than any other, and a group with null ids only keeps them (keep_id is
    null). An empty table gives an empty result; further columns of the input are ignored.
    """
    groups = exact_groups(docs, id_col, text_col, salts)
    # Different texts under one digest: counted on digests alone; the texts travel no further than the global combine.
    found = checkpointed(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n_bodies"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )
    )
    members = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " "), 256).alias("digest"),
    )
    every = members.join(found.where("n_bodies = 1"), "digest").select("doc_id", "keep_id", "group_size", "digest")
    shared = found.where("n_bodies > 1").select("digest")
    if not shared.isEmpty():  # two texts share a digest: their members compare whole texts again
        bodies = docs.select(
            F.col(id_col).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ").alias("body")
        ).withColumn("digest", F.sha2("body", 256))
        rest = bodies.join(shared, "digest", "left_semi").join(groups.join(shared, "digest", "left_semi"), ["digest", "body"])
        every = every.unionByName(rest.select("doc_id", "keep_id", "group_size", "digest"))
    return every.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
