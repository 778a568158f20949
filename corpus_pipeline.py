"""A corpus pipeline of five stages over ``documents``.

Quality classifier (rejected documents go), line dedup, near-dedup (one document of each group of near copies stays), secret
scan (spans are replaced), best-fit packing. Each stage is a function of (spark, docs, sf_dir) whose result is written
as Parquet and read again as the next stage's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.common import checkpoint_dir, held_out, read_table, row_key
from boxloom.llm.line_templates import drop_recurring_lines
from boxloom.llm.near_copies import near_copy_groups
from boxloom.llm.packing import pack_documents
from boxloom.llm.quality import quality_score, train_quality
from boxloom.llm.queries import tokenizer_path
from boxloom.llm.secret_scan import redact, scan_secrets


def _columns(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars, where there is one, counted anew."""
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least 0.3.

    A null or empty text has the score of the bias; long texts are scored whole; rows that repeat are judged alike; labels of
    ids that are null, repeated or contradictory don't count. Without labels all scores are 0.5, and all documents stay."""
    model = train_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 0))
    return docs.where(quality_score(spark, model, F.col("text")) >= 0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without lines of recurring templates. All rows stay: a null text stays null, a text may become empty; rows
    of one text, null ids or not, are one document and lose the same lines."""
    return _columns(docs, drop_recurring_lines(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest id,
    and where ids are null or shared, the smallest row key. Rows that repeat id and text are one document, null ids too."""
    key = row_key("doc_id", "text").alias("key")
    groups = near_copy_groups(docs.select(key, F.col("doc_id").cast("long").alias("id"), "text"))
    place = F.struct(F.col("id").isNull().alias("late"), "id", "key")
    names = groups.groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.key").alias("key"))
    rows = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).dropDuplicates(["key"])
    return rows.join(names, "key", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with every secret replaced by a mark. All rows stay; null and empty texts have no secrets; rows that repeat are
    told apart by nothing and redacted alike."""
    found = scan_secrets(docs, key=row_key("doc_id", "text")).where("size(spans) > 0").select("key", "spans").dropDuplicates(["key"])

    def replaced(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            yield pd.Series([t if t is None or len(s) == 0 else redact(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)], dtype=object)

    rows = docs.select(row_key("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(found, "key", "left")
    spans = F.coalesce("spans", F.expr("array()").cast("array<struct<start:int,end:int,kind:string>>"))
    text = F.col("row").getField("text")
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.pandas_udf(replaced, "string")(text, spans))
    return _columns(docs, joined.select(*[(clean if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece. A null or empty text is the end id alone; only longer texts are
    cut; rows that repeat are packed each; null ids stay null."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("secret scan", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Trained models and hashes of shingles are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
