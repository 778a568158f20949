"""Helpers shared by the training-data operators: table reads, checkpoints, text keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard
from ..tables import shared_dir as checkpoint_dir
from ..tables import stored as written

__all__ = ["SPACE", "checkpoint_dir", "checkpointed", "discard", "held_out", "read_table", "released", "row_key", "shuffle_partitions", "written"]

#: The white space that the contracts of these operators name: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that lost executors cost no recomputation. ``written`` does so through a
    Parquet table: smaller, and free of the plan's constraints, which a loop of checkpoints would pile up."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: str, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod 5 is the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == remainder


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*names: str) -> Column:
    """A 64-bit key of a row's own values: rows that repeat in all of them share it, null ids are no exception."""
    return F.xxhash64(*[F.coalesce(F.col(n).cast("string"), F.lit("\0null")) for n in names])


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function, which gives memory back when it ends: Python workers live on and would keep what Arrow and the
    C library have freed."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task
