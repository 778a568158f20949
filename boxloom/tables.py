"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset, on a local master."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read again: what follows does not compute them anew, and lost executors cost no more
    than their own part."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are deleted when it ends, and not when the driver happens to collect its garbage.
    For queries whose results are stored: an action on the same DataFrame again would shuffle anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if not folder.getName().startswith("table-"):
            raise ValueError(f"{folder} is no stored table")
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def computed(df: DataFrame, keep: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """The columns ``keep`` and the named ones, which are computed once a row.

    A filter over a plain select is pushed below it, with the whole expression in place of each mention of a column; over
    several such steps it outgrows what the JVM compiles. Nothing is pushed through the rows of an array."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
