"""A store of model answers: what a backend has answered is never asked again.

Layout below the store's path: ``answers/run=r`` holds Parquet tables of prompt_hash, backend, response; ``open/r/p`` the
files that the task of partition p of run r writes as answers come in, at most one a second, and when it fails. A task that is tried again
reads its own open files first and asks for the rest only. A later run joins away what is answered and asks for the rest.
Runs that died are settled, that is their open files are made a table, when the next one begins. The path must be one that
executors can open: a shared mount, or a file system that Arrow knows (hdfs, s3 and others).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, stored
from .inference import FAILED, Model, answered

SCHEMA = pa.schema([("prompt_hash", pa.string()), ("backend", pa.string()), ("response", pa.string())])
PAUSE = 1.0  # seconds between a task's files: what a worker that is killed may lose
DDL = "prompt_hash string, backend string, response string"


def opened(path: str) -> tuple[pf.FileSystem, str]:
    """The file system of a path and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pf.LocalFileSystem(), path) if path.startswith("/") else pf.FileSystem.from_uri(path)


class OpenFiles:
    """The answers of one task, from all its attempts."""

    def __init__(self, folder: str):
        self.fs, self.folder = opened(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.rows, self.written = [], time.monotonic()

    def known(self) -> dict[str, tuple[str, str]]:
        """prompt_hash -> (backend, response)."""
        out = {}
        for info in self.fs.get_file_info(pf.FileSelector(self.folder)):
            if info.is_file and info.base_name.endswith(".parquet") and not info.base_name.startswith("_"):
                t = pq.read_table(info.path, filesystem=self.fs)
                out.update(zip(t["prompt_hash"].to_pylist(), zip(t["backend"].to_pylist(), t["response"].to_pylist())))
        return out

    def keep(self, rows: list[tuple[str, str, str]]) -> None:
        """Write the answers, those of fast models together, once a second."""
        self.rows += rows
        if time.monotonic() - self.written >= PAUSE:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.add(self.rows)
        self.rows, self.written = [], time.monotonic()

    def add(self, rows: list[tuple[str, str, str]]) -> None:
        """Write a file and give it its name in one step, so that half a file is never seen."""
        name = f"{uuid.uuid4().hex}.parquet"
        pq.write_table(pa.table([pa.array(c, pa.string()) for c in zip(*rows)], schema=SCHEMA), f"{self.folder}/_{name}", filesystem=self.fs)
        self.fs.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")


def asking(folder: str, backends: Sequence[tuple[str, Callable[[], Model]]], batch_size: int):
    """The task: prompt_hash, prompt -> prompt_hash, failed (the names of the backends that didn't answer, if none did)."""

    def run(batches, files):
        known = files.known()
        models: dict[str, Model] = {}
        for batch in batches:
            rows = [(h, p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if h not in known]
            failed: list[str] = []
            for at in range(0, len(rows), batch_size):
                left = rows[at : at + batch_size]
                for name, make in backends:
                    if not left:
                        break
                    if name not in models:
                        models[name] = make()
                    answers = answered(models[name], [p for _, p in left])
                    new = [(h, name, a) for (h, _), a in zip(left, answers) if a is not FAILED]
                    files.keep(new)
                    left = [row for row, a in zip(left, answers) if a is FAILED]
                failed += [h for h, _ in left]
            yield pa.RecordBatch.from_arrays([pa.array(failed, pa.string())], names=["prompt_hash"])

    def kept(batches):
        files = OpenFiles(f"{folder}/{TaskContext.get().partitionId() if TaskContext.get() else 0}")
        try:
            yield from run(batches, files)
        finally:  # also when a model fails
            files.flush()

    return kept


class AnswerStore:
    """Answers below a path, for any number of backends, each with a name that stands for its model and settings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def names(self, folder: str) -> list[str]:
        fs, at = opened(f"{self.path}/{folder}")
        return [i.base_name for i in fs.get_file_info(pf.FileSelector(at, allow_not_found=True))]

    def answers(self) -> DataFrame:
        """prompt_hash, backend, response of all settled runs, each prompt and backend once."""
        runs = [f"{self.path}/answers/{n}" for n in self.names("answers") if n.startswith("run=") and self.whole(n)]
        rows = self.spark.read.schema(DDL).parquet(*runs) if runs else self.spark.createDataFrame([], DDL)
        return rows.dropDuplicates(["prompt_hash", "backend"])

    def whole(self, run: str) -> bool:
        return "_SUCCESS" in self.names(f"answers/{run}")

    def settle(self) -> None:
        """Make a table of each run's open files."""
        for run in self.names("open"):
            if not self.whole(f"run={run}"):
                rows = self.spark.read.schema(DDL).option("recursiveFileLookup", "true").parquet(f"{self.path}/open/{run}")
                rows.write.mode("overwrite").parquet(f"{self.path}/answers/run={run}")
            fs, at = opened(f"{self.path}/open/{run}")
            fs.delete_dir(at)

    def infer(self, df: DataFrame, backends: Sequence[tuple[str, Callable[[], Model]]], key: str, prompt: str, batch_size: int = 16) -> DataFrame:
        """key, response, success, backend: the answer of the first backend that has one; no row is asked that one of these
        backends has answered before, and prompts that repeat are asked once. Failures are asked again by the next run; a
        null prompt fails. Runs at once. One run may use a store at a time."""
        self.settle()
        rank = {name: i for i, (name, _) in enumerate(backends)}
        rows = df.select(F.col(key), F.sha2(F.col(prompt).cast("string"), 256).alias("prompt_hash"), F.col(prompt).cast("string").alias("prompt"))
        mine = F.col("backend").isin(list(rank))
        todo = rows.where("prompt is not null").select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
        todo = stored(todo.join(self.answers().where(mine).select("prompt_hash"), "prompt_hash", "left_anti"))  # retried tasks see the same rows
        run = uuid.uuid4().hex
        stored(todo.mapInArrow(asking(f"{self.path}/open/{run}", backends, batch_size), "prompt_hash string"))
        self.settle()
        discard(todo)
        order = F.create_map(*[x for n, i in rank.items() for x in (F.lit(n), F.lit(i))])[F.col("backend")]
        best = self.answers().where(mine).groupBy("prompt_hash").agg(F.min_by(F.struct("response", "backend"), order).alias("a"))
        out = rows.drop("prompt").join(best, "prompt_hash", "left")
        return out.select(key, F.col("a.response").alias("response"), F.col("a").isNotNull().alias("success"), F.coalesce("a.backend", F.lit("none")).alias("backend"))
