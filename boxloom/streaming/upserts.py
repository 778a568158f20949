"""A table in which the last save of each key wins, kept as a log of changes that is folded now and then.

Layout below the target: ``_changes/source=s/batch=n`` holds what one micro-batch brought, ``version=v`` the folded table,
with the numbers of the batches that it holds beside it. A batch writes no more than its own rows. A change folder counts
once Spark has marked it complete, so a batch that dies halfway is not seen, and is written anew when it is run again; one
that has been written, or folded, is left alone when it is run again. Folding reads the newest version and the changes,
writes the next version aside and renames it, then removes what it holds. The file system has to rename in one step, and
one folding may run at a time.

``current`` gives the table. Reading the target itself gives the newest version without later changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest_saves(saves: DataFrame, key: str = "image_id", order: str = "ts") -> DataFrame:
    """The last save of each image, by the order; of equal ones any."""
    return saves.groupBy(key).agg(F.max_by(F.struct(*saves.columns), order).alias("s")).select("s.*")


class Files:
    """The few file operations that the log needs, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        fs, p = self.at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self.at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)

    def rename(self, path: str, to: str) -> None:
        fs, p = self.at(path)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} could not be renamed to {to}")

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self.at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


class SaveLog:
    """The log below ``target``; ``schema`` is that of a save."""

    def __init__(self, spark: SparkSession, target: str, schema: StructType, key: str = "image_id", order: str = "ts"):
        self.spark, self.target, self.schema, self.key, self.order = spark, target.rstrip("/"), schema, key, order
        self.files = Files(spark)

    def version(self) -> int | None:
        """The newest version; None before the first folding."""
        return max((int(n.split("=")[1]) for n in self.files.names(self.target) if n.startswith("version=")), default=None)

    def folded(self, version: int | None) -> dict[str, int]:
        """The last batch of each source that a version holds; all before it are held too."""
        return {} if version is None else json.loads(self.files.read(f"{self.target}/version={version}/_folded.json"))

    def path(self, source: str, batch: int) -> str:
        return f"{self.target}/_changes/source={source}/batch={batch}"

    def changes(self, folded: dict[str, int]) -> Iterator[tuple[str, int]]:
        """The complete batches that aren't folded."""
        for source in (n.removeprefix("source=") for n in self.files.names(f"{self.target}/_changes")):
            for batch in sorted(int(n.removeprefix("batch=")) for n in self.files.names(f"{self.target}/_changes/source={source}")):
                if batch > folded.get(source, -1) and self.files.exists(f"{self.path(source, batch)}/_SUCCESS"):
                    yield source, batch

    def append(self, batch: DataFrame, source: str, number: int) -> bool:
        """Write a batch's rows; False if they are there already."""
        path = self.path(source, number)
        if number <= self.folded(self.version()).get(source, -1) or self.files.exists(f"{path}/_SUCCESS"):
            return False
        latest_saves(batch.select(*self.schema.names), self.key, self.order).write.mode("overwrite").parquet(path)
        return True

    def read(self, version: int | None, changes: list[tuple[str, int]]) -> DataFrame:
        paths = [self.path(*c) for c in changes] + ([] if version is None else [f"{self.target}/version={version}"])
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return latest_saves(rows, self.key, self.order) if changes else rows

    def current(self) -> DataFrame:
        version = self.version()
        return self.read(version, list(self.changes(self.folded(version))))

    def fold(self) -> None:
        """Make the changes part of the next version."""
        version = self.version()
        before = self.folded(version)
        changes = list(self.changes(before))
        if changes:
            after, aside = dict(before), f"{self.target}/_next"
            for source, batch in changes:
                after[source] = max(batch, after.get(source, -1))
            self.read(version, changes).write.mode("overwrite").parquet(aside)
            self.files.write(f"{aside}/_folded.json", json.dumps(after))
            version = 0 if version is None else version + 1
            self.files.rename(aside, f"{self.target}/version={version}")
        self.clean(version)

    def clean(self, version: int | None) -> None:
        """Remove older versions and the changes that the version holds; also what a folding left that died."""
        for name in self.files.names(self.target):
            if name.startswith("version=") and int(name.split("=")[1]) != version:
                self.files.delete(f"{self.target}/{name}")
        for source, last in self.folded(version).items():
            for name in self.files.names(f"{self.target}/_changes/source={source}"):
                if int(name.removeprefix("batch=")) <= last:
                    self.files.delete(f"{self.target}/_changes/source={source}/{name}")

    def due(self, share: float) -> bool:
        """Whether the changes take so much of the newest version's bytes, so that all foldings together write a fixed multiple
        of what came in."""
        version = self.version()
        return self.files.size(f"{self.target}/_changes") >= share * (0 if version is None else self.files.size(f"{self.target}/version={version}"))
