"""The log of saves: what a batch writes, replays, batches and foldings that die halfway."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from boxloom.streaming import jobs
from boxloom.streaming.upserts import SaveLog

KIND = "image_id long, label string, ts long"


@pytest.fixture
def log(spark, tmp_path):
    return SaveLog(spark, str(tmp_path / "table"), spark.createDataFrame([], KIND).schema)


def saves(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def table(log):
    return {(r["image_id"], r["label"], r["ts"]) for r in log.current().collect()}


def files(folder):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_last_save_wins_in_any_order_of_arrival(spark, log):
    assert table(log) == set()
    log.append(saves(spark, (1, "b", 5), (2, "a", 1), (1, "a", 2)), "s", 0)
    assert table(log) == {(1, "b", 5), (2, "a", 1)}
    log.append(saves(spark, (1, "old", 3), (3, "c", 1)), "s", 1)
    assert table(log) == {(1, "b", 5), (2, "a", 1), (3, "c", 1)}
    log.fold()
    assert table(log) == {(1, "b", 5), (2, "a", 1), (3, "c", 1)} and log.version() == 0
    log.append(saves(spark, (2, "new", 9)), "other", 0)
    assert table(log) == {(1, "b", 5), (2, "new", 9), (3, "c", 1)}


def test_a_batch_writes_its_own_rows_only(spark, log):
    log.append(spark.range(20_000).select(F.col("id").alias("image_id"), F.lit("x").alias("label"), F.lit(1).cast("long").alias("ts")), "s", 0)
    log.fold()
    before = files(log.target)
    log.append(saves(spark, (7, "new", 2)), "s", 1)
    after = files(log.target)
    assert before.items() <= after.items()
    new = [f for f in after if f not in before]
    assert spark.read.parquet(*new).count() == 1 and (7, "new", 2) in table(log)


def test_replays_change_nothing(spark, log):
    batch = saves(spark, (1, "a", 1), (2, "b", 1))
    assert log.append(batch, "s", 0)
    before = files(log.target)
    assert not log.append(batch, "s", 0) and files(log.target) == before
    log.fold()
    before = files(log.target)
    assert not log.append(batch, "s", 0) and files(log.target) == before  # folded
    log.fold()
    assert files(log.target) == before  # nothing to fold


def test_a_batch_that_dies_halfway_loses_nothing(spark, log):
    log.append(saves(spark, (1, "a", 1)), "s", 0)
    half = log.path("s", 1)
    saves(spark, (1, "x", 4)).write.parquet(half)
    os.remove(f"{half}/_SUCCESS")  # some files are there, the batch isn't complete
    assert table(log) == {(1, "a", 1)}
    log.fold()
    assert table(log) == {(1, "a", 1)}
    assert log.append(saves(spark, (1, "x", 4), (2, "y", 4)), "s", 1)
    assert table(log) == {(1, "x", 4), (2, "y", 4)}


def test_a_folding_that_dies_halfway_loses_nothing(spark, log, monkeypatch):
    log.append(saves(spark, (1, "a", 1)), "s", 0)
    log.fold()
    log.append(saves(spark, (1, "b", 2), (2, "c", 1)), "s", 1)
    want = {(1, "b", 2), (2, "c", 1)}
    with monkeypatch.context() as m:  # before the rename
        m.setattr(log.files, "rename", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.fold()
    assert table(log) == want and log.version() == 0
    with monkeypatch.context() as m:  # after it
        m.setattr(log, "clean", lambda v: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.fold()
    assert table(log) == want and log.version() == 1
    log.fold()
    assert table(log) == want and [n for n in os.listdir(log.target) if n.startswith("version=")] == ["version=1"]
    assert os.listdir(f"{log.target}/_changes/source=s") == []


def test_a_changed_schema_is_no_missing_table(spark, tmp_path, log):
    """Whatever goes wrong with reading the table, its rows stay."""
    log.append(saves(spark, (1, "a", 1)), "s", 0)
    log.fold()
    other = SaveLog(spark, log.target, spark.createDataFrame([], "image_id string, label string, ts long").schema)
    other.append(spark.createDataFrame([("1", "b", 2)], "image_id string, label string, ts long"), "s", 1)
    with pytest.raises(Exception):  # noqa: B017
        other.fold()
    shutil.rmtree(log.path("s", 1))
    assert table(log) == {(1, "a", 1)}


def test_stream_with_and_without_folding(spark, tmp_path):
    for share in (0.0, None):
        folder = tmp_path / str(share)
        for k in range(3):
            saves(spark, (k, "a", k), (9, f"b{k}", 10 - k)).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            source = spark.readStream.schema(KIND).parquet(str(folder / "in"))
            jobs.stream_upsert_annotations(source, str(folder / "out"), str(folder / "cp"), share=share).awaitTermination()
        log = SaveLog(spark, str(folder / "out"), source.schema)
        assert table(log) == {(0, "a", 0), (1, "a", 1), (2, "a", 2), (9, "b0", 10)}
        assert log.version() == (None if share is None else 2)
