"""The streaming jobs give what their batch forms give."""

from pyspark.sql import functions as F

from boxloom.operators import frames as fr
from boxloom.plans.fixtures import Tables
from boxloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def streamed(spark, frames, folder, job, name):
    """Write the frames in two files by order, stream them one file a batch, collect."""
    cut = frames.agg(F.max("frame_idx")).first()[0] // 2
    for k, part in enumerate((frames.where(F.col("frame_idx") <= cut), frames.where(F.col("frame_idx") > cut))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = job(source, idle_ms=None).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_keyframes(spark, tmp_path):
    f = Tables(spark, SF).frames.select("video_id", "frame_idx", "gray", "infer_ms")
    got = {tuple(r) for r in streamed(spark, f, tmp_path, jobs.stream_keyframes, "kf").collect()}
    want = {tuple(r) for r in fr.keyframes_both(f, least_seconds=0.0).select("video_id", "frame_idx", "reason").collect()}
    assert got == want


def test_rolling_latency(spark, tmp_path):
    f = Tables(spark, SF).frames.select("video_id", "frame_idx", "gray", "infer_ms")
    key = lambda r: (r["video_id"], r["frame_idx"], round(r["avg_ms"], 6), r["min_ms"], r["max_ms"])
    got = {key(r) for r in streamed(spark, f, tmp_path, jobs.stream_rolling_latency, "lat").collect()}
    assert got == {key(r) for r in fr.rolling_latency(f).collect()}


def test_batches_go_on_across_micro_batches(spark, tmp_path):
    f = Tables(spark, SF).frames.select("video_id", "frame_idx", "gray", "infer_ms")
    got = {tuple(r) for r in streamed(spark, f, tmp_path, jobs.stream_batches, "bat").collect()}
    assert got == {tuple(r) for r in fr.in_batches(f).select("video_id", "batch", "frame_idx").collect()}


def test_idle_state_is_dropped(spark, tmp_path):
    """With no idle time the second batch starts anew."""
    import time

    f = spark.createDataFrame([(1, i, float(i)) for i in range(3)], "video_id long, frame_idx long, infer_ms double")
    f.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.stream_batches(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")), 2, idle_ms=1).writeStream.format("memory").queryName("idle").outputMode("append").start()
    until = time.time() + 60
    while spark.table("idle").count() < 3 and time.time() < until:
        time.sleep(0.2)
    time.sleep(2)
    f.withColumn("frame_idx", F.col("frame_idx") + 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    while spark.table("idle").count() < 6 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert sorted((r["frame_idx"], r["batch"]) for r in spark.table("idle").collect()) == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 1)]


def test_an_older_save_that_comes_later_loses(spark, tmp_path):
    kind = "image_id long, label string, ts long"
    for k, rows in enumerate(([(1, "new", 5), (2, "b", 1)], [(1, "old", 3), (3, "c", 1)])):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"in{k}"))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / f"in{k}"))
        jobs.stream_upsert_annotations(source, str(tmp_path / "out"), str(tmp_path / f"cp{k}")).awaitTermination()
    assert {(r["image_id"], r["label"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "new"), (2, "b"), (3, "c")}


def test_upsert(spark, tmp_path):
    saves = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (1, "c", 3)], "image_id long, label string, ts long")
    target, kind = str(tmp_path / "out"), saves.schema
    for rows in (saves, spark.createDataFrame([(2, "d", 9)], kind)):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_upsert_annotations(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), target, str(tmp_path / "cp")).awaitTermination()
    assert {(r["image_id"], r["label"]) for r in spark.read.parquet(target).collect()} == {(1, "c"), (2, "d")}


def test_counts_have_a_watermark(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("event_type", "label").select("ts", "label")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.stream_detection_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cnt").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("cnt").collect()} == {tuple(r) for r in jobs.stream_detection_counts(e).collect()}
