"""The streaming jobs over a table that is streamed from files, and user models with stub functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import inference as inf
from ..operators.answers import AnswerStore
from ..streaming import jobs
from ..streaming.ingest import stream_ingest as ingest
from ..streaming.late_frames import STATE_STORE, stream_late_keyframes
from ..streaming.upserts import SaveLog
from ..tables import new_path, stored
from .fixtures import oracle
from .frames_stats_queries import DIFF
from .registry import query


def streamed(df, job):
    """The result of a streaming job over the rows: written as files, read as a stream, its output read as a table."""
    spark, folder = df.sparkSession, new_path(df.sparkSession, "stream")
    df.write.parquet(f"{folder}/in")
    out = job(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), idle_ms=None)
    out.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("stream_keyframes", oracle("SELECT video_id, frame_idx, CASE WHEN frame_idx % 10 = 0 THEN 'interval' ELSE 'scene_change' END AS reason FROM fd WHERE frame_idx % 10 = 0 OR diff IS NULL OR diff > 5", DIFF))
def stream_keyframes(t):
    return streamed(t.frames.select("video_id", "frame_idx", "gray"), jobs.stream_keyframes)


@query("stream_keyframes_late", oracle("SELECT video_id, frame_idx, CASE WHEN frame_idx % 10 = 0 THEN 'interval' ELSE 'scene_change' END AS reason FROM fd WHERE frame_idx % 10 = 0 OR diff IS NULL OR diff > 5", DIFF))
def stream_keyframes_late(t):
    """The same frames in three files by time, a third of each in the next one, and a row that ends the stream."""
    frames = t.frames.select("video_id", "frame_idx", "gray", F.col("ts").cast("timestamp").alias("ts"))
    spark, folder = frames.sparkSession.newSession(), new_path(frames.sparkSession, "late")
    spark.conf.set(*STATE_STORE)
    first, last = t.table("events").agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))), F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()
    step = (last - first) // 3 + 1
    part = F.floor((F.unix_millis("ts") - first) / step) + (F.xxhash64("video_id", "frame_idx") % 3 == 0).cast("int")
    files = stored(frames.withColumn("part", part))
    ended = frames.limit(1).selectExpr("video_id", "CAST(NULL AS BIGINT) AS frame_idx", "gray", f"timestamp_millis({last + 3 * step}) AS ts")
    out = None
    for k in range(5):  # a run takes what has come since, and goes on where the one before ended
        (files.where(F.col("part") == k).drop("part") if k < 4 else ended).write.mode("append").parquet(f"{folder}/in")
        out = stream_late_keyframes(spark.readStream.schema(frames.schema).parquet(f"{folder}/in"), "ts", f"{2 * step} milliseconds")
        out.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").format("parquet").start(f"{folder}/out").awaitTermination()
    return frames.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


@query("stream_rolling_latency", oracle("""
SELECT video_id, frame_idx, round(a, 6) AS avg_ms, min_ms, max_ms, CASE WHEN a > 0 THEN round(1000 / a, 4) END AS fps FROM (
  SELECT video_id, frame_idx, avg(infer_ms) OVER w AS a, min(infer_ms) OVER w AS min_ms, max(infer_ms) OVER w AS max_ms FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""))
def stream_rolling_latency(t):
    out = streamed(t.frames.select("video_id", "frame_idx", "infer_ms"), jobs.stream_rolling_latency)
    return out.select("video_id", "frame_idx", F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms", F.round(F.nanvl("fps", F.lit(None)), 4).alias("fps"))


@query("stream_frame_batches", oracle("SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1) // 4 AS batch, frame_idx FROM frames"))
def stream_frame_batches(t):
    return streamed(t.frames.select("video_id", "frame_idx"), jobs.stream_batches)


@query("stream_upsert_annotations", oracle("SELECT user_id AS image_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY 1"))
def stream_upsert_annotations(t):
    """Two streams into one table, the later saves first: they stay. The second stream's changes are read beside the table."""
    saves = t.table("events").select(F.col("user_id").alias("image_id"), "event_id", F.struct("ts", "event_id").alias("at"))
    folder = new_path(saves.sparkSession, "saves")
    for k, part in enumerate((saves.where("event_id % 2 = 1"), saves.where("event_id % 2 = 0"))):
        part.write.parquet(f"{folder}/in{k}")
        source = saves.sparkSession.readStream.schema(saves.schema).parquet(f"{folder}/in{k}")
        jobs.stream_upsert_annotations(source, f"{folder}/table", f"{folder}/progress{k}", order="at", share=None if k else 0.5).awaitTermination()
    return SaveLog(saves.sparkSession, f"{folder}/table", saves.schema, order="at").current().select("image_id", "event_id")


@query("stream_ingest", oracle("""
SELECT image_id::VARCHAR AS name, image_id * 10 + image_id % 2 AS size, 0 AS run FROM images WHERE image_id % 3 = 0
UNION ALL SELECT image_id::VARCHAR, image_id * 10, 1 FROM images WHERE image_id % 3 <> 0 OR image_id % 2 = 1"""))
def stream_ingest(t):
    """Three listings, a run for each: some objects, then all with some other sizes, then the same once more."""
    spark, folder = t.spark.newSession(), new_path(t.spark, "listings")
    spark.conf.set(*STATE_STORE)
    every = t.images.selectExpr("CAST(image_id AS STRING) AS name", "image_id * 10 AS size", "image_id")
    some = every.where("image_id % 3 = 0").withColumn("size", F.col("size") + F.col("image_id") % 2)
    for k, listing in enumerate((some, every, every)):
        listing.select("name", "size", F.timestamp_seconds(F.lit(k)).alias("listed")).write.mode("append").parquet(f"{folder}/in")
        out = ingest(spark.readStream.schema("name string, size long, listed timestamp").parquet(f"{folder}/in"), buckets=16)
        out.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").format("parquet").start(f"{folder}/out").awaitTermination()
    return t.spark.read.schema("name string, size long, listed timestamp").parquet(f"{folder}/out").select("name", "size", F.unix_timestamp("listed").cast("int").alias("run"))


@query("stream_detection_counts", oracle("SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS start, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2"))
def stream_detection_counts(t):
    return jobs.stream_detection_counts(t.table("events").withColumnRenamed("event_type", "label"))


def shout():
    return lambda prompts: [p.upper() if "0" not in p else 1 / 0 for p in prompts]


def whisper():
    return lambda prompts: [p.lower() if "00" not in p else 1 / 0 for p in prompts]


@query("infer_batches", oracle("SELECT image_id, CASE WHEN contains(image_id::VARCHAR, '0') THEN NULL ELSE 'IMAGE ' || image_id END AS response, NOT contains(image_id::VARCHAR, '0') AS success FROM images"))
def infer_batches(t):
    out = inf.infer_batches(t.images.selectExpr("image_id", "concat('image ', image_id) AS prompt"), shout, "image_id", "prompt")
    return out.select("image_id", "response", "success")


@query("infer_with_fallback", oracle("""
SELECT image_id, CASE WHEN NOT contains(s, '0') THEN 'IMAGE ' || s WHEN NOT contains(s, '00') THEN 'image ' || s END AS response, NOT contains(s, '00') AS success,
  CASE WHEN NOT contains(s, '0') THEN 'first' WHEN NOT contains(s, '00') THEN 'second' ELSE 'none' END AS backend FROM (SELECT image_id, image_id::VARCHAR AS s FROM images)"""))
def infer_with_fallback(t):
    return inf.infer_with_fallback(t.images.selectExpr("image_id", "concat('image ', image_id) AS prompt"), [("first", shout), ("second", whisper)], "image_id", "prompt")


@query("infer_stored", oracle("""
SELECT image_id, CASE WHEN NOT contains(s, '0') THEN 'IMAGE ' || s WHEN NOT contains(s, '00') THEN 'image ' || s END AS response, NOT contains(s, '00') AS success,
  CASE WHEN NOT contains(s, '0') THEN 'first' WHEN NOT contains(s, '00') THEN 'second' ELSE 'none' END AS backend FROM (SELECT image_id, image_id::VARCHAR AS s FROM images)"""))
def infer_stored(t):
    """A run over some images and one over all, which asks for the others only."""
    prompts = t.images.selectExpr("image_id", "concat('image ', image_id) AS prompt")
    store, backends = AnswerStore(prompts.sparkSession, new_path(prompts.sparkSession, "answers")), [("first", shout), ("second", whisper)]
    store.infer(prompts.where("image_id % 3 = 0"), backends, "image_id", "prompt")
    return store.infer(prompts, backends, "image_id", "prompt")


def same_start(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x[:2].lower() == y[:2].lower() else 0.1 for x, y in zip(a, b)])


@query("map_labels_zero_shot", oracle("SELECT det_id, CASE WHEN det_id % 10 = 0 THEN 'other' WHEN label = 'car' THEN 'Carriage' WHEN label = 'stop sign' THEN 'Street sign' WHEN label = 'person' THEN 'Pedestrian' ELSE 'other' END AS mapped FROM det"))
def map_labels_zero_shot(t):
    d = t.det.withColumn("label", F.when(F.col("det_id") % 10 == 0, " ").otherwise(F.col("label")))
    return inf.map_labels_zero_shot(d, "label", ("Carriage", "Street sign", "Pedestrian"), F.pandas_udf(same_start, "double")).select("det_id", "mapped")
