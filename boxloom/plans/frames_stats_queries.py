"""Frames as time series, run statistics, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as ds
from ..operators import filters as fl
from ..operators import frames as fr
from ..operators import stats as st
from .fixtures import oracle
from .registry import query

DIFF = """fd AS (SELECT *, CASE WHEN pg IS NULL THEN NULL ELSE list_sum(list_transform(list_zip(gray, pg), lambda z: CAST(abs(z[1] - z[2]) AS DOUBLE))) / 16 END AS diff,
  count(*) OVER (PARTITION BY video_id) AS n_frames FROM (SELECT *, lag(gray) OVER (PARTITION BY video_id ORDER BY frame_idx) AS pg FROM frames))"""


@query("frame_diff", oracle("SELECT video_id, frame_idx, diff FROM fd", DIFF))
def frame_diff(t):
    return fr.with_diff(t.frames).select("video_id", "frame_idx", "diff")


@query("frame_diff_endless", oracle("SELECT video_id, frame_idx, diff FROM fd", DIFF))
def frame_diff_endless(t):
    """The same by ranges of frames."""
    return fr.endless_diff(t.frames)


@query("keyframes_scene", oracle("SELECT video_id, frame_idx, 'first' AS variant FROM fd WHERE diff > 5 OR diff IS NULL UNION ALL SELECT video_id, frame_idx, 'strict' FROM fd WHERE diff > 10", DIFF))
def keyframes_scene(t):
    a = fr.keyframes_scene(t.frames).select("video_id", "frame_idx", F.lit("first").alias("variant"))
    return a.union(fr.keyframes_scene(t.frames, 10.0, keep_first=False).select("video_id", "frame_idx", F.lit("strict")))


@query("keyframes_interval", oracle("SELECT video_id, frame_idx FROM frames WHERE frame_idx % 10 = 0"))
def keyframes_interval(t):
    return fr.keyframes_interval(t.frames).select("video_id", "frame_idx")


@query("keyframes_both", oracle("SELECT video_id, frame_idx, CASE WHEN frame_idx % 10 = 0 THEN 'interval' ELSE 'scene_change' END AS reason FROM fd WHERE n_frames / 10.0 >= 2 AND (frame_idx % 10 = 0 OR diff IS NULL OR diff > 5)", DIFF))
def keyframes_both(t):
    return fr.keyframes_both(t.frames).select("video_id", "frame_idx", "reason")


@query("sample_every_n", oracle("SELECT video_id, frame_idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS INTEGER) AS out_idx FROM frames WHERE frame_idx % 30 = 0"))
def sample_every_n(t):
    return fr.sample_every_n(t.frames).select("video_id", "frame_idx", "out_idx")


@query("frame_timestamps", oracle("""
SELECT video_id, frame_idx, frame_idx / 8.0::DOUBLE AS seconds, (frame_idx // 8 // 3600) || ':' || lpad((frame_idx // 8 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((frame_idx // 8 % 60)::VARCHAR, 2, '0') || '.' || lpad((frame_idx % 8 * 125)::VARCHAR, 3, '0') AS timestamp,
  lpad((frame_idx // 8 // 60)::VARCHAR, 2, '0') || ':' || lpad((frame_idx // 8 % 60)::VARCHAR, 2, '0') || '.' || lpad((frame_idx % 8 * 125)::VARCHAR, 3, '0') AS short_timestamp FROM frames"""))
def frame_timestamps(t):
    return fr.with_timestamps(t.frames, 8.0).select("video_id", "frame_idx", "seconds", "timestamp", "short_timestamp")


@query("frame_creation_time", oracle("""
SELECT video_id, frame_idx, epoch_us(c) + frame_idx * 125000 AS created_us FROM (SELECT *, CASE WHEN video_id % 5 = 4 THEN NULL ELSE date_trunc('second', ts) END AS c FROM frames)"""))
def frame_creation_time(t):
    """Creation times in four text formats (and one unknown), each frame's own at 8 frames a second."""
    f = t.frames.withColumn("k", F.pmod("video_id", F.lit(5)))
    text = F.when(F.col("k") == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000000Z'")).when(F.col("k") == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("k") == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("k") == 3, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise("last week")
    made = fr.frame_creation_time(text, F.col("frame_idx") / 8.0)
    return f.select("video_id", "frame_idx", F.unix_micros(made).alias("created_us"))


@query("rolling_latency", oracle("""
SELECT video_id, frame_idx, round(a, 9) AS avg_ms, mn AS min_ms, mx AS max_ms FROM (SELECT video_id, frame_idx, avg(infer_ms) OVER w AS a, min(infer_ms) OVER w AS mn, max(infer_ms) OVER w AS mx FROM frames
WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""))
def rolling_latency(t):
    return fr.rolling_latency(t.frames).select("video_id", "frame_idx", F.round("avg_ms", 9).alias("avg_ms"), "min_ms", "max_ms")


@query("stream_batches", oracle("SELECT video_id, batch, count(*) AS n FROM (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1) // 4 AS batch FROM frames) GROUP BY 1, 2"))
def stream_batches(t):
    return fr.in_batches(t.frames).groupBy("video_id", "batch").agg(F.count(F.lit(1)).alias("n"))


SEG = "px AS (SELECT image_id, CAST(det_id % 7 AS INTEGER) AS seg, CAST(x1 AS INTEGER) + i AS px, CAST(y1 AS INTEGER) + i // 2 AS py FROM det, range(20) r(i) WHERE source = 'vlm')"


@query("segment_stats", oracle("""
SELECT image_id, seg, count(*) AS area, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2, coalesce(['road', 'sky', 'wall'][seg + 1], 'Class ' || seg) AS label, count(*) <= 100 * 0.4 AS is_thing FROM px GROUP BY 1, 2""", SEG))
def segment_stats(t):
    px = t.det.where("source = 'vlm'").selectExpr("image_id", "CAST(det_id % 7 AS INT) AS seg", "x1", "y1", "explode(sequence(0, 19)) AS i").selectExpr("image_id", "seg", "CAST(x1 AS INT) + i AS px", "CAST(y1 AS INT) + i div 2 AS py", "100 AS image_pixels")
    px = px.withColumn("py", F.col("py").cast("int"))
    labels = t.images.sparkSession.createDataFrame([(0, "road"), (1, "sky"), (2, "wall")], "seg int, seg_label string")
    return fr.segment_stats(px, labels)


@query("assign_ids", oracle("SELECT det_id, row_number() OVER (ORDER BY det_id) AS ann_id, 'set_' || det_id AS unique_id FROM det"))
def assign_ids(t):
    return ds.numbered(t.det.select("det_id"), ["det_id"], start=1, column="ann_id").withColumn("unique_id", F.concat(F.lit("set_"), F.col("det_id").cast("string")))


# ---- statistics of runs


def runs(t):
    return t.frames.selectExpr("event_id", "video_id", "event_type <> 'error' AND event_id % 9 <> 0 AS success", "event_type AS backend", "infer_ms / 1000 AS seconds", "CAST(event_id % 400 AS DOUBLE) AS tokens", "CAST(event_id % 50 AS DOUBLE) AS tokens_per_second", "event_id % 5 AS n_objects")


RUNS = "runs AS (SELECT event_id, video_id, event_type <> 'error' AND event_id % 9 <> 0 AS success, event_type AS backend, infer_ms / 1000 AS seconds, CAST(event_id % 400 AS DOUBLE) AS tokens, CAST(event_id % 50 AS DOUBLE) AS tokens_per_second, event_id % 5 AS n_objects FROM frames)"


@query("batch_summary", oracle("SELECT count(*) AS images, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS failed, CAST(sum(n_objects) FILTER (WHERE success) AS BIGINT) AS objects FROM runs", RUNS))
def batch_summary(t):
    return st.batch_summary(runs(t))


@query("video_summary", oracle("SELECT video_id, count(*) AS frames, count(*) FILTER (WHERE frame_idx % 10 = 0) AS extracted, CAST(coalesce(sum(event_id % 5) FILTER (WHERE frame_idx % 10 = 0), 0) AS BIGINT) AS objects FROM frames GROUP BY 1"))
def video_summary(t):
    hit = fr.interval_hit(F.lit(10.0))
    return t.frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(hit).alias("extracted"), F.coalesce(F.sum(F.when(hit, F.col("event_id") % 5)), F.lit(0)).alias("objects"))


@query("performance_summary", oracle("""
SELECT round(avg(CAST(success AS INTEGER)), 6) AS success_rate, (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT backend AS b FROM runs)) AS backends, round(avg(seconds) FILTER (WHERE success), 6) AS avg_s, min(seconds) FILTER (WHERE success) AS min_s,
  max(seconds) FILTER (WHERE success) AS max_s, round(median(seconds) FILTER (WHERE success), 6) AS median_s, round(avg(tokens_per_second) FILTER (WHERE success AND tokens_per_second > 0), 6) AS avg_tps, median(tokens_per_second) FILTER (WHERE success AND tokens_per_second > 0) AS median_tps FROM runs""", RUNS))
def performance_summary(t):
    p = st.performance_summary(runs(t))
    return p.select(*[F.round(c, 6).alias(c) if c in ("success_rate", "avg_s", "median_s", "avg_tps") else c for c in p.columns])


@query("batch_statistics", oracle("""
SELECT round(avg(tokens_per_second), 6) AS mean_tps, median(tokens_per_second) AS median_tps, min(tokens_per_second) AS min_tps, max(tokens_per_second) AS max_tps, round(stddev_samp(tokens_per_second), 6) AS stdev_tps,
  round(count(*) / sum(seconds) * 60, 4) AS images_per_minute, round(sum(tokens) / sum(seconds), 4) AS throughput FROM runs WHERE success""", RUNS))
def batch_statistics(t):
    p = st.batch_statistics(runs(t))
    digits = {"mean_tps": 6, "stdev_tps": 6, "images_per_minute": 4, "throughput": 4}
    return p.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in p.columns])


@query("method_benchmark", oracle("SELECT backend, round(avg(seconds), 6) AS avg_s, min(seconds) AS min_s, max(seconds) AS max_s, count(*) AS n FROM runs GROUP BY 1", RUNS))
def method_benchmark(t):
    return st.method_benchmark(runs(t)).withColumn("avg_s", F.round("avg_s", 6))


@query("compare_backends", oracle("""
SELECT coalesce(a.event_id, b.event_id) AS event_id, a.label AS label_a, b.label AS label_b, coalesce(a.label = b.label, false) AS agree
FROM (SELECT event_id, 'c' || event_id % 3 AS label FROM runs WHERE event_id % 4 <> 0) a FULL JOIN (SELECT event_id, 'c' || event_id % 6 AS label FROM runs WHERE event_id % 5 <> 0) b ON a.event_id = b.event_id""", RUNS))
def compare_backends(t):
    r = runs(t)
    return st.compare_backends(r.where("event_id % 4 <> 0").selectExpr("event_id", "concat('c', event_id % 3) AS label"), r.where("event_id % 5 <> 0").selectExpr("event_id", "concat('c', event_id % 6) AS label"), "event_id")


@query("active_classes", oracle("""
SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS classes, list_reduce(list_transform(range(80), lambda i: CASE WHEN list_contains(list(c), i) THEN '1' ELSE '0' END), lambda x, y: x || y) AS mask
FROM (SELECT DISTINCT CAST(l_partkey % 50 AS INTEGER) AS c FROM boxes WHERE l_partkey % 50 <> 7)"""))
def active_classes(t):
    return st.active_classes(t.boxes.selectExpr("CAST(CASE WHEN l_partkey % 50 = 7 THEN -1 ELSE l_partkey % 50 END AS INT) AS category_id"))


@query("region_groups", oracle("""
SELECT image_id, kind, det_id, kind || '_' || (row_number() OVER (PARTITION BY image_id, kind ORDER BY det_id) - 1) AS region_id, count(*) OVER (PARTITION BY image_id, kind) AS n_kind
FROM (SELECT image_id, det_id, unnest(CASE WHEN label = 'person' THEN ['face'] WHEN label = 'stop sign' THEN ['license_plate'] ELSE [] END) AS kind FROM det)"""))
def region_groups(t):
    regions = fl.privacy_regions(t.det.withColumn("label", F.when(F.col("label") == "stop sign", "plate").otherwise(F.col("label"))))
    return st.region_groups(regions)


@query("detector_mode_comparison", oracle("SELECT image_id, count(*) FILTER (WHERE source = 'yolo') AS yolo, count(*) FILTER (WHERE source = 'detr') AS detr, count(*) FILTER (WHERE source = 'vlm') AS vlm FROM det GROUP BY 1"))
def detector_mode_comparison(t):
    return t.det.groupBy("image_id").pivot("source", ["yolo", "detr", "vlm"]).agg(F.count(F.lit(1))).na.fill(0)


# ---- datasets


@query("mix_datasets", oracle("""
SELECT '0_' || gt_id AS unique_id, 0 AS dataset, category_id FROM gt WHERE category_id <> 3 UNION ALL SELECT '1_' || det_id, 1, category_id FROM det WHERE source = 'yolo'"""))
def mix_datasets(t):
    a = t.gt.selectExpr("gt_id AS id", "CASE WHEN category_id = 3 THEN -1 ELSE category_id END AS category_id")
    return ds.mix_datasets([a, t.det.where("source = 'yolo'").selectExpr("det_id AS id", "category_id")], "id").select("unique_id", "dataset", "category_id")



def _share(key: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({key} || ':0'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296)"


def _long_share(key: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({key} || ':0'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"


@query("weighted_sample", oracle(f"""
SELECT w.draw, a.unique_id, a.dataset FROM (
  SELECT draw, n.dataset, CAST(floor({_long_share("(draw || ':row')")} * n.n) AS BIGINT) AS place
  FROM (SELECT draw, CASE WHEN {_long_share('draw')} <= 0.7::DOUBLE THEN 0 ELSE 1 END AS dataset FROM range(20000) r(draw)) d JOIN (SELECT dataset, count(*) AS n FROM a GROUP BY 1) n ON d.dataset = n.dataset) w
JOIN (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY unique_id) - 1 AS place FROM a) a ON a.dataset = w.dataset AND a.place = w.place""",
    "a AS (SELECT '0_' || gt_id AS unique_id, 0 AS dataset FROM gt UNION ALL SELECT '1_' || det_id, 1 FROM det)"))
def weighted_sample(t):
    """Draws with replacement from two data sets, the smaller one with the larger weight."""
    a = ds.mix_datasets([t.gt.selectExpr("gt_id AS id", "category_id"), t.det.selectExpr("det_id AS id", "category_id")], "id")
    return ds.weighted_sample(a, {0: 0.7, 1: 0.3}, 20_000).select("draw", "unique_id", "dataset")


@query("train_val_split", oracle(f"SELECT image_id, CASE WHEN {_share('image_id')} < 0.8::DOUBLE THEN 'train' ELSE 'val' END AS split FROM images"))
def train_val_split(t):
    return ds.train_val_split(t.images.select("image_id"), "image_id")


@query("kitti_split", oracle("""
SELECT name, 'train' AS split FROM n UNION ALL SELECT name, 'val' FROM (SELECT name, row_number() OVER (ORDER BY name) AS r, count(*) OVER () AS c FROM n) WHERE r > c - CAST(floor(0.2 * c) AS BIGINT)""", "n AS (SELECT lpad(image_id::VARCHAR, 8, '0') AS name FROM images)"))
def kitti_split(t):
    return ds.kitti_split(t.images.selectExpr("lpad(CAST(image_id AS STRING), 8, '0') AS name"))


@query("dedup_detections", oracle("SELECT min(det_id) AS det_id, image_id, label, x1 FROM det GROUP BY image_id, label, x1"))
def dedup_detections(t):
    return ds.dedup_detections(t.det.select("det_id", "image_id", "label", "x1"), ["image_id", "label", "x1"], "det_id")
