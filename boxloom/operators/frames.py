"""Video frames as time series: ordered by frame_idx within a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import elapsed
from .scans import PLACE, RANGE, in_ranges, with_halo


def in_order():
    """A video's frames in order."""
    return Window.partitionBy("video_id").orderBy("frame_idx")


#: Time formats tried in order.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss")


def with_diff(frames: DataFrame) -> DataFrame:
    """Column diff: the mean absolute gray difference from the previous frame, null for the first."""
    return diffed(frames, F.lag("gray").over(in_order()))


def endless_diff(frames: DataFrame) -> DataFrame:
    """video_id, frame_idx, diff as by ``with_diff``, for cameras that never stop: ranges of frames, each with the frame
    before it, so that a camera is many tasks."""
    every = with_halo(in_ranges(frames.select("video_id", "frame_idx", "gray"), ["video_id"], ["frame_idx"]), ["video_id"], 1, ["frame_idx", "gray"])
    before = F.lag("gray").over(Window.partitionBy("video_id", RANGE).orderBy(PLACE))
    return diffed(every, before).where("not halo").select("video_id", "frame_idx", "diff")


def diffed(frames: DataFrame, before: Column) -> DataFrame:
    total = F.aggregate(F.zip_with("gray", before, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return frames.withColumn("diff", F.when(before.isNotNull(), total.cast("double") / F.size("gray")))


def keyframes_scene(frames: DataFrame, threshold: float = 5.0, keep_first: bool = True) -> DataFrame:
    hit = F.col("diff") > threshold
    return with_diff(frames).where(hit | F.col("diff").isNull() if keep_first else hit)


def interval_hit(fps: Column) -> Column:
    """Whole seconds of the frame rate; below 1 frame a second every frame is a hit."""
    return F.col("frame_idx") % F.greatest(fps.cast("int"), F.lit(1)) == 0


def keyframes_interval(frames: DataFrame, fps: float = 10.0) -> DataFrame:
    return frames.where(interval_hit(F.lit(fps)))


def keyframes_both(frames: DataFrame, fps: float = 10.0, threshold: float = 5.0, least_seconds: float = 2.0) -> DataFrame:
    """Frames of a scene change or an interval, with the reason; interval goes first. Shorter videos are skipped."""
    d = with_diff(frames).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("video_id")))
    reason = F.when(interval_hit(F.lit(fps)), "interval").when(F.col("diff").isNull() | (F.col("diff") > threshold), "scene_change")
    return d.where(F.col("__n") / fps >= least_seconds).withColumn("reason", reason).where("reason is not null").drop("__n")


def sample_every_n(frames: DataFrame, n: int = 30) -> DataFrame:
    """Every n-th frame with a consecutive number."""
    return frames.where(F.col("frame_idx") % n == 0).withColumn("out_idx", F.row_number().over(in_order()) - 1)


def with_timestamps(frames: DataFrame, fps: float = 10.0) -> DataFrame:
    s = F.col("frame_idx") / F.lit(fps)
    return frames.withColumns({"seconds": s, "timestamp": elapsed(s), "short_timestamp": elapsed(s, hours=False)})


def creation_time(text: Column) -> Column:
    """The first of the known formats that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def frame_creation_time(text: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(creation_time(text)) + F.floor(seconds * 1000000).cast("long"))


def rolling_latency(frames: DataFrame, last: int = 30) -> DataFrame:
    """Mean, least and most of each camera's last so many times, and the frames a second that the mean allows.

    A camera may never stop: its frames are cut into ranges, which see the last frames of those before."""
    every = with_halo(in_ranges(frames.select("video_id", "frame_idx", "infer_ms"), ["video_id"], ["frame_idx"]), ["video_id"], last - 1, ["frame_idx", "infer_ms"]) if last > 1 else frames.withColumns({RANGE: F.lit(0), PLACE: F.col("frame_idx"), "halo": F.lit(False)})
    w = Window.partitionBy("video_id", RANGE).orderBy(PLACE).rowsBetween(1 - last, 0)
    mean = F.avg("infer_ms").over(w)
    rates = {"avg_ms": mean, "min_ms": F.min("infer_ms").over(w), "max_ms": F.max("infer_ms").over(w)}
    return every.select("video_id", "frame_idx", "halo", *[c.alias(n) for n, c in rates.items()]).where("not halo").select("video_id", "frame_idx", *rates, F.when(F.col("avg_ms") > 0, 1000 / F.col("avg_ms")).alias("fps"))


def in_batches(frames: DataFrame, size: int = 4) -> DataFrame:
    """Column batch: consecutive groups of so many frames of a video, and the rest."""
    return frames.withColumn("batch", F.floor((F.row_number().over(in_order()) - 1) / size).cast("long"))


def refine_boxes(boxes: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """The tight box of each mask (pixels: key, px, py; the last pixel counts), else the box itself."""
    tight = pixels.groupBy(key).agg(F.min("px").alias("a"), F.min("py").alias("b"), (F.max("px") + 1).alias("c"), (F.max("py") + 1).alias("d"))
    return boxes.join(tight, key, "left").select(key, *[F.coalesce(m, o).alias(o) for m, o in zip("abcd", ("x1", "y1", "x2", "y2"))])


def segment_stats(pixels: DataFrame, labels: DataFrame, share: float = 0.4) -> DataFrame:
    """Of each segment of a label map (image_id, seg, px, py, image_pixels): area, tight box, label, is it a thing."""
    s = pixels.groupBy("image_id", "seg").agg(
        F.count(F.lit(1)).alias("area"), F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2"), F.first("image_pixels").alias("image_pixels")
    )
    named = s.join(labels, "seg", "left")
    return named.select("image_id", "seg", "area", "x1", "y1", "x2", "y2", F.coalesce("seg_label", F.concat(F.lit("Class "), F.col("seg").cast("string"))).alias("label"), (F.col("area") <= F.col("image_pixels") * share).alias("is_thing"))
