"""Filters over detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sides() -> tuple[Column, Column]:
    return F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")


def filter_confidence(det: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    return det.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def filter_large(det: DataFrame, images: DataFrame, side: float = 0.9, area: float = 0.8) -> DataFrame:
    """Without boxes wider or higher than the share of the image's side, or larger than the share of its area."""
    j = det.join(images, "image_id")
    w, h = sides()
    return j.where((w / F.col("width") <= side) & (h / F.col("height") <= side) & (w * h / (F.col("width") * F.col("height")) <= area)).select(*det.columns)


def filter_small(det: DataFrame, least: float = 30) -> DataFrame:
    w, h = sides()
    return det.where((w >= least) | (h >= least))


def filter_classes(det: DataFrame, classes: Sequence[str], column: str = "label") -> DataFrame:
    return det.where(F.col(column).isin(*classes))


def privacy_regions(det: DataFrame) -> DataFrame:
    """Boxes of faces and of licence plates, by label or description; one box may be both (column kind)."""
    label, text = F.lower("label"), F.lower(F.coalesce("description", F.lit("")))
    any_of = lambda c, words: F.array_contains(F.array(*[c.contains(w) for w in words]), True)
    face = any_of(label, ("face", "person", "pedestrian")) | any_of(text, ("face", "facial"))
    plate = any_of(label, ("license", "plate")) | any_of(text, ("license", "plate", "registration"))
    kinds = F.filter(F.array(F.when(face, "face"), F.when(plate, "license_plate")), lambda k: k.isNotNull())
    return det.select("*", F.explode(kinds).alias("kind"))


def blur_candidates(det: DataFrame, images: DataFrame, least: int = 20) -> DataFrame:
    """Boxes clipped to their frame as whole numbers, at least so many pixels a side: det_id, x1..y2."""
    lim = lambda c, top: F.greatest(F.lit(0), F.least(F.col(c).cast("int"), F.col(top)))
    out = det.join(images, "image_id").select("det_id", lim("x1", "width").alias("x1"), lim("y1", "height").alias("y1"), lim("x2", "width").alias("x2"), lim("y2", "height").alias("y2"))
    return out.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def valid_images(det: DataFrame, images: DataFrame) -> DataFrame:
    return det.join(images.select("image_id"), "image_id", "left_semi")


def label_blank_policy(det: DataFrame, categories: Sequence[str], mode: str = "fallback") -> DataFrame:
    """Where all labels of an image are blank: ignore (drop), unknown, or fallback (the categories in turn)."""
    blank = F.trim(F.coalesce("label", F.lit(""))) == ""
    image = Window.partitionBy("image_id").orderBy("det_id")  # one order for both windows, so that a task sorts once
    all_blank = F.min(blank).over(image.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # a task's sort is the largest use of memory, and its rows are few in more tasks
    det = det.repartition(4 * int(det.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    if mode == "ignore":
        return det.withColumn("__all", all_blank).where("not __all").drop("__all")
    n = (F.row_number().over(image) - 1) % len(categories) + 1
    new = F.lit("unknown") if mode == "unknown" else F.element_at(F.array(*[F.lit(c) for c in categories]), n)
    return det.withColumn("label", F.when(all_blank, new).otherwise(F.col("label")))


def region_exclusion(det: DataFrame, images: DataFrame, top: float = 0, bottom: float = 0, left: float = 0, right: float = 0, rect: Sequence[float] | None = None) -> DataFrame:
    """Without boxes whose centre lies in an excluded band (percent of a side) or rectangle (percent x1, y1, x2, y2)."""
    j = det.join(images, "image_id")
    px = (F.col("x1") + F.col("x2")) / 2 / F.col("width") * 100
    py = (F.col("y1") + F.col("y2")) / 2 / F.col("height") * 100
    out = (py < top) | (py > 100 - bottom) | (px < left) | (px > 100 - right)
    if rect is not None:
        out = out | ((px >= rect[0]) & (px <= rect[2]) & (py >= rect[1]) & (py <= rect[3]))
    return j.where(~out).select(*det.columns)
