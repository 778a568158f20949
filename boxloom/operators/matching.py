"""Matching of boxes to ground truth, to other boxes and to labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

CORNERS = ("x1", "y1", "x2", "y2")


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def match_ground_truth(det: DataFrame, gt: DataFrame, threshold: float = 0.5, strict: bool = False, keys: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """Pairs det_id, gt_id, iou (with the keys): predictions by falling score, each takes its best free ground truth.

    Candidate pairs are made by an equi-join on the keys and cut to the threshold before the greedy fold, which so sees
    real candidates only.
    """
    d = prefixed(det.select(*keys, "det_id", "score", *CORNERS), keys, "d_")
    t = prefixed(gt.select(*keys, "gt_id", *CORNERS), keys, "g_")
    v = g.iou(g.box("d_"), g.box("g_"))
    pairs = d.join(t, list(keys)).select(*keys, F.col("d_det_id").alias("d"), F.col("d_score").alias("s"), F.col("g_gt_id").alias("g"), v.alias("iou"))
    pairs = pairs.where(F.col("iou") > threshold if strict else F.col("iou") >= threshold)
    item = F.struct((-F.col("s")).alias("o"), F.col("d"), (-F.col("iou")).alias("i"), F.col("g"))
    taken = F.aggregate(
        "c",
        F.slice(F.col("c"), 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["d"] == x["d"]) | (y["g"] == x["g"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    out = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c")).select(*keys, F.explode(taken).alias("m"))
    return out.select(*keys, F.col("m.d").alias("det_id"), F.col("m.g").alias("gt_id"), (-F.col("m.i")).alias("iou"))


def match_nearest_center(boxes: DataFrame, parsed: DataFrame, within: float = 50.0, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Each box with the parsed box of least centre distance, where that is below the limit: det_id, parsed_id, distance."""
    p = prefixed(parsed.select(*keys, F.col("det_id").alias("id"), *CORNERS), keys, "p_")
    d = g.centre_distance(g.box(), g.box("p_"))
    best = boxes.join(p, list(keys)).groupBy(*keys, "det_id").agg(F.min(F.struct(d.alias("distance"), F.col("p_id").alias("parsed_id"))).alias("m"))
    return best.select(*keys, "det_id", "m.parsed_id", "m.distance").where(F.col("distance") < within)


def match_iou_or_distance(boxes: DataFrame, parsed: DataFrame, min_iou: float = 0.3, within: float = 100.0, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """A scan over the parsed boxes in order of id: one that overlaps enough replaces the match; else the first within
    the distance is taken if there is none yet. det_id, parsed_id."""
    p = prefixed(parsed.select(*keys, F.col("det_id").alias("id"), *CORNERS), keys, "p_")
    near = F.when(g.centre_distance(g.box(), g.box("p_")) < within, F.col("p_id"))
    over = F.when(g.iou(g.box(), g.box("p_")) > min_iou, F.col("p_id"))
    # the last that overlaps wins, whatever came before; without one, the first near
    best = boxes.select(*keys, "det_id", *CORNERS).join(p, list(keys)).groupBy(*keys, "det_id").agg(F.coalesce(F.max(over), F.min(near)).alias("parsed_id"))
    return best.where("parsed_id is not null")


def spatial_relations(det: DataFrame, min_iou: float = 0.1, within: float = 50.0, keys: Sequence[str] = ("image_id",), dense: int = 256) -> DataFrame:
    """Edges det_id -> other_id, other_label (lower case) between boxes that overlap or lie close; boxes of equal
    coordinates are no relation, and a box that lacks a coordinate has none.

    What is related lies within the gap on both axes. In an image of more than ``dense`` boxes, boxes meet in the cells of
    a grid as wide as a box and the gap are on average, one with the gap around it; a pair belongs to the one cell in which
    the two areas' common corner lies. Other images are one cell."""
    w, reach, far = Window.partitionBy(*keys), max(within, 0.0), min_iou < 0  # below 0 all boxes of an image are related
    edge = F.avg(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).over(w)
    own = det.dropna(subset=list(CORNERS)).select(*keys, "det_id", "label", *CORNERS, F.when((F.count(F.lit(1)).over(w) > dense) & F.lit(not far), F.greatest(edge, F.lit(1.0)) + reach).alias("cell"))

    def in_cells(df: DataFrame, margin: float) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - margin) / F.col("cell")), F.floor((F.col(hi) + margin) / F.col("cell")))
        pair = lambda x, y: F.struct(x.cast("long").alias("cx"), y.cast("long").alias("cy"))
        grid = F.flatten(F.transform(span("x1", "x2"), lambda x: F.transform(span("y1", "y2"), lambda y: pair(x, y))))
        return df.withColumn("at", F.explode(F.when(F.col("cell").isNull(), F.array(pair(F.lit(0), F.lit(0)))).otherwise(grid))).select("*", "at.cx", "at.cy").drop("at")

    o = prefixed(in_cells(own, 0.0).drop("cell"), [*keys, "cx", "cy"], "o_")
    a, b = g.box(), g.box("o_")
    same = (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
    owner = lambda k, c: F.col(c) == F.floor(F.greatest(a[k] - reach, b[k]) / F.col("cell"))
    here = F.col("cell").isNull() | (owner(0, "cx") & owner(1, "cy"))
    hit = (g.iou(a, b) > min_iou) | (g.gap(a, b) < within)
    pairs = in_cells(own, reach).join(o, [*keys, "cx", "cy"]).where(here & ~same & hit)
    return pairs.select(*keys, "det_id", F.col("o_det_id").alias("other_id"), F.lower("o_label").alias("other_label"))


def assign_labels_to_boxes(labels: DataFrame, det: DataFrame, keywords: Mapping[str, Sequence[str]], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Each label with the first detection whose step-1 label holds one of the label's keywords, else null."""
    cond: Column = F.lit(False)
    for label, words in keywords.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower("step1_label").contains(w)
        cond = cond | ((F.col("vlm_label") == label) & hit)
    hits = labels.join(det.select(*keys, "det_id", "step1_label"), list(keys)).where(cond)
    first = hits.groupBy(*keys, "vlm_label").agg(F.min("det_id").alias("det_id"))
    return labels.join(first, [*keys, "vlm_label"], "left")


def reattach_by_index(objects: DataFrame, results: DataFrame, default_label: str = "Other", default_score: float = 0.5, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Objects numbered within their image (``idx`` from 0) with the result of that number; defaults where there is none."""
    numbered = objects.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("det_id")) - 1)
    j = numbered.join(results.select(*keys, "idx", "res_label", "res_score"), [*keys, "idx"], "left")
    return j.select(*keys, "det_id", "idx", F.coalesce("res_label", F.lit(default_label)).alias("label"), F.coalesce("res_score", F.lit(default_score)).alias("score"))
