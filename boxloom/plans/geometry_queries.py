"""Box geometry over the derived detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import sql
from ..functions import taxonomy as tx
from . import sqlparts as s
from .filters_joins_queries import FREE
from .fixtures import oracle
from .registry import query


def size():
    """Width and height of the image, as doubles."""
    return F.col("width").cast("double"), F.col("height").cast("double")


def sized(t):
    return t.det.join(t.images, "image_id")


def rounded(columns, names, digits=6):
    return [F.round(c, digits).alias(n) for c, n in zip(columns, names)]


@query("box_convert", oracle("""
SELECT det_id, x2-x1 AS bw, y2-y1 AS bh, round((x1+(x2-x1)/2)/640, 9) AS ncx, round((y1+(y2-y1)/2)/480, 9) AS ncy, round((x2-x1)/640, 9) AS nw,
  round((y2-y1)/480, 9) AS nh, round(x1/640*100, 9) AS px, round((x2-x1)/640*100, 9) AS pw FROM det"""))
def box_convert(t):
    d, b = sized(t), g.box()
    yolo, pct, wh = g.to_yolo(b, *size()), g.to_percent(b, *size()), g.to_xywh(b)
    return d.select("det_id", wh[2].alias("bw"), wh[3].alias("bh"), *rounded(yolo, ("ncx", "ncy", "nw", "nh"), 9), F.round(pct[0], 9).alias("px"), F.round(pct[2], 9).alias("pw"))


@query("box_convert_back", oracle("SELECT det_id, x1, y1, x2, y2 FROM det"))
def box_convert_back(t):
    """Corners to normalised centres and back, which must give the corners again."""
    d, b = sized(t), g.box()
    back = g.from_centre(g.to_yolo(b, *size()), *size())
    return d.select("det_id", *g.named([F.round(c, 4) for c in back]))


@query("box_area_bucket", oracle("""
SELECT CASE WHEN (x2-x1)*(y2-y1) < 1024 THEN 'small' WHEN (x2-x1)*(y2-y1) < 9216 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n
FROM det GROUP BY 1"""))
def box_area_bucket(t):
    return t.det.groupBy(g.area_bucket(g.area(g.box())).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(t):
    a = t.det.select("image_id", "category_id", *[F.col(c).alias(f"a_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")])
    b = t.det.select("image_id", "category_id", *[F.col(c).alias(f"b_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")])
    return a.join(b, ["image_id", "category_id"]).where("a_det_id < b_det_id")


def _pair_query(name, sql, fn):
    @query(name, oracle(f"""
SELECT a.category_id, count(*) AS n, round(sum({sql('a', 'b')}), 3) AS total, count(*) FILTER (WHERE {sql('a', 'b')} > 0.5) AS above
FROM det a JOIN det b ON a.image_id = b.image_id AND a.category_id = b.category_id AND a.det_id < b.det_id GROUP BY 1"""))
    def run(t):
        v = fn(g.box("a_"), g.box("b_"))
        return _pairs(t).groupBy("category_id").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 3).alias("total"), F.count_if(v > 0.5).alias("above")
        )


_pair_query("box_iou", s.iou, g.iou)
_pair_query("box_overlap_ratio", s.overlap, g.overlap_ratio)
_pair_query("box_center_distance", s.distance, g.centre_distance)


@query("box_validate", oracle(f"SELECT det_id, {s.valid('det', '640', '480')} AS ok FROM det"))
def box_validate(t):
    return sized(t).select("det_id", g.valid(g.box(), *size()).alias("ok"))


@query("box_fix", oracle("""
SELECT det_id, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2
FROM (SELECT det_id, CASE WHEN det_id % 3 = 0 THEN x2 ELSE x1 END AS x1, y1, CASE WHEN det_id % 3 = 0 THEN x1 ELSE x2 END AS x2,
      CASE WHEN det_id % 7 = 0 THEN 'nan'::DOUBLE WHEN det_id % 11 = 0 THEN y1 ELSE y2 END AS y2 FROM det)
WHERE NOT isnan(y2) AND y2 <> y1 AND x2 <> x1"""))
def box_fix(t):
    """Drop NaN and infinite corners, swap inverted ones, drop boxes without area."""
    odd = t.det.selectExpr(
        "det_id", "CASE WHEN det_id % 3 = 0 THEN x2 ELSE x1 END AS x1", "y1", "CASE WHEN det_id % 3 = 0 THEN x1 ELSE x2 END AS x2",
        "CASE WHEN det_id % 7 = 0 THEN double('NaN') WHEN det_id % 11 = 0 THEN y1 ELSE y2 END AS y2",
    )
    ok = odd.where(g.finite(g.box())).select("det_id", *g.named(g.fixed(g.box())))
    return ok.where(g.area(g.box()) > 0)


@query("box_clip", oracle("SELECT det_id, greatest(0.0, least(x1, 640.0)) AS x1, greatest(0.0, least(y1, 480.0)) AS y1, greatest(0.0, least(x2, 640.0)) AS x2, greatest(0.0, least(y2, 480.0)) AS y2 FROM det"))
def box_clip(t):
    return sized(t).select("det_id", *g.named(g.clipped(g.box(), *size())))


@query("box_rescale", oracle("SELECT det_id, round(x1*(1280.0/640), 6) AS x1, round(y1*(720.0/480), 6) AS y1, round(x2*(1280.0/640), 6) AS x2, round(y2*(720.0/480), 6) AS y2 FROM det"))
def box_rescale(t):
    return sized(t).select("det_id", *rounded(g.rescaled(g.box(), *size(), F.lit(1280.0), F.lit(720.0)), ("x1", "y1", "x2", "y2")))


@query("aspect_fit", oracle("""
SELECT det_id, CASE WHEN w/h > 640.0/480 THEN 640 ELSE CAST(trunc(480*(w/h)) AS INTEGER) END AS fit_w,
  CASE WHEN w/h > 640.0/480 THEN CAST(trunc(640/(w/h)) AS INTEGER) ELSE 480 END AS fit_h
FROM (SELECT det_id, x2-x1 AS w, y2-y1 AS h FROM det WHERE y2 > y1 AND x2 > x1)"""))
def aspect_fit(t):
    """Each box's crop, fitted into 640 x 480."""
    d = t.det.where("y2 > y1 AND x2 > x1")
    w, h = g.aspect_fit(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 640, 480)
    return d.select("det_id", w.alias("fit_w"), h.alias("fit_h"))


@query("describe_position", oracle("""
SELECT det_id, CASE WHEN (y1+y2)/2 < 480/3.0 THEN 'top' WHEN (y1+y2)/2 < 2*480/3.0 THEN 'middle' ELSE 'bottom' END || '-' ||
  CASE WHEN (x1+x2)/2 < 640/3.0 THEN 'left' WHEN (x1+x2)/2 < 2*640/3.0 THEN 'center' ELSE 'right' END AS position FROM det"""))
def describe_position(t):
    return sized(t).select("det_id", g.position(g.box(), *size()).alias("position"))


@query("crop_window", oracle("SELECT det_id, greatest(0.0, least(x1-10, 640.0)) AS x1, greatest(0.0, least(y1-10, 480.0)) AS y1, greatest(0.0, least(x2+10, 640.0)) AS x2, greatest(0.0, least(y2+10, 480.0)) AS y2 FROM det"))
def crop_window(t):
    return sized(t).select("det_id", *g.named(g.crop_window(g.box(), *size(), 10.0)))


@query("normalize_bbox", oracle("SELECT det_id, CASE WHEN det_id % 4 = 2 THEN NULL ELSE x1 END AS x1, y1, x2, y2 FROM det"))
def normalize_bbox(t):
    """Boxes as JSON lists or objects; a value that isn't a number becomes null."""
    from ..operators.responses import json_box

    as_list = "concat('[', x1, ',', y1, ',', x2, ',', y2, ']')"
    as_object = "concat('{\"x1\":', CASE WHEN det_id % 4 = 2 THEN '\"n/a\"' ELSE CAST(x1 AS STRING) END, ',\"y1\":', y1, ',\"x2\":', x2, ',\"y2\":', y2, '}')"
    docs = t.det.selectExpr("det_id", f"CASE WHEN det_id % 2 = 1 THEN {as_list} ELSE {as_object} END AS doc")
    return docs.select("det_id", *g.named(json_box(F.col("doc"))))


@query("guess_gt_format", oracle("""
SELECT gt_id, CASE WHEN c > x1 AND d > y1 AND c < 2000 AND d < 2000 THEN 'xyxy' ELSE 'xywh' END AS format
FROM (SELECT gt_id, x1, y1, CASE WHEN gt_id % 2 = 0 THEN x2 ELSE x2-x1 END AS c, CASE WHEN gt_id % 2 = 0 THEN y2 ELSE y2-y1 END AS d FROM gt)"""))
def guess_gt_format(t):
    mixed = t.gt.selectExpr("gt_id", "x1", "y1", "CASE WHEN gt_id % 2 = 0 THEN x2 ELSE x2-x1 END AS x2", "CASE WHEN gt_id % 2 = 0 THEN y2 ELSE y2-y1 END AS y2")
    return mixed.select("gt_id", g.guessed_format(g.box()).alias("format"))


@query("augment_boxes", oracle("""
SELECT gt_id, round(greatest(0.0, least(x1, 640.0)), 6) AS x1, round(greatest(0.0, least(y1, 480.0)), 6) AS y1, round(greatest(0.0, least(x2, 640.0)), 6) AS x2,
  round(greatest(0.0, least(y2, 480.0)), 6) AS y2
FROM (SELECT gt_id, CASE gt_id % 4 WHEN 0 THEN 640-x2 WHEN 1 THEN x1*1.5 WHEN 2 THEN x1+40 ELSE least(-(y1-240)+320, -(y2-240)+320) END AS x1,
  CASE gt_id % 4 WHEN 0 THEN y1 WHEN 1 THEN y1*1.5 WHEN 2 THEN y1-30 ELSE least(x1-320+240, x2-320+240) END AS y1,
  CASE gt_id % 4 WHEN 0 THEN 640-x1 WHEN 1 THEN x2*1.5 WHEN 2 THEN x2+40 ELSE greatest(-(y1-240)+320, -(y2-240)+320) END AS x2,
  CASE gt_id % 4 WHEN 0 THEN y2 WHEN 1 THEN y2*1.5 WHEN 2 THEN y2-30 ELSE greatest(x1-320+240, x2-320+240) END AS y2 FROM gt)
WHERE round(least(x2, 640.0), 6) > round(greatest(0.0, x1), 6) AND round(least(y2, 480.0), 6) > round(greatest(0.0, y1), 6)"""))
def augment_boxes(t):
    """Flip, scale, shift or a quarter turn by id; clip, drop what has no area left."""
    d, b = t.gt.join(t.images, "image_id"), g.box()
    kinds = [g.flipped(b, size()[0]), g.scaled(b, F.lit(1.5)), g.moved(b, F.lit(40.0), F.lit(-30.0)), g.turned(b, *size(), F.lit(90.0))]
    k = F.col("gt_id") % 4
    mixed = [F.when(k == 0, kinds[0][i]).when(k == 1, kinds[1][i]).when(k == 2, kinds[2][i]).otherwise(kinds[3][i]) for i in range(4)]
    out = d.select("gt_id", *rounded(g.clipped(mixed, *size()), ("x1", "y1", "x2", "y2")))
    return out.where(~g.degenerate(g.box()))


@query("refine_box_from_mask", oracle("""
SELECT g.gt_id, coalesce(min(px), any_value(x1)) AS x1, coalesce(min(py), any_value(y1)) AS y1, coalesce(max(px)+1, any_value(x2)) AS x2, coalesce(max(py)+1, any_value(y2)) AS y2
FROM gt g LEFT JOIN (SELECT gt_id, x1 + 2 + i AS px, y1 + 3 + i AS py FROM gt, range(6) r(i) WHERE gt_id % 5 <> 0) m ON g.gt_id = m.gt_id GROUP BY 1"""))
def refine_box_from_mask(t):
    """The tight box of a mask's pixels; boxes without a mask stay."""
    from ..operators.frames import refine_boxes

    pixels = t.gt.where("gt_id % 5 <> 0").selectExpr("gt_id", "x1", "y1", "explode(sequence(0, 5)) AS i").selectExpr("gt_id", "x1 + 2 + i AS px", "y1 + 3 + i AS py")
    return refine_boxes(t.gt.select("gt_id", "x1", "y1", "x2", "y2"), pixels, "gt_id")


@query("sql_functions", oracle(f"""
SELECT a_id, b_id, round({s.iou('a', 'b')}, 6) AS iou, round({s.overlap('a', 'b')}, 6) AS overlap, {s.valid('a', '640', '480')} AS valid FROM pairs WHERE b_id - a_id < 20""", s.PAIRS))
def sql_functions(t):
    """The box functions called from SQL."""
    spark = t.det.sparkSession
    sql.register(spark)
    t.det.selectExpr("image_id", "category_id", "det_id", "named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2) AS b").createOrReplaceTempView("sql_functions_boxes")
    return spark.sql("""SELECT p.det_id AS a_id, q.det_id AS b_id, round(box_iou(p.b, q.b), 6) AS iou, round(box_overlap(p.b, q.b), 6) AS overlap, box_valid(p.b, 640D, 480D) AS valid
      FROM sql_functions_boxes p JOIN sql_functions_boxes q ON p.image_id = q.image_id AND p.category_id = q.category_id AND p.det_id < q.det_id AND q.det_id - p.det_id < 20""")


@query("sql_free_label", oracle("""
SELECT det_id, l, coalesce(a.name, (SELECT arg_min(f.v, f.i) FROM f WHERE contains(lower(trim(l)), f.k)), 'Other') AS label
FROM d LEFT JOIN a ON lower(trim(l)) = lower(a.name)""", f"d AS (SELECT det_id, {FREE} AS l FROM det)", f"a(name) AS (VALUES {s.values((x,) for x in tx.ALLOWED)})",
    f"f(i, k, v) AS (VALUES {s.values((i, k, v) for i, (k, v) in enumerate(tx.FREE_LABELS))})"))
def sql_free_label(t):
    """The mapping of free labels called from SQL."""
    spark = t.det.sparkSession
    sql.register(spark)
    t.det.selectExpr("det_id", f"{FREE} AS l").createOrReplaceTempView("sql_free_label_boxes")
    return spark.sql("SELECT det_id, l, free_label(l) AS label FROM sql_free_label_boxes")
