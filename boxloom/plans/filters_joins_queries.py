"""Filters and joins over the derived detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import filters as fl
from ..operators import matching as mt
from . import sqlparts as s
from .fixtures import oracle
from .registry import query

COLS = "det_id, x1, y1, x2, y2, score"


@query("filter_confidence", oracle(f"SELECT {COLS}, false AS gt_only FROM det WHERE score > 0.5 UNION ALL SELECT {COLS}, true FROM det WHERE score >= 0.9"))
def filter_confidence(t):
    cols = ["det_id", "x1", "y1", "x2", "y2", "score"]
    a = fl.filter_confidence(t.det, 0.5).select(*cols, F.lit(False).alias("gt_only"))
    return a.unionByName(fl.filter_confidence(t.det, 0.9, strict=False).select(*cols, F.lit(True).alias("gt_only")))


@query("filter_large", oracle("SELECT det_id FROM (SELECT *, x1 - 200 AS a, x2 + 200 AS b FROM det) WHERE (b-a)/640 <= 0.9 AND (y2-y1)/480 <= 0.9 AND (b-a)*(y2-y1)/(640*480) <= 0.8"))
def filter_large(t):
    wide = t.det.withColumns({"x1": F.col("x1") - 200, "x2": F.col("x2") + 200})
    return fl.filter_large(wide, t.images).select("det_id")


@query("filter_small", oracle("SELECT det_id FROM det WHERE x2-x1 >= 30 OR y2-y1 >= 30"))
def filter_small(t):
    return fl.filter_small(t.det).select("det_id")


@query("filter_classes", oracle("SELECT det_id, label FROM det WHERE label IN ('car', 'person')"))
def filter_classes(t):
    return fl.filter_classes(t.det, ("car", "person")).select("det_id", "label")


_DESCRIBED = "SELECT *, CASE WHEN det_id % 13 = 0 THEN 'registration plate' WHEN det_id % 17 = 0 THEN 'Facial view' ELSE description END AS d2 FROM det"


@query("privacy_regions", oracle(f"""
SELECT det_id, 'face' AS kind FROM d WHERE label LIKE '%face%' OR label LIKE '%person%' OR label LIKE '%pedestrian%' OR lower(d2) LIKE '%face%' OR lower(d2) LIKE '%facial%'
UNION ALL SELECT det_id, 'license_plate' FROM d WHERE label LIKE '%license%' OR label LIKE '%plate%' OR d2 LIKE '%license%' OR d2 LIKE '%plate%' OR d2 LIKE '%registration%'""", f"d AS ({_DESCRIBED})"))
def privacy_regions(t):
    described = t.det.withColumn("description", F.expr("CASE WHEN det_id % 13 = 0 THEN 'registration plate' WHEN det_id % 17 = 0 THEN 'Facial view' ELSE description END"))
    return fl.privacy_regions(described).select("det_id", "kind")


@query("blur_candidates", oracle("""
SELECT * FROM (SELECT det_id, greatest(0, least(CAST(x1 AS INTEGER), 640)) AS x1, greatest(0, least(CAST(y1 AS INTEGER), 480)) AS y1,
  greatest(0, least(CAST(x2 AS INTEGER), 640)) AS x2, greatest(0, least(CAST(y2 AS INTEGER), 480)) AS y2 FROM det) WHERE x2-x1 >= 20 AND y2-y1 >= 20"""))
def blur_candidates(t):
    return fl.blur_candidates(t.det, t.images)


@query("valid_image_filter", oracle("SELECT count(*) FILTER (WHERE image_id % 5 <> 0) AS kept, count(*) FILTER (WHERE image_id % 5 = 0) AS dropped FROM det"))
def valid_image_filter(t):
    """Detections of known images, and how many are dropped."""
    known = t.images.where("image_id % 5 <> 0")
    kept = fl.valid_images(t.det, known).agg(F.count(F.lit(1)).alias("kept"))
    return kept.crossJoin(t.det.agg(F.count(F.lit(1)).alias("n"))).select("kept", (F.col("n") - F.col("kept")).alias("dropped"))


@query("label_blank_policy", oracle("""
SELECT det_id, CASE WHEN max(CASE WHEN l <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY image_id) = 0
  THEN ['a', 'b', 'c'][(row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1) % 3 + 1] ELSE l END AS label
FROM (SELECT det_id, image_id, CASE WHEN image_id % 3 = 0 THEN '' WHEN det_id % 2 = 0 THEN '' ELSE label END AS l FROM det)"""))
def label_blank_policy(t):
    some = t.det.withColumn("label", F.expr("CASE WHEN image_id % 3 = 0 THEN '' WHEN det_id % 2 = 0 THEN '' ELSE label END"))
    return fl.label_blank_policy(some, ("a", "b", "c")).select("det_id", "label")


@query("allowed_file", oracle("SELECT image_id, name, image_id % 4 <> 3 AS ok, replace(name, ' ', '_') AS safe FROM (SELECT image_id, 'my image ' || image_id || ['.png', '.JPG', '.gif', '.txt'][image_id % 4 + 1] AS name FROM images)"))
def allowed_file(t):
    names = t.images.selectExpr("image_id", "concat('my image ', image_id, element_at(array('.png', '.JPG', '.gif', '.txt'), CAST(image_id % 4 + 1 AS INT))) AS name")
    return names.select("image_id", "name", tx.allowed_file(F.col("name")).alias("ok"), tx.safe_name(F.col("name")).alias("safe"))


@query("region_exclusion", oracle("""
SELECT det_id FROM (SELECT det_id, (x1+x2)/2/640*100 AS px, (y1+y2)/2/480*100 AS py FROM det)
WHERE NOT (py < 10 OR py > 95 OR px < 5 OR px > 95 OR (px >= 40 AND px <= 60 AND py >= 40 AND py <= 60))"""))
def region_exclusion(t):
    return fl.region_exclusion(t.det, t.images, top=10, bottom=5, left=5, right=5, rect=(40, 40, 60, 60)).select("det_id")


# ---- joins


@query("map_coco_classes", oracle("SELECT det_id, coalesce(m.v, 'Other') AS label, l AS original_label FROM d LEFT JOIN m ON lower(l) = m.k",
    "d AS (SELECT det_id, CASE WHEN det_id % 10 = 0 THEN upper(label) WHEN det_id % 10 = 1 THEN 'zebra crossing' ELSE label END AS l FROM det)", f"m(k, v) AS (VALUES {s.values(tx.COCO_TO_ALLOWED.items())})"))
def map_coco_classes(t):
    d = t.det.withColumn("original_label", F.expr("CASE WHEN det_id % 10 = 0 THEN upper(label) WHEN det_id % 10 = 1 THEN 'zebra crossing' ELSE label END"))
    return d.select("det_id", tx.coco_class(F.col("original_label")).alias("label"), "original_label")


@query("map_step1_classes", oracle("SELECT det_id, coalesce(m.v, 'other') AS step1 FROM (SELECT det_id, CASE WHEN det_id % 10 = 0 THEN upper(label) ELSE label END AS l FROM det) LEFT JOIN m ON l = m.k",
    f"m(k, v) AS (VALUES {s.values(tx.STEP1.items())})"))
def map_step1_classes(t):
    d = t.det.withColumn("l", F.expr("CASE WHEN det_id % 10 = 0 THEN upper(label) ELSE label END"))
    return d.select("det_id", tx.step1_class(F.col("l")).alias("step1"))


FREE = "CASE det_id % 8 WHEN 0 THEN ' Old Person ' WHEN 1 THEN 'stop sign' WHEN 2 THEN 'TREE' WHEN 3 THEN 'traffic light pole' WHEN 4 THEN 'construction worker' WHEN 5 THEN 'delivery van' WHEN 6 THEN 'cat' ELSE label END"


@query("map_free_label", oracle("""
SELECT det_id, l, coalesce(a.name, (SELECT arg_min(f.v, f.i) FROM f WHERE contains(lower(trim(l)), f.k)), 'Other') AS label
FROM d LEFT JOIN a ON lower(trim(l)) = lower(a.name)""", f"d AS (SELECT det_id, {FREE} AS l FROM det)", f"a(name) AS (VALUES {s.values((x,) for x in tx.ALLOWED)})",
    f"f(i, k, v) AS (VALUES {s.values((i, k, v) for i, (k, v) in enumerate(tx.FREE_LABELS))})"))
def map_free_label(t):
    d = t.det.withColumn("l", F.expr(FREE))
    return d.select("det_id", "l", tx.free_label(F.col("l")).alias("label"))


@query("map_category_ids", oracle("""
SELECT box_id, k, CAST(coalesce(m.v, k + 1) AS INTEGER) AS coco_id, coalesce(n.v, 'class_' || k) AS name FROM d LEFT JOIN m USING (k) LEFT JOIN n USING (k)""",
    "d AS (SELECT box_id, CAST(l_partkey % 95 AS INTEGER) AS k FROM boxes)", f"m(k, v) AS (VALUES {s.values(enumerate(tx.COCO_IDS))})", f"n(k, v) AS (VALUES {s.values(enumerate(tx.COCO_NAMES))})"))
def map_category_ids(t):
    d = t.boxes.selectExpr("box_id", "CAST(l_partkey % 95 AS INT) AS k")
    return d.select("box_id", "k", tx.coco_id(F.col("k")).alias("coco_id"), tx.coco_name(F.col("k")).alias("name"))


@query("match_first_over_threshold", oracle(f"""
SELECT a.det_id, min(b.det_id) AS vlm_id FROM det a LEFT JOIN det b ON a.image_id = b.image_id AND b.source = 'vlm' AND ({s.iou('a', 'b')} > 0.3 OR {s.overlap('a', 'b')} > 0.5)
WHERE a.source = 'yolo' GROUP BY 1"""))
def match_first_over_threshold(t):
    from ..operators.fusion import match_first

    return match_first(t.det.where("source = 'yolo'"), t.det.where("source = 'vlm'")).select("det_id", "vlm_id")


MATCHED = f"""
cand AS (
  SELECT d.image_id, d.category_id, list({{'o': -d.score, 'd': d.det_id, 'i': -{s.iou('d', 'g')}, 'g': g.gt_id}} ORDER BY -d.score, d.det_id, -{s.iou('d', 'g')}, g.gt_id) AS c
  FROM det d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id
  WHERE d.source = 'yolo' AND {s.iou('d', 'g')} >= 0.5 GROUP BY ALL),
matched AS (
  SELECT image_id, category_id, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.d = x.d OR y.g = x.g)) > 0 THEN acc ELSE list_append(acc, x) END, c[1:0])) AS m FROM cand),
matches AS (SELECT image_id, category_id, m.d AS det_id, m.g AS gt_id, -m.i AS iou FROM matched)"""


@query("match_ground_truth", oracle("SELECT image_id, category_id, det_id, gt_id, round(iou, 6) AS iou FROM matches", MATCHED))
def match_ground_truth(t):
    m = mt.match_ground_truth(t.det.where("source = 'yolo'"), t.gt)
    return m.withColumn("iou", F.round("iou", 6))


def _two(t):
    return t.det.where("source = 'detr'"), t.det.where("source = 'vlm'")


@query("match_nearest_center", oracle(f"""
SELECT image_id, det_id, parsed_id, round(distance, 6) AS distance FROM (
  SELECT a.image_id, a.det_id, {s.distance('a', 'b')} AS distance, b.det_id AS parsed_id, row_number() OVER (PARTITION BY a.det_id ORDER BY {s.distance('a', 'b')}, b.det_id) AS r
  FROM det a JOIN det b ON a.image_id = b.image_id WHERE a.source = 'detr' AND b.source = 'vlm') WHERE r = 1 AND distance < 50"""))
def match_nearest_center(t):
    return mt.match_nearest_center(*_two(t)).withColumn("distance", F.round("distance", 6))


@query("match_iou_or_distance", oracle(f"""
SELECT a.image_id, a.det_id, coalesce(max(b.det_id) FILTER (WHERE {s.iou('a', 'b')} > 0.3), min(b.det_id) FILTER (WHERE {s.distance('a', 'b')} < 100)) AS parsed_id
FROM det a JOIN det b ON a.image_id = b.image_id WHERE a.source = 'detr' AND b.source = 'vlm' GROUP BY 1, 2 HAVING parsed_id IS NOT NULL"""))
def match_iou_or_distance(t):
    return mt.match_iou_or_distance(*_two(t))


_GAP = "sqrt(pow(greatest(0.0, a.x1-b.x2, b.x1-a.x2), 2) + pow(greatest(0.0, a.y1-b.y2, b.y1-a.y2), 2))"


@query("spatial_relations", oracle(f"""
SELECT a.category_id, b.label AS other_label, count(*) AS n, sum(a.det_id % 1000) AS id_sum FROM det a JOIN det b ON a.image_id = b.image_id
WHERE a.source = 'yolo' AND b.source = 'yolo' AND NOT (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2) AND ({s.iou('a', 'b')} > 0.1 OR {_GAP} < 50) GROUP BY 1, 2""".replace("sum(a.det_id % 1000)", "CAST(sum(a.det_id % 1000) AS BIGINT)")))
def spatial_relations(t):
    d = t.det.where("source = 'yolo'")
    e = mt.spatial_relations(d).join(d.select("image_id", "det_id", "category_id"), ["image_id", "det_id"])
    return e.groupBy("category_id", "other_label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("det_id") % 1000).alias("id_sum"))


_WORDS = s.values((k, w) for k, ws in tx.BOX_KEYWORDS.items() for w in ws)
_LABELS = "['potholes', 'graffiti', 'vehicle blocking bike lane', 'tree overhang', 'no such label']"


@query("assign_labels_to_boxes", oracle("""
SELECT i.image_id, i.vlm_label, min(d.det_id) AS det_id FROM (SELECT image_id, unnest(""" + _LABELS + """) AS vlm_label FROM images) i
LEFT JOIN kw ON i.vlm_label = kw.label
LEFT JOIN (SELECT det_id, image_id, CASE category_id WHEN 0 THEN 'vehicle' WHEN 2 THEN 'Tree' WHEN 3 THEN 'road sign' ELSE 'person' END AS step1 FROM det WHERE source = 'yolo') d
  ON i.image_id = d.image_id AND contains(lower(d.step1), kw.word) GROUP BY 1, 2""", f"kw(label, word) AS (VALUES {_WORDS})"))
def assign_labels_to_boxes(t):
    d = t.det.where("source = 'yolo'").withColumn("step1_label", F.expr("CASE category_id WHEN 0 THEN 'vehicle' WHEN 2 THEN 'Tree' WHEN 3 THEN 'road sign' ELSE 'person' END"))
    labels = t.images.selectExpr("image_id", "explode(array('potholes', 'graffiti', 'vehicle blocking bike lane', 'tree overhang', 'no such label')) AS vlm_label")
    return mt.assign_labels_to_boxes(labels, d, tx.BOX_KEYWORDS).select("image_id", "vlm_label", "det_id")


@query("unanalyzed_boxes", oracle("""
SELECT det_id FROM det a WHERE source = 'yolo' AND NOT EXISTS (SELECT 1 FROM det b WHERE b.source = 'vlm' AND a.image_id = b.image_id AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2)"""))
def unanalyzed_boxes(t):
    from ..operators.fusion import unanalyzed

    return unanalyzed(t.det.where("source = 'yolo'"), t.det.where("source = 'vlm'")).select("det_id")


@query("image_id_by_stem", oracle("SELECT det_id, i.image_id AS coco_id FROM det JOIN images i ON det.image_id = i.image_id WHERE det.image_id % 6 <> 0"))
def image_id_by_stem(t):
    """Detections of files joined to images by the stem of their names."""
    from ..functions.text import stem

    files = t.det.selectExpr("det_id", "concat('/data/run 1/frame_', image_id, CASE WHEN image_id % 2 = 0 THEN '.jpg' ELSE '.png' END) AS path")
    images = t.images.where("image_id % 6 <> 0").selectExpr("image_id AS coco_id", "concat('frame_', image_id, '.jpeg') AS file_name")
    return files.withColumn("stem", stem(F.col("path"))).join(images.withColumn("stem", stem(F.col("file_name"))), "stem").select("det_id", "coco_id")


@query("route_prompt", oracle("""
SELECT det_id, CASE WHEN label = 'potted plant' OR label = 'bottle' THEN 'other' ELSE label END AS prompt_key, CASE WHEN label = 'person' THEN 'face' ELSE 'other' END AS region FROM det"""))
def route_prompt(t):
    label = F.initcap("label")
    return t.det.select("det_id", tx.prompt_key(label).alias("prompt_key"), tx.region_route(label).alias("region"))


@query("reattach_by_index", oracle("""
SELECT o.image_id, det_id, idx, CASE WHEN idx % 4 = 3 THEN 'Other' ELSE 'class ' || idx END AS label, CASE WHEN idx % 4 = 3 THEN 0.5 ELSE CAST(idx AS DOUBLE) / 100 END AS score
FROM (SELECT image_id, det_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS INTEGER) AS idx FROM det WHERE source = 'yolo') o"""))
def reattach_by_index(t):
    d = t.det.where("source = 'yolo'")
    n = d.withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")) - 1)
    results = n.where("idx % 4 <> 3").selectExpr("image_id", "idx", "concat('class ', idx) AS res_label", "CAST(idx AS DOUBLE) / 100 AS res_score")
    return mt.reattach_by_index(d, results)
