"""Box fusion over the derived detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as fu
from . import sqlparts as s
from .fixtures import oracle
from .registry import query

ITEM = "{'o': -score, 'det_id': det_id, 'score': score, 'label': label, 'description': description, 'source': source, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"


def nms_sql(name: str, source: str, keys: str, threshold: float = 0.5) -> str:
    return f"""
{name}_g AS (SELECT {keys}, list({ITEM} ORDER BY -score, det_id) AS b FROM {source} GROUP BY {keys}),
{name} AS (SELECT {keys}, unnest(list_reduce(b, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {s.iou('y', 'x')} > {threshold})) > 0 THEN acc ELSE list_append(acc, x) END, b[1:0])) AS k FROM {name}_g)"""


@query("concat_detectors", oracle("SELECT source, count(*) AS n, CAST(sum(det_id % 1000) AS BIGINT) AS id_sum FROM det GROUP BY 1"))
def concat_detectors(t):
    parts = [t.det.where(F.col("source") == x) for x in ("yolo", "detr")] + [t.det.where("source = 'vlm'").drop("description")]
    return fu.concat_detectors(*parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("det_id") % 1000).alias("id_sum"))


@query("nms", oracle("SELECT image_id, category_id, k.det_id AS det_id, k.score AS score FROM n", nms_sql("n", "det", "image_id, category_id")))
def nms(t):
    return fu.nms(t.det).select("image_id", "category_id", "det_id", "score")


@query("nms_class_agnostic", oracle("""
SELECT image_id, k.det_id AS det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k.o, k.det_id) AS r FROM n) WHERE r <= 10""",
    "d AS (SELECT * FROM det WHERE score > 0.4)", nms_sql("n", "d", "image_id", 0.45)))
def nms_class_agnostic(t):
    return fu.nms(t.det, 0.45, keys=("image_id",), confidence=0.4, most=10).select("image_id", "det_id")


_C = ("x1", "y1", "x2", "y2")
_FRESH = "{'n': 1, 's': x.score, " + ", ".join(f"'w{k}': x.{k} * x.score" for k in _C) + "}"
_JOIN = "{'n': c.n + 1, 's': c.s + x.score, " + ", ".join(f"'w{k}': c.w{k} + x.{k} * x.score" for k in _C) + "}"


def _cluster_iou() -> str:
    i = "(greatest(0.0, least(c.wx2/c.s, x.x2) - greatest(c.wx1/c.s, x.x1)) * greatest(0.0, least(c.wy2/c.s, x.y2) - greatest(c.wy1/c.s, x.y1)))"
    u = f"((c.wx2/c.s - c.wx1/c.s)*(c.wy2/c.s - c.wy1/c.s) + (x.x2-x.x1)*(x.y2-x.y1) - {i})"
    return f"(CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0.0 END)"


_IOUS = f"list_transform(acc, lambda c: {_cluster_iou()})"
WBF = f"""
w_g AS (SELECT image_id, category_id, list({ITEM} ORDER BY -score, det_id) AS b FROM det WHERE score >= 0.3 GROUP BY 1, 2),
w AS (SELECT image_id, category_id, list_reduce(b, lambda acc, x:
    CASE WHEN len(acc) > 0 AND list_max({_IOUS}) > 0.5
      THEN list_transform(acc, lambda c, i: CASE WHEN i = list_position({_IOUS}, list_max({_IOUS})) THEN {_JOIN} ELSE c END)
      ELSE list_append(acc, {_FRESH}) END, list_transform(b[1:0], lambda x: {_FRESH})) AS cs FROM w_g),
wc AS (SELECT image_id, category_id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS cluster FROM w)"""


@query("weighted_box_fusion", oracle("""
SELECT image_id, category_id, CAST(cluster AS INTEGER) AS cluster, CAST(c.n AS INTEGER) AS n, round(c.s / c.n * least(c.n, 3) / 3, 6) AS score, round(c.wx1/c.s, 4) AS x1, round(c.wy1/c.s, 4) AS y1,
  round(c.wx2/c.s, 4) AS x2, round(c.wy2/c.s, 4) AS y2 FROM wc""", WBF))
def weighted_box_fusion(t):
    out = fu.weighted_box_fusion(t.det)
    return out.select("image_id", "category_id", "cluster", "n", F.round("score", 6).alias("score"), *[F.round(c, 4).alias(c) for c in _C])


def merge_sql(name: str, source: str) -> str:
    near = f"({s.iou('x', 'q')} > 0.3 OR {s.distance('x', 'q')} < least(((x.x2-x.x1)+(q.x2-q.x1))/2, ((x.y2-x.y1)+(q.y2-q.y1))/2) * 0.5)"
    used = lambda v: f"len(list_filter(acc, lambda m: len(list_filter(m.members, lambda y: y.det_id = {v}.det_id)) > 0)) > 0"
    return f"""
{name}_g AS (SELECT image_id, list({{'o': -score, 'det_id': det_id, 'score': score, 'label': label, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY -score, det_id) AS b FROM {source}
  WHERE x2-x1 >= 30 OR y2-y1 >= 30 GROUP BY 1),
{name}_m AS (SELECT image_id, unnest(CASE WHEN len(b) <= 20 THEN list_transform(b, lambda x: {{'det_id': x.det_id, 'members': [x]}})
  ELSE list_reduce(b, lambda acc, x: CASE WHEN {used('x')} OR len(acc) >= 20 THEN acc ELSE list_append(acc, {{'det_id': x.det_id, 'members':
    list_filter(b, lambda q: q.det_id = x.det_id OR ((q.o > x.o OR (q.o = x.o AND q.det_id > x.det_id)) AND {near} AND NOT ({used('q')})))}}) END,
    list_transform(b[1:0], lambda x: {{'det_id': x.det_id, 'members': [x]}})) END) AS m FROM {name}_g),
{name} AS (SELECT image_id, m.det_id AS det_id, CAST(len(m.members) AS INTEGER) AS n,
  array_to_string(list_sort(list_distinct(list_transform(m.members, lambda y: y.label))), '/') AS label, list_max(list_transform(m.members, lambda y: y.score)) AS score,
  list_min(list_transform(m.members, lambda y: y.x1)) AS x1, list_min(list_transform(m.members, lambda y: y.y1)) AS y1,
  list_max(list_transform(m.members, lambda y: y.x2)) AS x2, list_max(list_transform(m.members, lambda y: y.y2)) AS y2 FROM {name}_m)"""


@query("merge_nearby_boxes", oracle("SELECT * FROM mg", merge_sql("mg", "det")))
def merge_nearby_boxes(t):
    return fu.merge_nearby_boxes(t.det)


@query("fuse_hybrid", oracle(f"""
SELECT f.image_id, f.det_id, coalesce(v.label, f.label) AS label, f.score, f.x1, f.y1, f.x2, f.y2, coalesce(v.description, 'Detected by ensemble: ' || f.label) AS description,
  CASE WHEN v.det_id IS NOT NULL THEN 'hybrid_vlm' ELSE 'ensemble' END AS source
FROM mg f LEFT JOIN hit h ON f.det_id = h.det_id LEFT JOIN det v ON v.det_id = h.v_id""",
    nms_sql("n", "det", "image_id, category_id"), "kept AS (SELECT image_id, category_id, unnest(k) FROM n)", merge_sql("mg", "kept"),
    f"hit AS (SELECT a.det_id, min(b.det_id) AS v_id FROM mg a JOIN det b ON a.image_id = b.image_id AND b.source = 'vlm' AND ({s.iou('a', 'b')} > 0.3 OR {s.overlap('a', 'b')} > 0.5) GROUP BY 1)"))
def fuse_hybrid(t):
    return fu.fuse_marked(t.by_image.det.withColumn("by_model", F.col("source") == "vlm"))


@query("fuse_sequential", oracle("""
SELECT det_id, source FROM det WHERE source = 'vlm'
UNION ALL SELECT det_id, 'traditional' FROM det a WHERE source = 'yolo' AND NOT EXISTS (
  SELECT 1 FROM det b WHERE b.source = 'vlm' AND a.image_id = b.image_id AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2)"""))
def fuse_sequential(t):
    return fu.fuse_sequential(t.det.where("source = 'yolo'"), t.det.where("source = 'vlm'")).select("det_id", "source")


@query("fuse_cropped", oracle("""
SELECT det_id, CASE WHEN det_id % 3 = 0 THEN label ELSE 'Tree' END AS label, CASE WHEN det_id % 3 = 0 THEN score ELSE 0.9 END AS score,
  CASE WHEN det_id % 3 = 0 THEN 'Detected by traditional detector: ' || label ELSE 'tall ' || det_id END AS description,
  CASE WHEN det_id % 3 = 0 THEN 'traditional_fallback' ELSE 'vlm_cropped' END AS source FROM det WHERE source = 'yolo'"""))
def fuse_cropped(t):
    from ..operators.responses import parse_crop_class

    d = t.det.where("source = 'yolo'")
    said = d.selectExpr("det_id", "CASE WHEN det_id % 3 = 0 THEN 'I see a tree' ELSE concat('RESULT_START\\nObject: tree 0.9 tall ', det_id, '\\nRESULT_END') END AS response")
    parsed = parse_crop_class(said, ["det_id"]).where("label is not null").selectExpr("det_id", "label AS vlm_label", "confidence AS vlm_score", "description AS vlm_description")
    return fu.fuse_cropped(d, parsed).select("det_id", "label", "score", "description", "source")
