"""Detection metrics of the yolo source against the ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as mt
from ..operators import metrics as me
from . import sqlparts as s
from .filters_joins_queries import MATCHED
from .fixtures import oracle
from .registry import query

BASE = MATCHED + """,
p AS (SELECT d.*, CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM det d LEFT JOIN matches m USING (det_id) WHERE d.source = 'yolo'),
t AS (SELECT g.*, CASE WHEN m.gt_id IS NULL THEN 0 ELSE 1 END AS found FROM gt g LEFT JOIN matches m USING (gt_id)),
ev AS (SELECT image_id, category_id, 1 AS n_pred, 0 AS n_gt, 0 AS tp FROM p UNION ALL SELECT image_id, category_id, 0, 1, 0 FROM gt UNION ALL SELECT image_id, category_id, 0, 0, 1 FROM matches)"""


def rates(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0.0 END AS f1 FROM (
  SELECT *, n_pred - tp AS fp, n_gt - tp AS fn, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision, CASE WHEN n_gt > 0 THEN tp / n_gt ELSE 0.0 END AS recall
  FROM (SELECT {k}CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(tp) AS BIGINT) AS tp FROM ev {group})))"""


RATES = "n_pred, n_gt, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def parts(t):
    d = t.det.where("source = 'yolo'")
    return d, t.gt, mt.match_ground_truth(d, t.gt)


def shown(df, *keys):
    return df.select(*keys, "n_pred", "n_gt", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("image_metrics", oracle(f"SELECT image_id, {RATES} FROM {rates('image_id')}", BASE))
def image_metrics(t):
    return shown(me.image_metrics(*parts(t)), "image_id")


@query("category_metrics", oracle(f"SELECT category_id, {RATES} FROM {rates('category_id')}", BASE))
def category_metrics(t):
    return shown(me.category_metrics(*parts(t)), "category_id")


@query("overall_metrics", oracle(f"SELECT {RATES} FROM {rates('')}", BASE))
def overall_metrics(t):
    return shown(me.overall_metrics(*parts(t)))


STRICT = BASE.replace(">= 0.5 GROUP BY ALL", "> 0.5 GROUP BY ALL")


@query("macro_micro_summary", oracle(f"""
SELECT round(avg(i.precision), 6) AS macro_precision, round(avg(i.recall), 6) AS macro_recall, round(avg(i.f1), 6) AS macro_f1, round(avg(i.precision * i.recall), 6) AS macro_ap,
  round(any_value(o.precision), 6) AS micro_precision, round(any_value(o.recall), 6) AS micro_recall, round(any_value(o.f1), 6) AS micro_f1
FROM {rates('image_id')} i CROSS JOIN {rates('')} o""", STRICT))
def macro_micro_summary(t):
    d = t.det.where("source = 'yolo'")
    out = me.macro_micro(d, t.gt, mt.match_ground_truth(d, t.gt, strict=True))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


CURVE = BASE + """,
curve AS (SELECT category_id, det_id, score, ctp, rank, ctp / rank AS precision, coalesce(ctp / n, 0.0) AS recall FROM (
  SELECT category_id, det_id, score, CAST(sum(tp) OVER w AS BIGINT) AS ctp, count(*) OVER w AS rank FROM p WINDOW w AS (PARTITION BY category_id ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING))
  LEFT JOIN (SELECT category_id, count(*) AS n FROM gt GROUP BY 1) USING (category_id)),
pts(i, r) AS (VALUES """ + ", ".join(f"({i}, {i * 0.1!r}::DOUBLE)" for i in range(11)) + """),
ids AS (SELECT category_id FROM gt UNION SELECT category_id FROM p),
ap AS (SELECT category_id, sum(b) / 11 AS ap FROM (SELECT ids.category_id, i, coalesce(max(precision) FILTER (WHERE recall >= r), 0.0) AS b
  FROM ids CROSS JOIN pts LEFT JOIN curve USING (category_id) GROUP BY 1, 2) GROUP BY 1)"""


@query("pr_curve", oracle("SELECT category_id, det_id, ctp, rank, precision, recall FROM curve", CURVE))
def pr_curve(t):
    c = me.pr_curve(*parts(t))
    return c.select("category_id", "det_id", "ctp", "rank", "precision", "recall")


@query("precision_envelope", oracle("SELECT category_id, det_id, max(precision) OVER (PARTITION BY category_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM curve", CURVE))
def precision_envelope(t):
    return me.precision_envelope(me.pr_curve(*parts(t))).select("category_id", "det_id", "envelope")


def _ap(t):
    d, gt, m = parts(t)
    return me.interpolated_ap(me.pr_curve(d, gt, m), gt, d)


@query("average_precision", oracle("SELECT category_id, round(ap, 6) AS ap FROM ap", CURVE))
def average_precision(t):
    return _ap(t).select("category_id", F.round("ap", 6).alias("ap"))


@query("mean_ap", oracle("SELECT round(avg(ap), 6) AS mean_ap FROM ap", CURVE))
def mean_ap(t):
    return _ap(t).agg(F.round(F.avg("ap"), 6).alias("mean_ap"))


@query("coco_ap", oracle("""
SELECT category_id, round(sum(b) / 101, 6) AS ap FROM (SELECT n.category_id, i, coalesce(max(precision) FILTER (WHERE recall >= CAST(i AS DOUBLE) / 100), 0.0) AS b
  FROM (SELECT DISTINCT category_id FROM gt) n CROSS JOIN range(101) r(i) LEFT JOIN curve USING (category_id) GROUP BY 1, 2) GROUP BY 1""", CURVE))
def coco_ap(t):
    """101-point AP at IoU 0.5 by category."""
    d, gt = t.det.where("source = 'yolo'"), t.gt
    return me.coco_evaluation(d, gt, (0.5,), {"all": me.COCO_AREAS["all"]}, (100,)).select("category_id", F.round("ap", 6).alias("ap"))


LEVELS = ", ".join(f"({x}::DOUBLE)" for x in me.COCO_IOU)


@query("coco_ap_sweep", oracle(f"""
SELECT iou_threshold, round(avg(ap), 6) AS mean_ap FROM (
  SELECT iou_threshold, category_id, sum(b) / 101 AS ap FROM (
    SELECT th.t AS iou_threshold, n.category_id, i, coalesce(max(c.precision) FILTER (WHERE c.recall >= CAST(i AS DOUBLE) / 100), 0.0) AS b
    FROM th CROSS JOIN n CROSS JOIN range(101) r(i) LEFT JOIN tcurve c ON c.t = th.t AND c.category_id = n.category_id GROUP BY ALL) GROUP BY ALL) GROUP BY 1""", f"""
th(t) AS (VALUES {LEVELS}), n AS (SELECT category_id, count(*) AS n FROM gt GROUP BY 1),
tcand AS (
  SELECT t, d.image_id, d.category_id, list({{'o': -d.score, 'd': d.det_id, 'i': -{s.iou('d', 'g')}, 'g': -g.gt_id}} ORDER BY -d.score, d.det_id, -{s.iou('d', 'g')}, -g.gt_id) AS c
  FROM det d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id JOIN th ON {s.iou('d', 'g')} >= t WHERE d.source = 'yolo' GROUP BY ALL),
tm AS (
  SELECT t, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.d = x.d OR y.g = x.g)) > 0 THEN acc ELSE list_append(acc, x) END, c[1:0])) AS m FROM tcand),
tp AS (SELECT th.t, d.category_id, d.det_id, d.score, CASE WHEN tm.m IS NULL THEN 0 ELSE 1 END AS tp FROM det d CROSS JOIN th LEFT JOIN tm ON tm.t = th.t AND tm.m.d = d.det_id WHERE d.source = 'yolo'),
tcurve AS (
  SELECT t, category_id, CAST(sum(tp) OVER w AS BIGINT) / count(*) OVER w AS precision, CAST(sum(tp) OVER w AS BIGINT) / n AS recall FROM tp JOIN n USING (category_id)
  WINDOW w AS (PARTITION BY t, category_id ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING))"""))
def coco_ap_sweep(t):
    """Mean AP by threshold .50 to .95 over all categories."""
    d, gt = t.det.where("source = 'yolo'"), t.gt
    every = me.coco_evaluation(d, gt, areas={"all": me.COCO_AREAS["all"]}, most=(100,))
    return every.groupBy("iou_threshold").agg(F.round(F.avg("ap"), 6).alias("mean_ap"))


AREAS = ", ".join(f"('{n}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for n, (lo, hi) in me.COCO_AREAS.items())
FIGURES = ", ".join(f"('{n}', '{'ap' if ap else 'ar'}', {'NULL' if at is None else at}::DOUBLE, '{area}', {most})" for n, ap, at, area, most in me.COCO_SUMMARY)


@query("coco_summary", oracle("""
SELECT f.metric, round(avg(CASE f.kind WHEN 'ap' THEN e.ap ELSE e.ar END), 6) AS value
FROM figures f LEFT JOIN ev2 e ON e.area = f.area AND e.m = f.m AND (f.iou IS NULL OR e.t = f.iou) GROUP BY 1""", f"""
th(t) AS (VALUES {LEVELS}), ar(area, lo, hi) AS (VALUES {AREAS}), figures(metric, kind, iou, area, m) AS (VALUES {FIGURES}),
g AS MATERIALIZED (SELECT *, gt_id % 13 = 0 AS crowd, (x2-x1)*(y2-y1) AS size FROM gt),
d AS MATERIALIZED (
  SELECT *, (x2-x1)*(y2-y1) AS size FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_id) AS rk FROM det WHERE source = 'yolo') WHERE rk <= 100),
-- what a detection may take, best first: what counts before what is ignored, then by overlap, of equal ones the last
o AS MATERIALIZED (
  SELECT d.image_id, d.category_id, d.det_id, d.rk, g.gt_id, g.crowd, g.size,
    CASE WHEN g.crowd THEN CASE WHEN d.size > 0 THEN {s.inter('d', 'g')} / d.size ELSE 0.0 END ELSE {s.iou('d', 'g')} END AS o
  FROM d JOIN g ON d.image_id = g.image_id AND d.category_id = g.category_id),
c AS (
  SELECT area, t, list({{'r': rk, 'n': crowd OR size < lo OR size > hi, 'o': -o, 'g': -gt_id, 'd': det_id, 'c': crowd}} ORDER BY rk, crowd OR size < lo OR size > hi, -o, -gt_id) AS c
  FROM o JOIN th ON o >= t CROSS JOIN ar GROUP BY area, t, image_id, category_id),
m AS (
  SELECT area, t, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.d = x.d OR (y.g = x.g AND NOT x.c))) > 0 THEN acc ELSE list_append(acc, x) END, c[1:0])) AS m FROM c),
k AS (
  SELECT ar.area, th.t, mx.m, d.category_id, d.det_id, d.score, (m.m IS NOT NULL)::INT AS tp
  FROM d CROSS JOIN ar CROSS JOIN th JOIN (SELECT DISTINCT area, m FROM figures) mx ON mx.area = ar.area AND d.rk <= mx.m
  LEFT JOIN m ON m.area = ar.area AND m.t = th.t AND m.m.d = d.det_id
  WHERE NOT coalesce(m.m.n, d.size < ar.lo OR d.size > ar.hi)),
n AS (SELECT ar.area, category_id, count(*) AS n FROM g JOIN ar ON NOT crowd AND size >= lo AND size <= hi GROUP BY 1, 2),
cv AS (
  SELECT k.area, t, m, k.category_id, CAST(sum(tp) OVER w AS BIGINT) / n AS recall, CAST(sum(tp) OVER w AS BIGINT) / count(*) OVER w AS precision
  FROM k JOIN n ON n.area = k.area AND n.category_id = k.category_id WINDOW w AS (PARTITION BY k.area, t, m, k.category_id ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
-- the best precision by the last recall point that a row reaches, then from there on
pt AS (
  SELECT area, t, m, category_id, p, max(precision) AS precision, max(recall) AS recall
  FROM (SELECT *, CAST(floor(recall * 100) AS INT) AS f, CASE WHEN (f + 1) / 100.0::DOUBLE <= recall THEN f + 1 WHEN f / 100.0::DOUBLE > recall THEN f - 1 ELSE f END AS p FROM cv) GROUP BY ALL),
st AS (SELECT n.area, n.category_id, th.t, mx.m FROM n CROSS JOIN th JOIN (SELECT DISTINCT area, m FROM figures) mx ON mx.area = n.area),
ev2 AS (
  SELECT area, t, m, category_id, sum(best) / 101 AS ap, max(reached) AS ar FROM (
    SELECT st.area, st.t, st.m, st.category_id, i, coalesce(max(pt.precision), 0.0) AS best, coalesce(max(pt.recall), 0.0) AS reached
    FROM st CROSS JOIN range(101) r(i) LEFT JOIN pt ON pt.area = st.area AND pt.t = st.t AND pt.m = st.m AND pt.category_id = st.category_id AND pt.p >= i GROUP BY ALL) GROUP BY ALL)"""))
def coco_summary(t):
    """The twelve figures, with every thirteenth box a crowd."""
    gt = t.gt.withColumn("iscrowd", (F.col("gt_id") % 13 == 0).cast("int"))
    return me.coco_summary(me.coco_evaluation(t.det.where("source = 'yolo'"), gt)).select("metric", F.round("value", 6).alias("value"))


@query("fp_confidence_hist", oracle("SELECT bin, low, count(p.det_id) AS n FROM b LEFT JOIN p ON p.tp = 0 AND p.score >= low AND p.score < high GROUP BY 1, 2", BASE,
    "b(bin, low, high) AS (VALUES " + ", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (lo, hi) in enumerate(me.BINS)) + ")"))
def fp_confidence_hist(t):
    d, _, m = parts(t)
    return me.fp_confidence_hist(me.marked_predictions(d, m))


@query("fn_size_dist", oracle("""
SELECT b.bucket, count(t.gt_id) AS n FROM (VALUES ('small'), ('medium'), ('large')) b(bucket)
LEFT JOIN t ON t.found = 0 AND b.bucket = CASE WHEN (x2-x1)*(y2-y1) < 1024 THEN 'small' WHEN (x2-x1)*(y2-y1) < 9216 THEN 'medium' ELSE 'large' END GROUP BY 1""", BASE))
def fn_size_dist(t):
    _, gt, m = parts(t)
    return me.fn_size_dist(me.marked_truth(gt, m))


@query("threshold_sweep", oracle("""
SELECT threshold, tp, fp, round(precision, 6) AS precision, threshold = (SELECT arg_min(threshold, {'a': -precision, 'b': threshold}) FROM sw) AS best FROM sw""", BASE,
    "th(threshold) AS (VALUES " + ", ".join(f"({x!r}::DOUBLE)" for x in me.SWEEP) + ")",
    "sw AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision FROM (SELECT threshold, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, count(det_id) - CAST(coalesce(sum(tp), 0) AS BIGINT) AS fp FROM th LEFT JOIN p ON score >= threshold GROUP BY 1))"))
def threshold_sweep(t):
    d, _, m = parts(t)
    return me.threshold_sweep(me.marked_predictions(d, m)).withColumn("precision", F.round("precision", 6))


@query("category_problems", oracle(f"SELECT category_id, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ap, 6) AS ap FROM {rates('category_id')} JOIN ap USING (category_id)", CURVE))
def category_problems(t):
    d, gt, m = parts(t)
    c = me.category_metrics(d, gt, m).join(me.interpolated_ap(me.pr_curve(d, gt, m), gt, d), "category_id")
    return c.select("category_id", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "ap")])


@query("top_fp_fn_categories", oracle(f"""
SELECT 'fp' AS kind, category_id, fp AS n FROM (SELECT * FROM {rates('category_id')} WHERE fp > 0 ORDER BY fp DESC, category_id LIMIT 5)
UNION ALL SELECT 'fn', category_id, fn FROM (SELECT * FROM {rates('category_id')} WHERE fn > 0 ORDER BY fn DESC, category_id LIMIT 5)""", BASE))
def top_fp_fn_categories(t):
    c = me.category_metrics(*parts(t))
    one = lambda k: me.top_by(c.where(F.col(k) > 0), k, 5, "category_id").select(F.lit(k).alias("kind"), "category_id", F.col(k).alias("n"))
    return one("fp").unionByName(one("fn"))


@query("worst_images", oracle(f"SELECT image_id, round(f1, 6) AS f1 FROM {rates('image_id')} WHERE n_gt > 0 AND n_pred > 0 ORDER BY round(f1, 9), image_id LIMIT 15", BASE))
def worst_images(t):
    i = me.image_metrics(*parts(t)).where("n_gt > 0 AND n_pred > 0").withColumn("key", F.round("f1", 9))
    return me.top_by(i, "key", 15, "image_id", descending=False).select("image_id", F.round("f1", 6).alias("f1"))


@query("best_images", oracle(f"SELECT image_id, round(f1, 6) AS f1 FROM {rates('image_id')} WHERE n_gt >= 10 ORDER BY round(f1, 9) DESC, image_id LIMIT 10", BASE))
def best_images(t):
    i = me.image_metrics(*parts(t)).where("n_gt >= 10").withColumn("key", F.round("f1", 9))
    return me.top_by(i, "key", 10, "image_id").select("image_id", F.round("f1", 6).alias("f1"))


@query("category_heatmap", oracle(f"""
SELECT category_id, metric, round(v, 6) AS value FROM (SELECT category_id, precision, recall, ap FROM {rates('category_id')} JOIN ap USING (category_id) ORDER BY fp + fn DESC, category_id LIMIT 15)
UNPIVOT (v FOR metric IN (precision, recall, ap))""", CURVE))
def category_heatmap(t):
    d, gt, m = parts(t)
    c = me.category_metrics(d, gt, m).join(me.interpolated_ap(me.pr_curve(d, gt, m), gt, d), "category_id").withColumn("problems", F.col("fp") + F.col("fn"))
    return me.top_by(c, "problems", 15, "category_id").unpivot(["category_id"], ["precision", "recall", "ap"], "metric", "value").withColumn("value", F.round("value", 6))


@query("top_detections_per_image", oracle("SELECT image_id, det_id FROM (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM det) WHERE r <= 20"))
def top_detections_per_image(t):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id"))
    return t.det.withColumn("r", r).where("r <= 20").select("image_id", "det_id")


@query("category_id_stats", oracle("""
SELECT kind, id, n, min(id) OVER (PARTITION BY kind) AS min_id, max(id) OVER (PARTITION BY kind) AS max_id, count(*) OVER (PARTITION BY kind) AS n_ids FROM (
  SELECT 'original' AS kind, category_id AS id, count(*) AS n FROM det GROUP BY 2 UNION ALL
  SELECT 'mapped', CASE WHEN category_id = 4 THEN -1 ELSE category_id + 1 END, count(*) FROM det GROUP BY 2)"""))
def category_id_stats(t):
    """Frequencies of original and mapped ids, with each kind's range and number of ids."""
    from ..operators.stats import id_stats

    return id_stats(t.det, F.col("category_id"), F.when(F.col("category_id") == 4, -1).otherwise(F.col("category_id") + 1))


@query("category_universe", oracle("SELECT category_id FROM gt UNION SELECT category_id FROM det"))
def category_universe(t):
    return t.gt.select("category_id").union(t.det.select("category_id")).distinct()


@query("id_coverage", oracle("""
SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a) AS n_gt, count(*) FILTER (WHERE b) AS n_det FROM (
  SELECT image_id, bool_or(s = 0) AS a, bool_or(s = 1) AS b FROM (SELECT image_id, 0 AS s FROM gt UNION ALL SELECT image_id, 1 FROM det WHERE image_id % 3 <> 0) GROUP BY 1)"""))
def id_coverage(t):
    from ..operators.stats import coverage

    return coverage(t.gt, t.det.where("image_id % 3 <> 0"))
