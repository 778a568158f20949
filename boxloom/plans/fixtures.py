"""Detection tables derived from the star schema, as DataFrames and as a SQL prefix for the oracles.

Everything is whole-number arithmetic on ``lineitem`` and ``events``, so both engines agree exactly.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import folds
from ..tables import computed

CATEGORIES = ("Car", "Pedestrian", "Tree", "Pothole", "Street sign")
RAW_LABELS = ("car", "person", "potted plant", "bottle", "stop sign")

#: CTEs for the oracles: li, boxes, images, gt, det, frames, responses, resp_lines.
SQL = """
WITH li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
  FROM lineitem),
boxes AS MATERIALIZED (
  SELECT l_orderkey*1000 + l_linenumber*100 + rn AS box_id, l_orderkey // 4 AS image_id,
         CAST((l_partkey*37 + l_orderkey*11) % 440 AS DOUBLE) AS x1,
         CAST((l_suppkey*53 + l_linenumber*17 + l_orderkey*7) % 300 AS DOUBLE) AS y1,
         CAST(20 + (CAST(l_quantity AS BIGINT)*3) % 160 AS DOUBLE) AS w,
         CAST(20 + (l_linenumber*29 + l_partkey) % 120 AS DOUBLE) AS h,
         CAST(l_partkey % 5 AS INTEGER) AS category_id,
         (l_partkey*7919 + l_orderkey*104729 + l_linenumber*31) % 7500 AS s0, l_partkey, l_suppkey, l_linenumber
  FROM li),
images AS (SELECT DISTINCT image_id, 640 AS width, 480 AS height FROM boxes),
gt AS (
  SELECT box_id*10 AS gt_id, image_id, category_id, x1, y1, x1+w AS x2, y1+h AS y2 FROM boxes WHERE l_linenumber % 2 = 1
  UNION ALL
  SELECT box_id*10+1, image_id, category_id, x1+6, y1+4, x1+w+6, y1+h+4 FROM boxes WHERE l_linenumber % 2 = 1 AND l_partkey % 6 = 0),
src(k, source) AS (VALUES (0,'yolo'), (1,'detr'), (2,'vlm')),
jit AS (
  SELECT b.*, s.k, s.source, (l_suppkey+s.k) % 9 - 4 + CASE WHEN (l_partkey+s.k) % 11 = 0 THEN 30 ELSE 0 END AS j
  FROM boxes b CROSS JOIN src s WHERE (l_partkey+s.k) % 4 <> 0),
det0 AS (
  SELECT box_id*10+k AS det_id, image_id, source,
         CAST(CASE WHEN l_partkey % 9 = k THEN (category_id+1) % 5 ELSE category_id END AS INTEGER) AS category_id,
         x1+j AS x1, y1 + (l_partkey+k) % 7 - 3 AS y1, x1+w + (l_suppkey+k) % 5 - 2 + j AS x2, y1+h + (l_partkey+2*k) % 5 - 2 AS y2,
         CAST(((s0+2500)*(k+3)) % 7500 + 2500 AS DOUBLE) / 10000 AS score
  FROM jit),
det AS MATERIALIZED (
  SELECT *, ['car','person','potted plant','bottle','stop sign'][category_id+1] AS label,
         'item ' || det_id AS description FROM det0),
frames AS (
  SELECT video_id, frame_idx, event_id, ts, value AS infer_ms, event_type,
         [((frame_idx // 7)*31 + i*5 + frame_idx % 3) % 256 for i in range(16)] AS gray
  FROM (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_id, ts, value, event_type FROM events)),
resp_lines AS MATERIALIZED (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS n, det_id, label,
         label || ': (' || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || ',' || CAST(x2 AS BIGINT) || ',' || CAST(y2 AS BIGINT) || ') 0.' || CAST(round(score*10000) AS BIGINT) || ' item ' || det_id AS line,
         n || '. **' || label || '**' || chr(10) || '**Bounding Box:** (' || CAST(x1 AS BIGINT) || ', ' || CAST(y1 AS BIGINT) || ', ' || CAST(x2 AS BIGINT) || ', ' || CAST(y2 AS BIGINT) || ')' || chr(10) || 'Description: item ' || det_id AS section,
         'There is one **' || label || '** at (' || CAST(x1 AS BIGINT) || ', ' || CAST(y1 AS BIGINT) || ', ' || CAST(x2 AS BIGINT) || ', ' || CAST(y2 AS BIGINT) || ')' AS prose
  FROM det WHERE source = 'vlm'),
responses AS (
  SELECT image_id, CASE image_id % 6
    WHEN 0 THEN 'RESULT_START' || chr(10) || string_agg(line, chr(10) ORDER BY det_id) || chr(10) || 'RESULT_END'
    WHEN 1 THEN 'RESULT_START' || chr(10) || string_agg(line, chr(10) ORDER BY det_id)
    WHEN 2 THEN string_agg(line, chr(10) ORDER BY det_id)
    WHEN 3 THEN string_agg(section, chr(10) ORDER BY det_id)
    WHEN 4 THEN string_agg(prose, chr(10) ORDER BY det_id)
    ELSE 'RESULT_START' || chr(10) || 'No objects detected' || chr(10) || 'RESULT_END' END AS response
  FROM resp_lines GROUP BY image_id)
"""


def oracle(select: str, *ctes: str) -> str:
    """The prefix, further CTEs and the final SELECT."""
    return SQL + "".join(f", {c}" for c in ctes) + "\n" + select


class Tables:
    """The derived tables of one sf_dir, built on first use. ``dealt_by_image``: boxes and detections of an image lie in one
    partition, at the price of the one shuffle that numbers the boxes."""

    def __init__(self, spark: SparkSession, sf_dir: str, dealt_by_image: bool = False):
        self.spark, self.sf_dir, self.dealt_by_image = spark, sf_dir, dealt_by_image

    @cached_property
    def by_image(self) -> Tables:
        return Tables(self.spark, self.sf_dir, True)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def boxes(self) -> DataFrame:
        li, keys = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"), ["l_orderkey", "l_linenumber"]
        if self.dealt_by_image:
            image = F.expr("l_orderkey div 4")
            li, keys = folds.dealt(li, image, times=folds.FINE), [image, *keys]
        li = li.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")))
        return li.selectExpr(
            "l_orderkey*1000 + l_linenumber*100 + rn AS box_id", "l_orderkey div 4 AS image_id",
            "CAST((l_partkey*37 + l_orderkey*11) % 440 AS DOUBLE) AS x1",
            "CAST((l_suppkey*53 + l_linenumber*17 + l_orderkey*7) % 300 AS DOUBLE) AS y1",
            "CAST(20 + (CAST(l_quantity AS BIGINT)*3) % 160 AS DOUBLE) AS w",
            "CAST(20 + (l_linenumber*29 + l_partkey) % 120 AS DOUBLE) AS h",
            "CAST(l_partkey % 5 AS INT) AS category_id",
            "(l_partkey*7919 + l_orderkey*104729 + l_linenumber*31) % 7500 AS s0", "l_partkey", "l_suppkey", "l_linenumber",
        )

    @cached_property
    def images(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_orderkey div 4 AS image_id").distinct().selectExpr("image_id", "640 AS width", "480 AS height")

    @cached_property
    def gt(self) -> DataFrame:
        odd = self.boxes.where("l_linenumber % 2 = 1")
        shifts = "CASE WHEN l_partkey % 6 = 0 THEN array(0, 1) ELSE array(0) END"
        return odd.selectExpr("*", f"explode({shifts}) AS s").selectExpr(
            "box_id*10 + s AS gt_id", "image_id", "category_id", "x1 + 6*s AS x1", "y1 + 4*s AS y1", "x1 + w + 6*s AS x2", "y1 + h + 4*s AS y2"
        )

    @cached_property
    def det(self) -> DataFrame:
        jit = self.boxes.selectExpr("*", "explode(array(0, 1, 2)) AS k").where("(l_partkey + k) % 4 <> 0")
        jit = jit.selectExpr("*", "(l_suppkey+k) % 9 - 4 + CASE WHEN (l_partkey+k) % 11 = 0 THEN 30 ELSE 0 END AS j")
        made = jit.selectExpr("*", "box_id*10 + k AS det_id", "element_at(array('yolo','detr','vlm'), k+1) AS source")
        det = computed(made, ["det_id", "image_id", "source"], {
            "category_id": F.expr("CAST(CASE WHEN l_partkey % 9 = k THEN (category_id+1) % 5 ELSE category_id END AS INT)"),
            "x1": F.expr("x1 + j"), "y1": F.expr("y1 + (l_partkey+k) % 7 - 3"), "x2": F.expr("x1 + w + (l_suppkey+k) % 5 - 2 + j"), "y2": F.expr("y1 + h + (l_partkey+2*k) % 5 - 2"),
            "score": F.expr("CAST(((s0+2500)*(k+3)) % 7500 + 2500 AS DOUBLE) / 10000"),
        })
        return det.selectExpr("*", "element_at(array('car','person','potted plant','bottle','stop sign'), category_id+1) AS label", "concat('item ', det_id) AS description")

    @cached_property
    def frames(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        ev = self.table("events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("frame_idx", F.row_number().over(w).cast("long") - 1)
        return ev.selectExpr(
            "user_id AS video_id", "frame_idx", "event_id", "ts", "value AS infer_ms", "event_type",
            "transform(sequence(0, 15), i -> ((frame_idx div 7)*31 + i*5 + frame_idx % 3) % 256) AS gray",
        )

    @cached_property
    def resp_lines(self) -> DataFrame:
        w = Window.partitionBy("image_id").orderBy("det_id")
        b = self.det.where("source = 'vlm'").withColumn("n", F.row_number().over(w))
        c = lambda sep: "concat_ws('" + sep + "', " + ", ".join(f"CAST({x} AS BIGINT)" for x in ("x1", "y1", "x2", "y2")) + ")"
        return b.selectExpr(
            "image_id", "n", "det_id", "label",
            f"concat(label, ': (', {c(',')}, ') 0.', CAST(round(score*10000) AS BIGINT), ' item ', det_id) AS line",
            f"concat(n, '. **', label, '**\\n**Bounding Box:** (', {c(', ')}, ')\\nDescription: item ', det_id) AS section",
            f"concat('There is one **', label, '** at (', {c(', ')}, ')') AS prose",
        )

    @cached_property
    def responses(self) -> DataFrame:
        """One model response for each image, in one of six shapes."""
        s = lambda f: f"array_join(transform(array_sort(collect_list(struct(det_id, {f} AS t))), x -> x.t), '\\n')"
        return self.resp_lines.groupBy("image_id").agg(
            F.expr(f"""CASE image_id % 6
              WHEN 0 THEN concat('RESULT_START\\n', {s('line')}, '\\nRESULT_END')
              WHEN 1 THEN concat('RESULT_START\\n', {s('line')})
              WHEN 2 THEN {s('line')}
              WHEN 3 THEN {s('section')}
              WHEN 4 THEN {s('prose')}
              ELSE 'RESULT_START\\nNo objects detected\\nRESULT_END' END""").alias("response")
        )
