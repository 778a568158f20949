"""Formats in and out. Documents are built from the derived tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import image_ref
from ..sources import readers as rd
from ..sources import writers as wr
from ..tables import new_path
from .fixtures import CATEGORIES, oracle
from .registry import query

YOLO = "source = 'yolo'"
CLASSES = {"CAR": 2, "pedestrian": 0, "tree": 58}


def _coco_docs(t):
    ann = t.gt.selectExpr("gt_id AS id", "image_id", "CAST(category_id AS BIGINT) AS category_id", "array(x1, y1, x2-x1, y2-y1) AS bbox", "(x2-x1)*(y2-y1) AS area", "CASE WHEN gt_id % 17 = 0 THEN 1 ELSE 0 END AS iscrowd")
    images = t.images.selectExpr("image_id AS id", "width", "height", "concat(image_id, '.jpg') AS file_name")
    docs = wr.coco_documents(images, ann)
    cats = ", ".join(f'{{"id": {i}, "name": "{c}"}}' for i, c in enumerate(CATEGORIES))
    text = docs.select(F.concat(F.expr("substring(doc, 1, length(doc) - 1)"), F.lit(f', "categories": [{cats}]}}')).alias("doc"))
    return text.select(F.from_json("doc", f"struct<{rd.COCO}>").alias("d")).select("d.*")


CLASS = "CASE category_id WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 58 ELSE -1 END"


@query("read_coco", oracle(f"SELECT gt_id AS id, image_id, {CLASS} AS class_id, (x2-x1)*(y2-y1) AS area FROM gt"))
def read_coco(t):
    return rd.coco_tables(_coco_docs(t), CLASSES)[1].select("id", "image_id", "class_id", "area")


@query("read_coco_files", oracle(f"SELECT gt_id AS id, image_id, {CLASS} AS class_id, (x2-x1)*(y2-y1) AS area FROM gt"))
def read_coco_files(t):
    """The documents as files, read block by block."""
    docs = _coco_docs(t)
    folder = new_path(docs.sparkSession, "coco")
    docs.select(F.to_json(F.struct("images", "annotations", "categories"))).write.text(folder)
    return rd.read_coco(docs.sparkSession, folder, CLASSES)[1].select("id", "image_id", "class_id", "area")


@query("clean_coco_annotations", oracle(f"SELECT gt_id AS id, x1, y1, least(x2, 640.0) AS x2, least(y2, 480.0) AS y2, {CLASS} AS class_id FROM gt WHERE gt_id % 17 <> 0 AND {CLASS} <> -1 AND (x2-x1)*(y2-y1) >= 1"))
def clean_coco_annotations(t):
    images, ann, _ = rd.coco_tables(_coco_docs(t), CLASSES)
    return rd.clean_annotations(ann, images).select("id", "x1", "y1", "x2", "y2", "class_id")


NAMES = "element_at(array('Car', 'Pedestrian', 'Cyclist', 'DontCare', 'Unheard'), category_id + 1)"


def _kitti_lines(t):
    return t.det.where(YOLO).selectExpr("CAST(image_id AS STRING) AS name", "det_id", f"concat_ws(' ', {NAMES}, CASE WHEN det_id % 7 = 0 THEN '0.9' ELSE '0.1' END, CAST(det_id % 4 AS STRING), '0.0', x1, y1, x2, y2, '0 0 0 0 0 0 0') AS line")


KITTI = "kt AS (SELECT * FROM (SELECT *, CASE category_id WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END AS c FROM det WHERE source = 'yolo') WHERE det_id % 7 <> 0 AND det_id % 4 <= 2 AND c <> -1)"


@query("read_kitti_labels", oracle("SELECT image_id::VARCHAR AS name, c AS category_id, x1, y1, x2, y2 FROM kt", KITTI))
def read_kitti_labels(t):
    return rd.kitti_boxes(_kitti_lines(t)).select("name", "category_id", "x1", "y1", "x2", "y2")


@query("kitti_to_coco", oracle("SELECT image_id::VARCHAR AS name, c AS category_id, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area, CASE WHEN image_id % 2 = 0 THEN 480 ELSE 375 END AS height, CASE WHEN image_id % 2 = 0 THEN 640 ELSE 1242 END AS width FROM kt", KITTI))
def kitti_to_coco(t):
    sizes = t.images.where("image_id % 2 = 0").selectExpr("CAST(image_id AS STRING) AS name", "width", "height")
    return wr.kitti_to_coco(rd.kitti_boxes(_kitti_lines(t)), sizes)


@query("read_voc", oracle("SELECT image_id, CASE category_id WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 58 END AS category_id, x1, y1, x2, y2 FROM det WHERE source = 'yolo' AND category_id <= 2 AND x2 > x1 AND y2 > y1"))
def read_voc(t):
    obj = F.expr("concat('<object><name>', element_at(array('Car','Pedestrian','Tree','Pothole','Sign'), category_id + 1), '</name><bndbox><xmin>', x1, '</xmin><ymin>', y1, '</ymin><xmax>', x2, '</xmax><ymax>', y2, '</ymax></bndbox></object>')")
    docs = t.det.where(YOLO).groupBy("image_id").agg(F.concat(F.lit("<annotation><size><width>640</width><height>480</height></size>"), F.array_join(F.collect_list(obj), ""), F.lit("</annotation>")).alias("xml"))
    return rd.voc_from_text(docs, "xml", CLASSES, ["image_id"]).select("image_id", "category_id", "x1", "y1", "x2", "y2")


def _tasks(t, prefix="images/"):
    return wr.export_tasks(t.det.where(YOLO).where("image_id % 2 = 0"), t.images, prefix=prefix)


@query("export_tasks", oracle("SELECT image_id, count(*) AS n, round(sum(x1 / 640 * 100), 4) AS x_sum FROM det WHERE source = 'yolo' AND image_id % 2 = 0 AND x2 > x1 AND y2 > y1 GROUP BY 1"))
def export_tasks(t):
    d = _tasks(t).select("image_id", F.from_json("doc", rd.TASK)["predictions"][0]["result"].alias("r"))
    return d.select("image_id", F.size("r").cast("long").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda s, x: s + x["value"]["x"]), 4).alias("x_sum"))


def pixel(v, size):
    return f"CAST(trunc({v} / {size} * 100 / 100 * {size}) AS INTEGER)"


@query("read_label_tasks", oracle(f"""
SELECT 'images/' || image_id || '.jpg' AS image, label, {pixel('x1', 640)} AS x1, {pixel('y1', 480)} AS y1, score FROM det WHERE source = 'yolo' AND image_id % 2 = 0 AND x2 > x1 AND y2 > y1"""))
def read_label_tasks(t):
    """The three document shapes by image."""
    docs = _tasks(t).selectExpr("CASE WHEN image_id % 3 = 0 THEN concat('[', doc, ']') WHEN image_id % 3 = 1 THEN concat('{\"tasks\": [', doc, ']}') ELSE doc END AS doc")
    images = t.images.selectExpr("concat('images/', image_id, '.jpg') AS image", "width", "height")
    return rd.label_tasks(docs, images).select("image", "label", "x1", "y1", "score")


@query("import_predictions", oracle("""
SELECT 'images/' || image_id || '.jpg' AS image, label AS category, round(x1, 6) AS x, round(y2 - y1, 6) AS h, score FROM det WHERE source = 'yolo' AND image_id % 2 = 0 AND x2 > x1 AND y2 > y1"""))
def import_predictions(t):
    return rd.import_predictions(_tasks(t)).select("image", "category", F.round("x", 6).alias("x"), F.round("h", 6).alias("h"), "score")


@query("normalize_image_ref", oracle("SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'out/blurred/' || image_id || '.jpg' ELSE 'images/' || image_id || '.jpg' END AS ref FROM images"))
def normalize_image_ref(t):
    refs = t.images.selectExpr("image_id", "CASE WHEN image_id % 2 = 0 THEN concat('/data/local-files/?d=out/blurred/blurred/', image_id, '.jpg') ELSE concat('http://host/a/b/', image_id, '.jpg') END AS r")
    return refs.select("image_id", image_ref(F.col("r")).alias("ref"))


def _simple(t):
    return t.det.where(YOLO).selectExpr("CAST(image_id AS STRING) AS image", "CAST(det_id AS STRING) AS ann_id", "label AS category", "x1 AS x", "y1 AS y", "x2-x1 AS w", "y2-y1 AS h", "score")


@query("export_json", oracle("""
SELECT image_id::VARCHAR AS image, CAST(row_number() OVER (PARTITION BY image_id ORDER BY det_id::VARCHAR) - 1 AS INTEGER) AS place, det_id::VARCHAR AS id, label AS category, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h, score FROM det WHERE source = 'yolo'"""))
def export_json(t):
    """Every field of the documents, in their order."""
    d = wr.export_json(_simple(t)).select("image", F.posexplode(F.from_json("doc", "array<struct<id:string,category:string,bbox:array<double>,score:double>>")).alias("place", "a"))
    return d.select("image", "place", "a.id", "a.category", *[F.col("a.bbox")[i].alias(n) for i, n in enumerate("xywh")], "a.score")


@query("read_simple_annotations", oracle("SELECT i.image_id::VARCHAR AS image, count(d.det_id) AS n FROM images i LEFT JOIN det d ON i.image_id = d.image_id AND d.source = 'yolo' AND i.image_id % 3 <> 0 GROUP BY 1"))
def read_simple_annotations(t):
    docs = wr.export_json(_simple(t)).where("CAST(image AS BIGINT) % 3 <> 0")
    images = t.images.selectExpr("CAST(image_id AS STRING) AS image")
    return rd.simple_annotations(images, docs).select("image", F.size("annotations").cast("long").alias("n"))


FILES = "element_at(array('.jpg', '.PNG', '.txt', '.gif'), CAST(image_id % 4 + 1 AS INT))"


@query("image_catalog", oracle("SELECT 'd/' || image_id || ['.jpg', '.PNG', '.txt', '.gif'][image_id % 4 + 1] AS path, image_id || ['.jpg', '.PNG', '.txt', '.gif'][image_id % 4 + 1] AS name FROM images WHERE image_id % 4 <> 2"))
def image_catalog(t):
    return rd.image_catalog(t.images.selectExpr(f"concat('d/', image_id, {FILES}) AS path"))


@query("object_listing", oracle("""
SELECT 'object' AS kind, 'raw/' || image_id % 10 || '/' || image_id % 3 || '/' || image_id || '.mp4' AS name FROM images WHERE image_id % 4 = 0
UNION ALL SELECT DISTINCT 'folder', unnest(['raw/', 'raw/' || image_id % 10 || '/', 'raw/' || image_id % 10 || '/' || image_id % 3 || '/']) FROM images"""))
def object_listing(t):
    objects = t.images.selectExpr("concat('raw/', image_id % 10, '/', image_id % 3, '/', image_id, CASE WHEN image_id % 4 = 0 THEN '.mp4' ELSE '.txt' END) AS name")
    files, folders = rd.object_listing(objects, "raw/", ["mp4", "mov"])
    return files.select(F.lit("object").alias("kind"), "name").union(folders.select(F.lit("folder"), "folder"))


@query("incremental_ingest", oracle("SELECT count(*) AS n, CAST(sum(image_id * 10) AS BIGINT) AS bytes FROM images WHERE image_id % 3 <> 0 OR image_id % 2 = 0"))
def incremental_ingest(t):
    remote = t.images.selectExpr("CAST(image_id AS STRING) AS name", "image_id * 10 AS size", "image_id")
    local = remote.where("image_id % 3 = 0").selectExpr("name", "CASE WHEN image_id % 2 = 0 THEN size + 1 ELSE size END AS size")
    return rd.incremental_ingest(remote, local).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("snapshot_with_results", oracle("SELECT image_id AS id, CAST(count(*) AS INTEGER) AS n_results FROM det WHERE source = 'yolo' AND image_id % 2 = 0 AND image_id % 6 <> 0 AND x2 > x1 AND y2 > y1 GROUP BY 1"))
def snapshot_with_results(t):
    docs = _tasks(t).selectExpr("CASE WHEN image_id % 6 = 0 THEN '{\"id\": 1, \"annotations\": [{\"result\": []}]}' ELSE replace(doc, '\"predictions\"', '\"annotations\"') END AS doc")
    return rd.with_results(docs).select("id", "n_results")


@query("load_ocr_results", oracle("""
SELECT folder, name, structured, CAST(row_number() OVER (PARTITION BY folder ORDER BY n) - 1 AS INTEGER) AS position, CASE WHEN structured THEN '{"page": ' || n || '}' ELSE 'text ' || n END AS text FROM (
  SELECT image_id // 20 AS folder, image_id AS n, CASE WHEN image_id % 6 = 0 THEN 'page_' || image_id || '_structured.json' ELSE 'page_' || image_id || '.txt' END AS name, image_id % 6 = 0 AS structured FROM images)"""))
def load_ocr_results(t):
    """Every third page has a structured file, every second of these a broken one."""
    both = t.images.selectExpr("image_id div 20 AS folder", "image_id", "explode(CASE WHEN image_id % 3 = 0 THEN array('_structured.json', '.txt') ELSE array('.txt') END) AS e")
    files = both.selectExpr("folder", "concat('page_', image_id, e) AS name", "image_id AS mtime",
        "CASE WHEN e = '.txt' THEN concat('text ', image_id) WHEN image_id % 6 = 0 THEN concat('{\"page\": ', image_id, '}') ELSE '{\"page\": ' END AS text")
    return rd.ocr_results(files)


@query("video_result_lookup", oracle("""
SELECT 'v/' || v || '.mp4' AS path, folder FROM (SELECT DISTINCT video_id::VARCHAR AS v FROM frames)
JOIN (SELECT video_id || '_frame_' || frame_idx AS folder FROM frames WHERE frame_idx % 10 = 0) ON starts_with(folder, v)"""))
def video_result_lookup(t):
    videos = t.frames.selectExpr("concat('v/', video_id, '.mp4') AS path").distinct()
    folders = t.frames.where("frame_idx % 10 = 0").selectExpr("concat(video_id, '_frame_', frame_idx) AS folder")
    return rd.video_results(videos, folders)


@query("video_metadata", oracle("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'f' || event_id WHEN 1 THEN 's' || event_id ELSE 'm' || event_id END AS creation_time, CASE WHEN event_id % 3 = 0 THEN 'loc' || event_id END AS location FROM frames"""))
def video_metadata(t):
    docs = t.frames.selectExpr("event_id", "concat('m', event_id) AS mtime", """CASE event_id % 3 WHEN 0 THEN concat('{"format": {"tags": {"creation_time": "f', event_id, '", "location": "loc', event_id, '", "title": "x"}}}')
      WHEN 1 THEN concat('{"format": {"tags": {}}, "streams": [{"tags": {"x": "y"}}, {"tags": {"creation_time": "s', event_id, '"}}]}') ELSE '{}' END AS doc""")
    m = rd.video_metadata(docs, ["event_id"])
    return m.select("event_id", "creation_time", F.try_element_at("gps", F.lit("location")).alias("location"))


@query("read_latest_outputs", oracle("SELECT kind, name, CAST(r AS INTEGER) AS rank FROM (SELECT event_type AS kind, event_id AS name, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM frames) WHERE r <= 5"))
def read_latest_outputs(t):
    return rd.latest_outputs(t.frames.selectExpr("event_type AS kind", "event_id AS name", "ts AS mtime")).select("kind", "name", "rank")


@query("export_coco", oracle("""
SELECT row_number() OVER (ORDER BY image_id, ann_id) AS id, image_id, category_id, x, y, w, h, w*h AS area, 0 AS iscrowd FROM (
  SELECT i.id AS image_id, det_id::VARCHAR AS ann_id, c.id AS category_id, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h FROM det
  JOIN (SELECT image_id::VARCHAR AS n, row_number() OVER (ORDER BY image_id::VARCHAR) AS id FROM images) i ON i.n = det.image_id::VARCHAR
  JOIN (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT DISTINCT label FROM det WHERE source = 'yolo')) c USING (label) WHERE source = 'yolo')"""))
def export_coco(t):
    images = t.images.selectExpr("CAST(image_id AS STRING) AS image", "width", "height")
    return wr.export_coco(_simple(t), images)[1].select("id", "image_id", "category_id", "x", "y", "w", "h", "area", "iscrowd")


@query("export_coco_tables", oracle("""
SELECT 'image' AS kind, row_number() OVER (ORDER BY image_id::VARCHAR) AS id, image_id::VARCHAR AS name, width, height FROM images
UNION ALL SELECT 'category', row_number() OVER (ORDER BY label), label, NULL, NULL FROM (SELECT DISTINCT label FROM det WHERE source = 'yolo')"""))
def export_coco_tables(t):
    """The images and categories of the export."""
    images, _, cats = wr.export_coco(_simple(t), t.images.selectExpr("CAST(image_id AS STRING) AS image", "width", "height"))
    images = images.select(F.lit("image").alias("kind"), "id", F.col("file_name").alias("name"), "width", "height")
    return images.union(cats.select(F.lit("category"), "id", "name", F.lit(None).cast("int"), F.lit(None).cast("int")))


@query("dataset_to_coco", oracle("SELECT row_number() OVER (ORDER BY image_id, gt_id) - 1 AS id, image_id, category_id, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area FROM gt"))
def dataset_to_coco(t):
    return wr.dataset_to_coco(t.gt).select("id", "image_id", "category_id", "x", "y", "w", "h", "area")


def sixth(millionths: str) -> str:
    """SQL: a number given in millionths, with six decimals, halves rounded up."""
    n = f"CAST(floor({millionths} + 0.5) AS BIGINT)"
    return f"({n} // 1000000 || '.' || lpad(CAST({n} % 1000000 AS VARCHAR), 6, '0'))"


@query("export_yolo", oracle("""
SELECT image_id::VARCHAR AS image, det_id::VARCHAR AS ann_id, class_id || ' ' || """ + " || ' ' || ".join(sixth(v) for v in ("(x1+x2)*781.25", "(y1+y2)*3125/3", "(x2-x1)*1562.5", "(y2-y1)*6250/3")) + """ AS line FROM det
JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_id FROM (SELECT DISTINCT label FROM det WHERE source = 'yolo')) USING (label) WHERE source = 'yolo'"""))
def export_yolo(t):
    images = t.images.selectExpr("CAST(image_id AS STRING) AS image", "width", "height")
    return wr.export_yolo(_simple(t), images).select("image", "ann_id", "line")


@query("export_kitti", oracle("""
SELECT det_id, k AS kitti_class, k || ' 0.0 0 0.0 ' || CAST(x1 AS BIGINT) || '.00 ' || CAST(y1 AS BIGINT) || '.00 ' || CAST(x2 AS BIGINT) || '.00 ' || CAST(y2 AS BIGINT) || '.00 0.0 0.0 0.0 0.0 0.0 0.0 0.' || CAST(round(score * 10000) AS BIGINT) || '00' AS line
FROM (SELECT *, CASE category_id WHEN 0 THEN 'Pedestrian' WHEN 1 THEN 'Cyclist' WHEN 2 THEN 'Car' WHEN 3 THEN 'Cyclist' ELSE 'DontCare' END AS k FROM det WHERE source = 'yolo') WHERE k <> 'DontCare' OR score >= 0.5"""))
def export_kitti(t):
    return wr.export_kitti(t.det.where(YOLO)).select("det_id", "kitti_class", "line")


@query("export_frame_tasks", oracle("""
SELECT i.image_id, round(coalesce(avg(score), 0), 9) AS score, count(det_id) AS n, coalesce(string_agg('bbox_' || i.image_id || '_' || k, ',' ORDER BY k), '') AS ids
FROM images i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS k FROM det WHERE source = 'yolo' AND image_id % 3 <> 0) d ON i.image_id = d.image_id GROUP BY 1"""))
def export_frame_tasks(t):
    out = wr.export_frame_tasks(t.images.select("image_id"), t.det.where(YOLO).where("image_id % 3 <> 0"))
    return out.withColumn("score", F.round("score", 9))


@query("export_two_step_tasks", oracle("SELECT image_id, string_agg(description, '|' ORDER BY det_id) AS labels FROM det WHERE source = 'yolo' AND x2 > x1 AND y2 > y1 GROUP BY 1"))
def export_two_step_tasks(t):
    """Tasks labelled with the model's description, on local-files paths."""
    d = wr.export_tasks(t.det.where(YOLO), t.images, label="description", prefix="/data/local-files/?d=")
    r = F.from_json("doc", rd.TASK)["predictions"][0]["result"]
    return d.select("image_id", F.array_join(F.transform(r, lambda x: x["value"]["rectanglelabels"][0]), "|").alias("labels"))


@query("export_polygons", oracle("""
SELECT det_id, kind, CAST(i AS INTEGER) AS place, round(p[1]/640*100, 9) AS x, round(p[2]/480*100, 9) AS y FROM (
  SELECT det_id, kind, unnest(points) AS p, generate_subscripts(points, 1) - 1 AS i FROM (
    SELECT det_id, 'rectanglelabels' AS kind, [[x1, y1], [x2, y2]] AS points FROM det WHERE source = 'yolo'
    UNION ALL SELECT det_id, 'polygonlabels', [[x1+1, y1], [x2, y1], [x2, y2]] FROM det WHERE source = 'yolo' AND det_id % 2 = 0))"""))
def export_polygons(t):
    d = t.det.where(YOLO)
    polys = d.where("det_id % 2 = 0").selectExpr("det_id", "array(array(x1+1, y1), array(x2, y1), array(x2, y2)) AS points")
    out = wr.export_polygons(d, polys, t.images).select("det_id", "kind", F.posexplode("points").alias("place", "p"))
    return out.select("det_id", "kind", "place", F.round(F.col("p")[0], 9).alias("x"), F.round(F.col("p")[1], 9).alias("y"))


CONFIG = "<View><Image name=\"image\" value=\"$image\"/><RectangleLabels name=\"label\" toName=\"image\">" + "".join(f"<Label value=\"{c}\"/>" for c in CATEGORIES) + "</RectangleLabels></View>"


@query("project_manifest", oracle(f"SELECT video_id, count(*) AS frames_count, 'interval' AS extraction_method, true AS blurred, '{CONFIG}' AS label_config FROM frames WHERE frame_idx % 10 = 0 GROUP BY 1"))
def project_manifest(t):
    return wr.project_manifest(t.frames.where("frame_idx % 10 = 0"), "interval", True, CATEGORIES)


@query("upsert_annotations", oracle("SELECT image_id, det_id, label FROM det WHERE source = 'yolo' AND image_id NOT IN (SELECT image_id FROM det WHERE source = 'vlm' AND image_id % 5 = 0) UNION ALL SELECT image_id, det_id, label FROM det WHERE source = 'vlm' AND image_id % 5 = 0"))
def upsert_annotations(t):
    d = t.det.select("image_id", "det_id", "label", "source")
    return wr.upsert_annotations(d.where(YOLO).drop("source"), d.where("source = 'vlm' AND image_id % 5 = 0").drop("source"))


@query("delete_images", oracle("SELECT (SELECT count(*) FROM images WHERE image_id % 7 <> 0) AS n_images, (SELECT count(*) FROM det WHERE image_id % 7 <> 0) AS n_ann"))
def delete_images(t):
    images, ann = wr.delete_images(t.images, t.det, t.images.where("image_id % 7 = 0").select("image_id"))
    return images.agg(F.count(F.lit(1)).alias("n_images")).crossJoin(ann.agg(F.count(F.lit(1)).alias("n_ann")))


@query("save_results", oracle("""
SELECT r.image_id, 'Image: ' || r.image_id || '.jpg' || chr(10) || 'Model: m' || r.image_id % 3 || chr(10) || 'Detection Time: ' || r.image_id % 7 || '.25s' || chr(10) || 'Objects Found: ' || coalesce(n, 0)
  || chr(10) || chr(10) || repeat('=', 50) || chr(10) || response AS text, coalesce(n, 0) AS n_boxes, x_sum
FROM responses r LEFT JOIN (SELECT image_id, count(*) AS n, round(sum(x1 / 640 * 100), 4) AS x_sum FROM det WHERE source = 'yolo' AND x2 > x1 AND y2 > y1 GROUP BY 1) d ON d.image_id = r.image_id"""))
def save_results(t):
    """Both files of each image: the text block, and the task document, of which the boxes are read back."""
    results = t.responses.selectExpr("image_id", "concat(image_id, '.jpg') AS image_path", "concat('m', image_id % 3) AS model_name", "image_id % 7 + 0.25D AS detection_time", "response")
    d = wr.result_files(results, t.det.where(YOLO), t.images)
    boxes = F.from_json("doc", rd.TASK)["predictions"][0]["result"]
    return d.select("image_id", "text", F.coalesce(F.size(boxes), F.lit(0)).cast("long").alias("n_boxes"), F.round(F.aggregate(boxes, F.lit(0.0), lambda s, x: s + x["value"]["x"]), 4).alias("x_sum"))
