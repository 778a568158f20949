"""Tables to annotation formats. The functions build the documents or lines; any Spark writer stores them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import taxonomy as tx
from ..operators.datasets import numbered

CORNERS = ("x1", "y1", "x2", "y2")


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def export_json(ann: DataFrame) -> DataFrame:
    """image and its annotations as one JSON list, by id. ann: image, ann_id, category, x, y, w, h, score."""
    item = F.struct(F.col("ann_id").alias("id"), "category", F.array("x", "y", "w", "h").alias("bbox"), "score")
    return ann.groupBy("image").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("doc"))


def coco_categories(ann: DataFrame, column: str = "category", start: int = 1) -> DataFrame:
    """name, id: consecutive by name; as many rows as there are categories."""
    names = ann.select(F.col(column).alias("name")).distinct()
    return numbered(names, ["name"], start=start, column="id")


def export_coco(ann: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images (id, file_name, width, height), annotations (id, image_id, category_id, x, y, w, h, area, iscrowd) and
    categories (id, name), all ids from 1 in the order of names and annotation ids."""
    cats = coco_categories(ann)
    imgs = numbered(images.select(F.col("image").alias("file_name"), "width", "height"), ["file_name"], start=1, column="id")
    j = ann.join(imgs.select(F.col("file_name").alias("image"), F.col("id").alias("image_id")), "image").join(cats.select(F.col("name").alias("category"), F.col("id").alias("category_id")), "category")
    rows = numbered(j.select("image_id", "ann_id", "category_id", "x", "y", "w", "h"), ["image_id", "ann_id"], start=1, column="id")
    return imgs, rows.withColumns({"area": F.col("w") * F.col("h"), "iscrowd": F.lit(0)}).drop("ann_id"), cats


def coco_documents(images: DataFrame, annotations: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One small COCO document for each image: a data set as a table of documents."""
    a = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "image_id", "category_id", "bbox", "area", "iscrowd"))).alias("annotations"))
    i = images.select(F.col("id").alias("image_id"), F.array(F.struct("id", "width", "height", "file_name")).alias("images"))
    return i.join(a, "image_id", "left").select("image_id", F.to_json(F.struct("images", F.coalesce("annotations", F.array().cast(a.schema["annotations"].dataType)).alias("annotations"))).alias("doc"))


def dataset_to_coco(gt: DataFrame) -> DataFrame:
    """Targets as COCO annotations with ids from 0; a given area stays, else w * h."""
    b = g.to_xywh(g.box())
    area = F.coalesce("area", b[2] * b[3]) if "area" in gt.columns else b[2] * b[3]
    rows = gt.select("gt_id", "image_id", "category_id", *[x.alias(n) for x, n in zip(b, "xywh")], area.alias("area"), F.lit(0).alias("iscrowd"))
    return numbered(rows, ["image_id", "gt_id"], column="id").drop("gt_id")


def kitti_to_coco(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """KITTI boxes (name, category_id, x1..y2) as COCO rows; classes from 90 on go; a missing size is 375 x 1242."""
    b = g.to_xywh(g.box())
    j = boxes.where("category_id < 90").join(sizes, "name", "left")
    return j.select("name", "category_id", *[x.alias(n) for x, n in zip(b, "xywh")], (b[2] * b[3]).alias("area"), F.coalesce("height", F.lit(375)).alias("height"), F.coalesce("width", F.lit(1242)).alias("width"))


def export_yolo(ann: DataFrame, images: DataFrame) -> DataFrame:
    """image, line: "class cx cy w h" with six decimals; classes are numbered from 0 by name."""
    cats = coco_categories(ann, start=0).select(F.col("name").alias("category"), F.col("id").alias("class_id"))
    j = ann.join(images, "image").join(cats, "category")
    y = g.to_yolo(g.from_xywh([F.col(c) for c in "xywh"]), F.col("width"), F.col("height"))
    return j.select("image", "ann_id", "class_id", *[v.alias(n) for v, n in zip(y, ("cx", "cy", "nw", "nh"))]).withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), *[fixed(F.col(n), 6) for n in ("cx", "cy", "nw", "nh")]))


def export_kitti(det: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, det_id, kitti_class, line. A class without a counterpart is DontCare, and goes only if its score is below the threshold."""
    d = det.withColumn("kitti_class", tx.looked_up(F.col("category_id"), tx.COCO_TO_KITTI, "DontCare")).where((F.col("kitti_class") != "DontCare") | (F.col("score") >= threshold))
    zeros = F.lit("0.0 0.0 0.0 0.0 0.0 0.0")
    return d.withColumn("line", F.concat_ws(" ", "kitti_class", F.lit("0.0 0 0.0"), *[fixed(F.col(c), 2) for c in CORNERS], zeros, fixed(F.col("score"), 6)))


def _results(det: DataFrame, box_id: Column, label: str = "label") -> Column:
    p = g.to_percent(g.box(), F.col("width"), F.col("height"))
    value = F.struct(*[x.alias(k) for x, k in zip(p, ("x", "y", "width", "height"))], F.lit(0).alias("rotation"), F.array(label).alias("rectanglelabels"))
    return F.struct(box_id.alias("id"), F.lit("rectanglelabels").alias("type"), F.col("width").alias("original_width"), F.col("height").alias("original_height"), "score", value.alias("value"))


def export_tasks(det: DataFrame, images: DataFrame, label: str = "label", prefix: str = "images/") -> DataFrame:
    """image_id, doc: a task with the image's boxes in percent, by id; ids are bbox_{i}. Malformed boxes are skipped."""
    ok = det.where(g.finite(g.box()) & ~g.degenerate(g.box())).join(images, "image_id")
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")) - 1
    rows = ok.withColumn("n", n)
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", _results(rows, F.concat(F.lit("bbox_"), F.col("n").cast("string")), label).alias("r")))), lambda x: x["r"])
    t = rows.groupBy("image_id").agg(items.alias("result"))
    data = F.struct(F.concat(F.lit(prefix), F.col("image_id").cast("string"), F.lit(".jpg")).alias("image"))
    return t.select("image_id", F.to_json(F.struct(F.col("image_id").alias("id"), data.alias("data"), F.array(F.struct("result")).alias("predictions"))).alias("doc"))


def export_frame_tasks(frames: DataFrame, det: DataFrame) -> DataFrame:
    """image_id, score (mean of the boxes' scores, 0.0 without boxes), n, ids of a frame's task."""
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")) - 1
    d = det.withColumn("n", n).groupBy("image_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.col("n"))), lambda i: F.concat(F.lit("bbox_"), F.col("image_id").cast("string"), F.lit("_"), i.cast("string"))), ",").alias("ids"))
    return frames.join(d, "image_id", "left").select("image_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit("")).alias("ids"))


def export_polygons(det: DataFrame, polygons: DataFrame, images: DataFrame) -> DataFrame:
    """Per box, its rectangle and its polygon in percent: image_id, det_id, kind, points (arrays of x, y). polygons: det_id, points in pixels."""
    w, h = F.col("width"), F.col("height")
    d = det.join(images, "image_id")
    pct = lambda p: F.array(p[0] / w * 100, p[1] / h * 100)
    boxes = d.select("image_id", "det_id", F.lit("rectanglelabels").alias("kind"), F.array(pct([F.col("x1"), F.col("y1")]), pct([F.col("x2"), F.col("y2")])).alias("points"))
    polys = d.join(polygons, "det_id").select("image_id", "det_id", F.lit("polygonlabels").alias("kind"), F.transform("points", lambda p: pct(p)).alias("points"))
    return boxes.unionByName(polys)


def project_manifest(frame_tasks: DataFrame, method: str, blurred: bool, labels: Sequence[str]) -> DataFrame:
    """Per video: frames_count, extraction_method, blurred, label_config."""
    config = "<View><Image name=\"image\" value=\"$image\"/><RectangleLabels name=\"label\" toName=\"image\">" + "".join(f"<Label value=\"{x}\"/>" for x in labels) + "</RectangleLabels></View>"
    return frame_tasks.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_count")).select("video_id", "frames_count", F.lit(method).alias("extraction_method"), F.lit(blurred).alias("blurred"), F.lit(config).alias("label_config"))


def upsert_annotations(current: DataFrame, new: DataFrame, key: str = "image_id") -> DataFrame:
    """The new rows, and the current ones of keys that have no new rows."""
    return current.join(new.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(new)


def delete_images(images: DataFrame, ann: DataFrame, gone: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    return images.join(gone, key, "left_anti"), ann.join(gone, key, "left_anti")


def result_texts(results: DataFrame) -> DataFrame:
    """image_id, text: a header block and the raw response. results: image_id, image_path, model_name, detection_time
    (seconds), n_objects, response."""
    head = F.format_string("Image: %s\nModel: %s\nDetection Time: %.2fs\nObjects Found: %d\n\n" + "=" * 50 + "\n", "image_path", "model_name", F.col("detection_time").cast("double"), F.col("n_objects").cast("long"))
    return results.select("image_id", F.concat(head, F.coalesce("response", F.lit(""))).alias("text"))


def result_files(results: DataFrame, det: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, text, doc: the text block of each result and its task document, null for an image without sound boxes."""
    docs = export_tasks(det, images)
    n = F.coalesce(F.size(F.from_json("doc", "struct<predictions:array<struct<result:array<string>>>>")["predictions"][0]["result"]), F.lit(0))
    j = results.join(docs, "image_id", "left").withColumn("n_objects", n)
    return result_texts(j).join(docs, "image_id", "left")


def save_results(results: DataFrame, det: DataFrame, images: DataFrame, path: str) -> None:
    """Below the path, texts in raw_responses and task documents in json_annotations; in hashed buckets,
    as one folder for each image would be as many folders as images."""
    files = result_files(results, det, images).withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(64)))
    files.select("bucket", "image_id", "text").write.partitionBy("bucket").json(f"{path}/raw_responses")
    files.where("doc is not null").select("bucket", F.col("doc").alias("value")).write.partitionBy("bucket").text(f"{path}/json_annotations")
