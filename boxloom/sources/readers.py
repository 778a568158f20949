"""Annotation formats to tables.

Each format has a function on documents or lines that are already in a DataFrame, and a ``read_…`` function that loads
them from a path with Spark's readers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import taxonomy as tx
from ..functions.text import image_ref
from ..tables import computed
from .coco_blocks import read_sections

CORNERS = ("x1", "y1", "x2", "y2")
COCO = (
    "images array<struct<id:bigint,width:int,height:int,file_name:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>, "
    "categories array<struct<id:bigint,name:string>>"
)
VALUE = "struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>"
RESULT = f"array<struct<id:string,type:string,original_width:int,original_height:int,score:double,value:{VALUE}>>"
TASK = f"struct<id:bigint,data:struct<image:string>,predictions:array<struct<result:{RESULT}>>,annotations:array<struct<result:{RESULT}>>>"


def coco_tables(docs: DataFrame, classes: Mapping[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """COCO documents (columns images, annotations, categories) to images, annotations and categories.

    A category gets the class id of its name in any case, else -1; annotations carry it as class_id. A category id means
    what its own document says, so the annotations need no join. A document is one row, and so one task's: ``read_coco``
    reads large files block by block."""
    cats = docs.select(F.explode("categories").alias("c")).select("c.*").distinct().withColumn("class_id", class_of(F.col("name"), classes))
    own = lambda a: F.coalesce(class_of(F.get(F.filter("categories", lambda c: c["id"] == a["category_id"]), F.lit(0))["name"], classes), F.lit(-1))
    # looked up before the annotations become rows, which then don't carry the categories
    ann = docs.select(F.explode(F.transform("annotations", lambda a: F.struct(a.alias("a"), own(a).alias("class_id")))).alias("x")).select("x.a.*", "x.class_id")
    return docs.select(F.explode("images").alias("i")).select("i.*"), ann, cats


def class_of(name: Column, classes: Mapping[str, int]) -> Column:
    """The class id of a category's name in any case, else -1."""
    return tx.looked_up(F.lower(name), {k.lower(): v for k, v in classes.items()}, -1)


def read_coco(spark: SparkSession, path: str, classes: Mapping[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``coco_tables`` from files. A document is read by as many tasks as it has blocks; its categories meet its
    annotations in a join on document and id."""
    kinds = {n: t for n, t in (f.split(" array<", 1) for f in COCO.split(", "))}
    every = read_sections(spark, path, list(kinds))
    part = {n: every.where(F.col("section") == n).select("path", "place", F.from_json("value", t[:-1]).alias("v")) for n, t in kinds.items()}
    cats = part["categories"].select("path", "place", "v.*")
    meaning = cats.groupBy("path", "id").agg(F.min_by("name", "place").alias("name")).select("path", F.col("id").alias("category_id"), class_of(F.col("name"), classes).alias("class_id"))
    ann = part["annotations"].select("path", "v.*").join(meaning, ["path", "category_id"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(-1)))
    fields = spark.createDataFrame([], f"struct<{COCO}>").schema["annotations"].dataType.elementType.names
    return part["images"].select("v.*"), ann.select(*fields, "class_id"), cats.select("id", "name").distinct().withColumn("class_id", class_of(F.col("name"), classes))


def clean_annotations(ann: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations of at least 1 pixel that are no crowds and have a class, as corners clipped to their image; boxes
    without area go."""
    j = ann.where("area >= 1 AND coalesce(iscrowd, 0) = 0 AND class_id <> -1").join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    b = g.clipped(g.from_xywh([F.col("bbox")[i] for i in range(4)]), F.col("width").cast("double"), F.col("height").cast("double"))
    out = j.select("id", "image_id", "class_id", *g.named(b))
    return out.where(~g.degenerate(g.box()))


def kitti_boxes(lines: DataFrame, classes: Mapping[str, int] = tx.KITTI_TO_COCO) -> DataFrame:
    """KITTI lines (name, line) to boxes: at least 9 tokens, no DontCare, truncated at most 0.8, occluded at most 2, a
    known class. Columns name, type, category_id, x1..y2."""
    p = computed(lines, ["name"], {"p": F.split(F.trim("line"), r"\s+")}).where("size(p) >= 9")
    fields = {"truncated": 1, "occluded": 2, **{c: i + 4 for i, c in enumerate(CORNERS)}}
    d = computed(p, ["name"], {"type": F.col("p")[0], **{n: F.col("p")[i].try_cast("double") for n, i in fields.items()}})
    d = d.where("type <> 'DontCare' AND truncated <= 0.8 AND occluded <= 2").withColumn("category_id", tx.looked_up(F.col("type"), classes, -1))
    return d.where("category_id <> -1").select("name", "type", "category_id", *CORNERS)


def read_kitti_labels(spark: SparkSession, path: str, classes: Mapping[str, int] = tx.KITTI_TO_COCO) -> DataFrame:
    text = spark.read.text(path).select(F.substring_index(F.input_file_name(), "/", -1).alias("name"), F.col("value").alias("line"))
    return kitti_boxes(text, classes)


VOC = "size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def voc_boxes(docs: DataFrame, classes: Mapping[str, int], keys: Sequence[str]) -> DataFrame:
    """Parsed annotations (size, object) to keys, category_id, x1..y2, width, height; unknown names and boxes without area go."""
    o = docs.select(*keys, "size.width", "size.height", F.explode("object").alias("o"))
    d = o.select(*keys, "width", "height", tx.looked_up(F.lower("o.name"), {k.lower(): v for k, v in classes.items()}, -1).alias("category_id"), *[F.col(f"o.bndbox.{k}").alias(c) for k, c in zip(("xmin", "ymin", "xmax", "ymax"), CORNERS)])
    return d.where("category_id <> -1").where(~g.degenerate(g.box()))


def voc_from_text(docs: DataFrame, column: str, classes: Mapping[str, int], keys: Sequence[str]) -> DataFrame:
    return voc_boxes(docs.select(*keys, F.from_xml(column, VOC).alias("d")).select(*keys, "d.*"), classes, keys)


def read_voc(spark: SparkSession, path: str, classes: Mapping[str, int]) -> DataFrame:
    docs = spark.read.format("xml").option("rowTag", "annotation").schema(f"filename string, {VOC}").load(path)
    return voc_boxes(docs, classes, ["filename"])


def tasks(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Label-tool documents of any of three shapes ({"tasks": […]}, a list, one task) to one row a task."""
    text = F.col(column)
    wrapped = F.from_json(text, f"struct<tasks:array<{TASK}>>")["tasks"]
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{TASK}>"))
    single = F.array(F.from_json(text, TASK))
    return docs.select(F.explode(F.coalesce(listed, wrapped, single)).alias("t")).select("t.*")


def _rectangles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = rows.select(*keys, F.explode("predictions").alias("p")).select(*keys, F.explode("p.result").alias("r"))
    return r.where("r.type = 'rectanglelabels'").select(*keys, "r.*").withColumns({"label": F.get("value.rectanglelabels", F.lit(0)), **{f"v{k}": F.col(f"value.{k}") for k in ("x", "y", "width", "height")}})


def label_tasks(docs: DataFrame, images: DataFrame, column: str = "doc") -> DataFrame:
    """Predicted rectangles in whole pixels of their image's size (images: image, width, height): image, label, x1..y2, score (1.0 if missing)."""
    r = _rectangles(tasks(docs, column).withColumn("image", image_ref(F.col("data.image"))), ["image"])
    j = r.join(images, "image")
    b = g.from_percent([F.col(f"v{k}") for k in ("x", "y", "width", "height")], F.col("width"), F.col("height"))
    return j.select("image", "label", *g.named(b), F.coalesce("score", F.lit(1.0)).alias("score"))


def import_predictions(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Predicted rectangles as simple annotations in pixels, not truncated: image, ann_id, category, x, y, w, h, score (may be null)."""
    r = _rectangles(tasks(docs, column).where("predictions is not null").withColumn("image", F.col("data.image")), ["image"])
    w, h = F.col("original_width"), F.col("original_height")
    return r.select("image", F.col("id").alias("ann_id"), F.col("label").alias("category"), (F.col("vx") / 100 * w).alias("x"), (F.col("vy") / 100 * h).alias("y"), (F.col("vwidth") / 100 * w).alias("w"), (F.col("vheight") / 100 * h).alias("h"), "score")


def simple_annotations(images: DataFrame, docs: DataFrame) -> DataFrame:
    """image and its annotations (an array); an image without a document has none. docs: image, doc (a JSON list)."""
    kind = "array<struct<id:string,category:string,bbox:array<double>,score:double>>"
    return images.join(docs.select("image", F.from_json("doc", kind).alias("annotations")), "image", "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(kind)))


def image_catalog(files: DataFrame, column: str = "path") -> DataFrame:
    """Files with an image's extension, and their names."""
    return files.where(tx.allowed_file(F.col(column))).withColumn("name", F.substring_index(column, "/", -1))


def read_image_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder without their content."""
    return image_catalog(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime"))


def object_listing(objects: DataFrame, prefix: str, extensions: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Objects below the prefix with one of the extensions, and every folder above any object of the prefix."""
    own = objects.where(F.col("name").startswith(prefix))
    p = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.concat(F.array_join(F.slice(p, F.lit(1), k), "/"), F.lit("/")))
    folders = own.where(F.col("name").contains("/")).select(F.explode(above).alias("folder")).distinct()
    return own.where(F.lower("name").rlike(r"\.(" + "|".join(extensions) + ")$")), folders


def incremental_ingest(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote objects that aren't there with the same size."""
    return remote.join(local.select("name", "size"), ["name", "size"], "left_anti")


def with_results(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Tasks with at least one annotation that has a result: id, image, n_results."""
    t = tasks(docs, column).where(F.exists("annotations", lambda a: F.size(a["result"]) > 0))
    return t.select("id", F.col("data.image").alias("image"), F.aggregate("annotations", F.lit(0), lambda s, a: s + F.greatest(F.size(a["result"]), F.lit(0))).alias("n_results"))


def ocr_results(files: DataFrame) -> DataFrame:
    """One result for each page, in page order: the structured file if there is one that holds JSON, else raw text.

    files: folder, name, text, mtime. Order: "page N" in the name, else any number, else time. Columns folder, name,
    structured, position, text; a structured file whose JSON is broken is raw text itself if its page has no other."""
    page = F.regexp_extract("name", r"page_?(\d+)", 1).try_cast("int")
    number = F.regexp_extract("name", r"(\d+)", 1).try_cast("int")
    base = F.regexp_replace("name", r"(_structured)?\.(json|txt)$", "")
    f = files.withColumns({"base": base, "json": F.col("name").endswith(".json"), "o1": page, "o2": number})
    f = f.withColumn("structured", F.col("json") & F.coalesce(F.try_parse_json("text").isNotNull(), F.lit(False)))
    first = Window.partitionBy("folder", "base").orderBy(F.desc("structured"), "json", "name")
    w = Window.partitionBy("folder").orderBy(F.asc_nulls_last("o1"), F.asc_nulls_last("o2"), "mtime", "name")
    return f.withColumn("r", F.row_number().over(first)).where("r = 1").select("folder", "name", "structured", (F.row_number().over(w) - 1).alias("position"), "text")


def video_results(videos: DataFrame, folders: DataFrame) -> DataFrame:
    """The folders whose name begins with a video's base name: an equi-join on the beginnings of the folders' names."""
    starts = F.transform(F.sequence(F.lit(1), F.length("folder")), lambda n: F.substr("folder", F.lit(1), n))
    f = folders.where("folder <> ''").select("folder", F.explode(starts).alias("video"))
    v = videos.select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("video"))
    return v.join(f, "video").select("path", "folder")


CREATION_TAGS = ("creation_time", "com.apple.quicktime.creationdate", "date")
GPS_TAGS = ("location", "location-eng", "com.apple.quicktime.location.ISO6709", "gps_latitude", "gps_longitude", "gps_altitude", "gps")


def video_metadata(probes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, creation_time (first tag of the format, else of the first stream that has one, else mtime), gps (a map). probes: doc, mtime."""
    d = F.from_json("doc", "struct<format:struct<tags:map<string,string>>,streams:array<struct<tags:map<string,string>>>>")
    p = probes.select(*keys, "mtime", d.alias("d"))
    tags = F.col("d.format.tags")
    own = F.coalesce(*[F.try_element_at(tags, F.lit(t)) for t in CREATION_TAGS])
    stream = F.get(F.filter("d.streams", lambda s: F.try_element_at(s["tags"], F.lit("creation_time")).isNotNull()), F.lit(0))["tags"]
    gps = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*GPS_TAGS))
    return p.select(*keys, F.coalesce(own, F.try_element_at(stream, F.lit("creation_time")), "mtime").alias("creation_time"), gps.alias("gps"))


def latest_outputs(files: DataFrame, n: int = 5) -> DataFrame:
    """The newest n files of each kind (kind, name, mtime), with their rank."""
    w = Window.partitionBy("kind").orderBy(F.desc("mtime"), "name")
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
