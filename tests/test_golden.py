"""Hand-made cases: parsers on canned answers, boundaries, properties, files."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.functions import taxonomy as tx
from boxloom.functions.text import elapsed, human_size, image_ref, stem
from boxloom.operators import fusion, matching, metrics, responses
from boxloom.sources import readers


def answers(spark, *texts):
    return spark.createDataFrame([(i, t, 800, 600) for i, t in enumerate(texts)], "image_id long, response string, width int, height int")


def test_bulleted(spark):
    text = "Objects:\n- **Person 1:**\n  - **Bounding Box:** (100, 150, 200, 400)\n  - **Description:** A tall person\n- **Car:**\n  - **Bounding Box:** (300, 200, 500, 350)\n  - **Description:** A red car"
    rows = responses.parse_bulleted(answers(spark, text)).orderBy("pos").collect()
    assert [(r["name"], r["description"], r["x1"], r["y2"]) for r in rows] == [("Person 1", "A tall person", 100, 400), ("Car", "A red car", 300, 350)]


def test_structured_rules(spark):
    text = "RESULT_START\ncar: (10,20,110,120) 0.9 red\ncar: (10,20,110,120) 0.5 again\nSUV: (10, 30, 90, 120)\nbad line\ntree: (0,0,800,600) 0.9 too large\nTree: (5,5,60,90) .7.\nRESULT_END"
    rows = responses.parse_structured(answers(spark, text)).orderBy("line_no").collect()
    assert [(r["label"], r["confidence"], r["description"]) for r in rows] == [("Car", 0.9, "red"), ("Car", 0.8, "Detected suv")]


def test_markers_out_of_order(spark):
    assert answers(spark, "RESULT_END a RESULT_START b").select(responses.result_block(F.col("response"))).first()[0] is None


def test_cascade_prefers_structured(spark):
    out = responses.parse_cascade(answers(spark, "RESULT_START\nNo objects detected\nRESULT_END", "1. **Bus**\n**Bounding Box:** (10, 10, 200, 200)\nDescription: red\n\nmore", "A **van** is at (20, 20, 90, 90)", "nothing here"))
    assert {(r["image_id"], r["label"], r["strategy"]) for r in out.collect()} == {(1, "Bus", "numbered"), (2, "Truck", "general")}


def test_verbose(spark):
    rows = answers(spark, "However, it is too blurry", "However, see (1, 2, 3, 4)", "There are no cars: no objects detected").select(responses.is_verbose(F.col("response"))).collect()
    assert [r[0] for r in rows] == [True, False, False]


def test_free_labels(spark):
    labels = [" PERSON ", "Fire Truck", "pickup", "signal", "", "construction worker"]
    got = spark.createDataFrame([(x,) for x in labels], "l string").select(tx.free_label(F.col("l"))).collect()
    assert [r[0] for r in got] == ["Pedestrian", "Fire truck", "Truck", "Street sign", "Other", "Worker"]


def test_coco_ids():
    assert len(tx.COCO_IDS) == 80 and (tx.COCO_IDS[0], tx.COCO_IDS[11], tx.COCO_IDS[77], tx.COCO_IDS[79]) == (1, 13, 88, 90)


def test_texts(spark):
    row = spark.range(1).select(
        human_size(F.lit(0)), human_size(F.lit(1536)), elapsed(F.lit(3661.5)), elapsed(F.lit(61.25), hours=False), stem(F.lit("/a/b.c.jpg")), image_ref(F.lit("/data/local-files/?d=x/blurred/blurred/y.png"))
    ).first()
    assert tuple(row) == ("0.00 B", "1.50 KB", "1:01:01.500", "01:01.250", "b.c", "x/blurred/y.png")


def det(spark, rows):
    return spark.createDataFrame([Row(image_id=r[0], det_id=r[1], category_id=r[2], score=float(r[3]), label="car", description=None, x1=float(r[4]), y1=float(r[5]), x2=float(r[6]), y2=float(r[7])) for r in rows], "image_id long, det_id long, category_id int, score double, label string, description string, x1 double, y1 double, x2 double, y2 double")


def test_nms_boundary_and_ties(spark):
    # boxes 1 and 2 overlap by exactly one half: not more than the threshold, so both stay; 3 equals 1 and goes
    d = det(spark, [(1, 1, 0, 0.9, 0, 0, 30, 10), (1, 2, 0, 0.9, 10, 0, 40, 10), (1, 3, 0, 0.9, 0, 0, 30, 10), (1, 4, 1, 0.1, 0, 0, 30, 10)])
    assert {r["det_id"] for r in fusion.nms(d).collect()} == {1, 2, 4}
    assert fusion.nms(d.limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 40), st.integers(1, 40), st.integers(0, 9)), min_size=1, max_size=25))
def test_nms_properties(spark, boxes):
    rows = [(1, i, 0, s / 10, x, y, x + w, y + h) for i, (x, y, w, h, s) in enumerate(boxes)]
    kept = [r["det_id"] for r in fusion.nms(det(spark, rows)).collect()]

    def iou(a, b):
        i = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
        return i / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - i)

    want: list[int] = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all(iou(rows[k], r) <= 0.5 for k in want):
            want.append(r[1])
    assert sorted(kept) == sorted(want)


def test_match_counts_add_up(spark):
    d = det(spark, [(1, 1, 0, 0.9, 0, 0, 10, 10), (1, 2, 0, 0.8, 1, 0, 11, 10), (1, 3, 0, 0.7, 50, 50, 60, 60), (2, 4, 1, 0.5, 0, 0, 5, 5)])
    gt = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, 2.0, 0.0, 12.0, 10.0), (3, 3, 2, 0.0, 0.0, 9.0, 9.0)], "gt_id long, image_id long, category_id int, x1 double, y1 double, x2 double, y2 double")
    m = matching.match_ground_truth(d, gt)
    assert {(r["det_id"], r["gt_id"]) for r in m.collect()} == {(1, 1), (2, 2)}
    o = metrics.overall_metrics(d, gt, m).first()
    assert (o["tp"], o["fp"], o["fn"]) == (2, 2, 1) and o["tp"] + o["fn"] == gt.count()
    ap = {r["category_id"]: r["ap"] for r in metrics.interpolated_ap(metrics.pr_curve(d, gt, m), gt, d).collect()}
    assert abs(ap[0] - 1.0) < 1e-12 and ap[1] == ap[2] == 0.0


def test_geometry_edges(spark):
    b = [F.lit(float(x)) for x in (0, 0, 0, 0)]
    r = spark.range(1).select(g.iou(b, b), g.overlap_ratio(b, b), g.valid([F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(9.0)], F.lit(100), F.lit(100)), g.guessed_format([F.lit(5.0), F.lit(5.0), F.lit(4.0), F.lit(9.0)])).first()
    assert tuple(r) == (0.0, 0.0, False, "xywh")


def test_files(spark, tmp_path):
    doc = {"images": [{"id": 1, "width": 100, "height": 80, "file_name": "a.jpg"}], "annotations": [{"id": 7, "image_id": 1, "category_id": 3, "bbox": [-5, 2, 20, 30], "area": 600, "iscrowd": 0}, {"id": 8, "image_id": 1, "category_id": 9, "bbox": [1, 1, 2, 2], "area": 4, "iscrowd": 0}], "categories": [{"id": 3, "name": "CAR"}, {"id": 9, "name": "yak"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    images, ann, _ = readers.read_coco(spark, str(tmp_path / "c.json"), {"car": 2})
    assert [tuple(r) for r in readers.clean_annotations(ann, images).collect()] == [(7, 1, 2, 0.0, 2.0, 15.0, 32.0)]

    (tmp_path / "k").mkdir()
    (tmp_path / "k/000001.txt").write_text("Car 0.0 0 0.0 1 2 30 40 1 1 1 0 0 0 0\nCar 0.9 0 0.0 1 2 30 40 1 1 1 0 0 0 0\nDontCare 0 0 0 1 2 3 4 5\nVan 0 3 0 1 2 3 4 5\nshort line\n")
    assert [tuple(r) for r in readers.read_kitti_labels(spark, str(tmp_path / "k")).collect()] == [("000001.txt", "Car", 2, 1.0, 2.0, 30.0, 40.0)]

    (tmp_path / "v.xml").write_text("<annotation><filename>a.jpg</filename><size><width>9</width><height>9</height></size><object><name>Dog</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>gnu</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    got = readers.read_voc(spark, str(tmp_path / "v.xml"), {"dog": 16}).select("filename", "category_id", "x1", "y2").collect()
    assert [tuple(r) for r in got] == [("a.jpg", 16, 1.0, 4.0)]

    for n in ("p/a.PNG", "p/q/b.txt", "p/q/c.gif"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    assert {r["name"] for r in readers.read_image_catalog(spark, str(tmp_path / "p")).collect()} == {"a.PNG", "c.gif"}
