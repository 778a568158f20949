"""Large COCO documents block by block, against the json module."""

import json
import random

import pytest

from boxloom.sources import readers
from boxloom.sources.coco_blocks import read_sections

SECTIONS = ["images", "annotations", "categories"]


@pytest.fixture
def small_blocks(spark):
    """Blocks of some hundred bytes."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield size
    for k, v in keep.items():
        spark.conf.set(k, v)


def document(seed, n=25):
    rng = random.Random(seed)
    odd = ['}', '{"a":[', '\\', '\\"', '"]}', "é\n", "plain", '"annotations": [']
    images = [{"id": i, "width": 640, "height": 480, "file_name": rng.choice(odd) + f"{i}.jpg"} for i in range(9)]
    ann = []
    for i in range(n):
        a = {"id": i, "image_id": rng.randrange(9), "category_id": rng.randrange(4), "bbox": [1.5 * i, 2.0, 30.0, 4.0], "area": 120.0, "iscrowd": 0}
        if i % 5 == 0:
            a["segmentation"] = {"counts": rng.choice(odd) * rng.randint(1, 300), "size": [480, 640], "deep": [{"x": {}}, [], [{}]]}
        ann.append(dict(rng.sample(list(a.items()), len(a))))
    cats = [{"id": 0, "name": "Car"}, {"id": 1, "name": "person"}, {"id": 2, "name": rng.choice(odd)}, {"id": 0, "name": "later"}]
    parts = {"info": {"annotations": [1, {"id": 5}], "note": "}"}, "licenses": [], "images": images, "annotations": ann, "categories": cats}
    return dict(rng.sample(list(parts.items()), len(parts)))


@pytest.mark.parametrize("size", [150, 3000, 10_000_000])
def test_elements(spark, tmp_path, small_blocks, size):
    docs = {}
    for k in range(3):
        docs[f"d{k}.json"] = d = document(k)
        (tmp_path / f"d{k}.json").write_text(json.dumps(d, indent=[None, 1, 4][k], ensure_ascii=k == 1) + "\n" * k)
    small_blocks(size)
    rows = read_sections(spark, str(tmp_path), SECTIONS)
    if size == 150:
        assert rows.rdd.getNumPartitions() > 20
    got = {}
    for r in sorted(rows.collect(), key=lambda r: r["place"]):
        got.setdefault((r["path"].split("/")[-1], r["section"]), []).append(json.loads(r["value"]))
    assert got == {(name, s): d[s] for name, d in docs.items() for s in SECTIONS}


def test_tables_are_those_of_whole_documents(spark, tmp_path, small_blocks):
    for k in range(3):
        (tmp_path / f"d{k}.json").write_text(json.dumps(document(k)))
    classes = {"car": 2, "Person": 0}
    whole = readers.coco_tables(spark.read.schema(readers.COCO).json(str(tmp_path), multiLine=True), classes)
    small_blocks(1000)
    parts = readers.read_coco(spark, str(tmp_path), classes)
    for a, b in zip(whole, parts):
        assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    # annotations don't carry the categories
    assert "categories" not in whole[1]._jdf.queryExecution().optimizedPlan().output().mkString(",")


def test_odd_documents(spark, tmp_path, small_blocks):
    small_blocks(100)
    for name, text in {"a": "{}", "b": "", "c": '{"annotations": [], "images": [ ] }', "d": ' {"annotations" : [{"id": 3}]}\n\n', "e": '{"annotations": [{"id": "' + "x}" * 400 + '"}]}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = read_sections(spark, str(tmp_path), SECTIONS).collect()
    assert sorted(json.loads(r["value"])["id"] if r["path"].endswith("d.json") else len(r["value"]) for r in rows) == [3, len('{"id": "' + "x}" * 400 + '"}')]
