"""The COCO evaluation against a plain version of the protocol."""

import random
from collections import defaultdict

import pytest

from boxloom.operators import metrics as me


def iou(a, b, crowd):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    own, other = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    return inter / (own if crowd else own + other - inter)


def brute(dets, gts, th, lo, hi, most, category):
    """AP and recall of one category and setting, image by image; None without ground truth that counts."""
    rows, n = [], 0
    for image in {x[1] for x in dets + gts}:
        d = sorted((x for x in dets if x[1:3] == (image, category)), key=lambda x: (-x[3], x[0]))[:100]
        t = sorted(x for x in gts if x[1:3] == (image, category))
        out = [bool(x[7]) or not lo <= x[8] <= hi for x in t]
        n += out.count(False)
        taken = set()
        for rank, x in enumerate(d, 1):
            best = None
            for i, g in enumerate(t):
                v = iou(x[4:8], g[3:7], g[7])
                if v >= th and (i not in taken or g[7]) and (best is None or (not out[i], v) >= best[:2]):
                    best = (not out[i], v, i)
            area = (x[6] - x[4]) * (x[7] - x[5])
            if best:
                taken.add(best[2])
            ignored = not best[0] if best else not lo <= area <= hi
            if rank <= most and not ignored:
                rows.append((-x[3], x[0], best is not None))
    if not n:
        return None
    hits, curve = 0, []
    for k, (_, _, tp) in enumerate(sorted(rows), 1):
        hits += tp
        curve.append((hits / n, hits / k))
    return sum(max((p for r, p in curve if r >= i / 100), default=0.0) for i in range(101)) / 101, max((r for r, _ in curve), default=0.0)


def test_coco(spark):
    rng = random.Random(4)
    gts, dets = [], []
    for i in range(60):
        x, y, w, h = rng.uniform(0, 200), rng.uniform(0, 200), rng.choice([12, 30, 60, 150]), rng.choice([12, 30, 60, 150])
        key = (rng.randrange(4), rng.randrange(2))
        gts.append((i, *key, x, y, x + w, y + h, int(rng.random() < 0.15), w * h * 0.9))
        for _ in range(rng.randrange(3)):
            j = lambda s: rng.uniform(-0.15, 0.15) * s
            dets.append((len(dets), *key, round(rng.random(), 1), x + j(w), y + j(h), x + w + j(w), y + h + j(h)))
    dets += [(900 + i, i % 5, 2, 0.5, 0.0, 0.0, 20.0, 20.0) for i in range(3)]  # a category without ground truth
    d = spark.createDataFrame(dets, "det_id long, image_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame(gts, "gt_id long, image_id long, category_id int, x1 double, y1 double, x2 double, y2 double, iscrowd int, area double")
    every = me.coco_evaluation(d, g)
    got = {(r["area"], r["max_dets"], r["iou_threshold"], r["category_id"]): (r["ap"], r["ar"]) for r in every.collect()}
    want = {}
    for name, (lo, hi) in me.COCO_AREAS.items():
        for most in me.COCO_MAX:
            for th in me.COCO_IOU:
                for c in (0, 1, 2):
                    if v := brute(dets, gts, th, lo, hi, most, c):
                        want[name, most, th, c] = v
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    figures = {r["metric"]: r["value"] for r in me.coco_summary(every).collect()}
    sums = defaultdict(list)
    for (name, most, th, _), (ap, ar) in want.items():
        if name == "all" and most == 100:
            sums["AP"].append(ap)
            sums["AR100"].append(ar)
    assert len(figures) == 12 and all(figures[k] == pytest.approx(sum(v) / len(v)) for k, v in sums.items())
    assert me.coco_evaluation(d, g.limit(0)).count() == 0


def test_evaluation_keeps_a_row_a_detection(spark, monkeypatch):
    """All settings share one sorted row a detection."""
    gt = spark.sql("select id as gt_id, id div 4 as image_id, int(id % 2) as category_id, 0d x1, 0d y1, 10d x2, 10d y2 from range(40)")
    det = gt.selectExpr("gt_id as det_id", "image_id", "category_id", "0.5d as score", "x1", "y1", "x2", "y2")
    sorted_rows = []
    real = me.in_ranges
    monkeypatch.setattr(me, "in_ranges", lambda df, *a: sorted_rows.append(df.count()) or real(df, *a))
    assert me.coco_evaluation(det, gt).count() > 0
    assert sorted_rows == [40]
