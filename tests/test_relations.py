"""Relations of boxes on a grid against all pairs."""

import math
import random

import pytest

from boxloom.operators import matching as mt

KIND = "image_id long, det_id long, label string, x1 double, y1 double, x2 double, y2 double"


def boxes(n, side, seed, image=1, big=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, h = (rng.uniform(300, 900), rng.uniform(300, 900)) if i < big else (rng.choice([0, 5, 20, 40]), rng.uniform(0, 40))
        x, y = rng.uniform(-50, side), rng.uniform(-50, side)
        out.append((image, i, rng.choice(["Car", "TREE", None]), x, y, x + w, y + h))
    return out + [(image, n + i, "Same", *out[i][3:]) for i in range(min(n, 5))]


def brute(rows, within, min_iou):
    out = set()
    for a in rows:
        for b in rows:
            if a[0] != b[0] or a[3:] == b[3:] or None in a[3:] or None in b[3:]:
                continue
            ix, iy = max(0.0, min(a[5], b[5]) - max(a[3], b[3])), max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
            union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - ix * iy
            gap = math.hypot(max(b[3] - a[5], a[3] - b[5], 0.0), max(b[4] - a[6], a[4] - b[6], 0.0))
            if (union > 0 and ix * iy / union > min_iou) or gap < within:
                out.add((a[0], a[1], b[1], None if b[2] is None else b[2].lower()))
    return out


@pytest.mark.parametrize(("dense", "within"), [(10, 50.0), (10, 3.0), (10, 0.0), (10_000, 50.0)])
def test_same_edges(spark, dense, within):
    rows = boxes(150, 500, 1, 1) + boxes(120, 900, 2, 2, big=12) + boxes(4, 60, 3, 3) + [(1, 900, "Null", None, 1.0, 2.0, 3.0)]
    got = mt.spatial_relations(spark.createDataFrame(rows, KIND), within=within, dense=dense).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, within, 0.1)


def test_comparisons_are_near_linear(spark):
    """10,000 boxes of one image, 10^8 pairs: the join makes a few rows a box."""
    rows = [(1, i, "a", float(x), float(y), x + 20.0, y + 20.0) for i, (x, y) in enumerate((x, y) for x in range(0, 10_000, 100) for y in range(0, 10_000, 100))]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    edges = mt.spatial_relations(df, within=10.0)
    assert edges.count() == 0
    far = mt.spatial_relations(df, within=81.0)  # the four neighbours
    assert len(far.collect()) == 4 * 100 * 99
    kept = far._jdf.queryExecution().executedPlan()
    joins = [n for n in (plan_nodes(kept)) if "Join" in n.nodeName()]
    made = sum(n.metrics().apply("numOutputRows").value() for n in joins)
    assert 4 * 100 * 99 <= made < 40 * 10_000


def plan_nodes(node):
    """All nodes of a physical plan, also of its finished stages."""
    if node.nodeName() == "AdaptiveSparkPlan":
        yield from plan_nodes(node.executedPlan())
        return
    yield node
    if "QueryStage" in node.nodeName():
        yield from plan_nodes(node.plan())
    kids = node.children()
    for i in range(kids.size()):
        yield from plan_nodes(kids.apply(i))
