"""Scans by ranges against plain ones, and their tasks on one large group."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import metrics as me
from boxloom.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    """One class holds half of the rows; scores tie."""
    rng = random.Random(3)
    data = [(i, 0 if i % 2 else rng.choice([1, 2, 3, None]), rng.randint(0, 20) / 20, rng.randint(0, 1), rng.choice([None, rng.random()])) for i in range(4000)]
    return data, spark.createDataFrame(data, "det_id long, category_id int, score double, tp int, value double")


def ordered(data):
    out = {}
    for r in sorted(data, key=lambda r: (-r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_running_and_best(spark, rows):
    data, df = rows
    ranged = scans.in_ranges(df, ["category_id"], [F.desc("score"), "det_id"])
    got = scans.best_from_here(scans.running(ranged, ["category_id"], {"hits": F.col("tp"), "rank": F.lit(1)}), ["category_id"], "best", F.col("value"))
    got = {r["det_id"]: (r["hits"], r["rank"], r["best"]) for r in scans.unranged(got).collect()}
    want = {}
    for own in ordered(data).values():
        hits = 0
        for k, r in enumerate(own):
            hits += r[3]
            later = [x[4] for x in own[k:] if x[4] is not None]
            want[r[0]] = (hits, k + 1, max(later, default=None))
    assert got == want


def test_tasks_are_bounded_and_no_window_takes_a_category(spark, rows):
    _, df = rows
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ranged = scans.in_ranges(df, ["category_id"], [F.desc("score"), "det_id"])
        sizes = [r["count"] for r in ranged.groupBy(scans.RANGE).count().collect()]
        assert len(sizes) > 12 and max(sizes) < 3 * 4000 / 16
        plan = scans.running(ranged, ["category_id"], {"rank": F.lit(1)})._jdf.queryExecution().optimizedPlan().toString()
        over = [line for line in plan.splitlines() if "Window [" in line]
        assert len(over) == 2 and sum(scans.RANGE in line.split("windowspecdefinition")[1].split(" ASC")[0] for line in over) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_curve_of_one_large_class(spark, rows):
    data, df = rows
    det = df.where("category_id is not null")
    gt = det.where("det_id % 3 = 0").select(F.col("det_id").alias("gt_id"), "category_id")
    matches = det.where("tp = 1").select("det_id", F.col("det_id").alias("gt_id"))
    curve = me.precision_envelope(me.pr_curve(det.drop("tp"), gt, matches)).collect()
    n = {c: sum(1 for r in data if r[1] == c and r[0] % 3 == 0) for c in range(4)}
    want = {}
    for c, own in ordered(data).items():
        if c is None:
            continue
        precision, hits = [], 0
        for k, r in enumerate(own, 1):
            hits += r[3]
            precision.append((r[0], hits, k, hits / k, hits / n[c]))
        for k, p in enumerate(precision):
            want[p[0]] = (*p[1:], max(x[3] for x in precision[k:]))
    assert {r["det_id"]: (r["ctp"], r["rank"], r["precision"], r["recall"], r["envelope"]) for r in curve} == want


def test_empty(spark, rows):
    ranged = scans.in_ranges(rows[1].limit(0), ["category_id"], ["det_id"])
    assert scans.running(ranged, ["category_id"], {"rank": F.lit(1)}).count() == 0


@pytest.mark.parametrize(("n", "parts"), [(1, 16), (5, 16), (29, 7)])
def test_windows_with_a_halo_see_what_whole_groups_see(spark, n, parts):
    """One camera has most frames; small ones fit a range, and some ranges hold fewer rows than the halo."""
    from boxloom.operators import frames as fr

    rng = random.Random(n)
    rows = [(1, 3 * i, rng.random(), [rng.randrange(9), i % 50]) for i in range(400)] + [(v, i, rng.random(), [i, v]) for v in (2, 3) for i in range(n + 2)] + [(4, 0, 1.0, [0, 0])]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, infer_ms double, gray array<long>").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r["video_id"], r["frame_idx"]): (r["avg_ms"], r["min_ms"], r["max_ms"]) for r in fr.rolling_latency(df, n + 1).collect()}
        diff = {(r["video_id"], r["frame_idx"]): r["diff"] for r in fr.endless_diff(df).collect()}
        ranged = scans.in_ranges(df, ["video_id"], ["frame_idx"])
        assert ranged.where("video_id = 1").select(scans.RANGE).distinct().count() > parts // 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, last = {}, {}
    for v, i, ms, _ in sorted(rows):
        own = last.setdefault(v, [])
        own.append(ms)
        w = own[-n - 1 :]
        want[v, i] = (sum(w) / len(w), min(w), max(w))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert diff == {(r["video_id"], r["frame_idx"]): r["diff"] for r in fr.with_diff(df).collect()}
    assert fr.rolling_latency(df, 1).where("avg_ms <> min_ms").count() == 0
