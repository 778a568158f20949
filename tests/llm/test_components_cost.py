"""What connected components leave in the shared folder, and how many tasks a small table takes."""

import random
from pathlib import Path

import numpy as np

from boxloom.llm.components import connected_components, stars
from boxloom.tables import shared_dir


def brute(edges):
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = sorted((root[a], root[b]))
        root = {x: a if r == b else r for x, r in root.items()}
    return root


def drawn(seed, n, m):
    rng = random.Random(seed)
    return [e for e in ((rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)) if e[0] != e[1]]


def test_stars_reach_the_smallest_node():
    for seed in range(5):
        edges = drawn(seed, 60, 70)
        node, centre = stars(np.array([max(e) for e in edges]), np.array([min(e) for e in edges]))
        assert dict(zip(node.tolist(), centre.tolist())) == {x: r for x, r in brute(edges).items() if x != r}


def test_a_small_table_takes_few_tasks_and_leaves_one_table(spark):
    edges = [(i, i + 1) for i in range(40)] + drawn(1, 300, 250)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    files = lambda: {p for p in folder.rglob("part-*") if p.is_file()}
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    status, sc, before = spark.sparkContext.statusTracker(), spark.sparkContext, files()
    for k, v in conf.items():
        spark.conf.set(k, v)
    sc.setJobGroup("components", "components")
    try:
        out = connected_components(spark.createDataFrame(edges, "a long, b long"))
        left = files() - before
        stages = {s for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r["node"]: r["component"] for r in out.collect()} == brute(edges)
    assert len({p.parent for p in left}) == 1
    assert 0 < tasks < 1500
