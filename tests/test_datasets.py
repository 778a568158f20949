"""Weighted draws against the rule: a data set by weight, then one of its rows, with replacement."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxloom.operators import datasets as ds


@pytest.fixture(scope="module")
def two(spark):
    """1,000 rows and 10."""
    rows = [(f"0_{i:04}", 0, i) for i in range(1000)] + [(f"1_{i:04}", 1, i) for i in range(10)]
    return spark.createDataFrame(rows, "unique_id string, dataset int, value long").repartition(5)


def part(text):
    return int(hashlib.md5(f"{text}:0".encode()).hexdigest()[:13], 16) / 16**13


def test_shares_follow_the_weights_and_not_the_sizes(spark, two):
    got = ds.weighted_sample(two, {0: 1.0, 1: 1.0}, 4000).collect()
    n = Counter(r["dataset"] for r in got)
    assert sorted(r["draw"] for r in got) == list(range(4000)) and abs(n[0] - 2000) < 150
    of = Counter(r["unique_id"] for r in got)
    assert all(abs(of[f"1_{i:04}"] - 200) < 60 for i in range(10))  # with replacement, all rows alike
    assert 750 < sum(k.startswith("0_") for k in of) < 950  # 1 - 1/e^2 of 1,000


def test_draws_are_the_rule(spark, two):
    got = {r["draw"]: r["unique_id"] for r in ds.weighted_sample(two, {1: 3.0, 0: 1.0}, 500).collect()}
    want = {}
    for i in range(500):
        own, n = (1, 10) if part(i) <= 0.75 else (0, 1000)
        want[i] = f"{own}_{int(part(f'{i}:row') * n):04}"
    assert got == want


def test_weights_that_are_odd(spark, two):
    assert {r["dataset"] for r in ds.weighted_sample(two, {0: 0.0, 1: 2.0, 7: 0.0}, 50).collect()} == {1}
    assert {r["dataset"] for r in ds.weighted_sample(two, {0: 0.9, 1: 0.1}, 300).groupBy("dataset").count().where("count > 200").collect()} == {0}  # more draws than a rate could give
    assert ds.weighted_sample(two, {0: 1.0}, 0).count() == 0
    with pytest.raises(ValueError):
        ds.weighted_sample(two, {0: 1.0, 5: 1.0}, 10)
    with pytest.raises(ValueError):
        ds.weighted_sample(two, {0: -1.0, 1: 3.0}, 10)


def test_rows_that_repeat_are_rows(spark):
    rows = spark.createDataFrame([("a", 0)] * 3 + [("b", 0)], "unique_id string, dataset int")
    n = Counter(r["unique_id"] for r in ds.weighted_sample(rows, {0: 1}, 1000).collect())
    assert abs(n["a"] - 750) < 60 and n["a"] + n["b"] == 1000


def test_share_has_enough_digits(spark):
    row = spark.range(1).select(ds.share(F.lit("x"), 0, 13).alias("s")).first()
    assert row["s"] == part("x")
