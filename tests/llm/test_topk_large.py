"""Vectors whose inner products are too large to be exact are refused; those just below are exact."""

import pytest
from pyspark.sql import functions as F

from boxloom.llm import topk

KIND = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("huge", [1e300, -1e300, 2.0**40, 9.3e18])
def test_refused(spark, huge):
    df = spark.createDataFrame([(0, [huge, 1.0]), (1, [1.0, 0.0])], KIND)
    with pytest.raises(ValueError, match="inner products"):
        topk.top_k(df, F.col("vec_id") == 0)


def test_exact_below(spark):
    top = 2.0**17  # times 256, squared and doubled: 2^51
    df = spark.createDataFrame([(0, [top, top]), (1, [top, top - 1 / 256]), (2, [top, top]), (3, [-top, top]), (4, None), (5, [float("inf"), 1.0])], KIND)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    a = int(top * 256)
    assert got == [(0, 1, 2, 2 * a * a), (0, 2, 1, 2 * a * a - a), (0, 3, 3, 0)]
