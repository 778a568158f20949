"""Greedy folds on arrays."""

import pyarrow as pa
import pytest

from boxloom.operators import folds, fusion


def test_groups_stay_whole_across_batches(monkeypatch):
    monkeypatch.setattr(folds, "ROWS", 4)
    keys = [1, 1, 2, 2, 2, 2, 2, 2, 2, None, None, 3]
    batches = pa.table({"k": keys, "v": list(range(len(keys)))}).to_batches(max_chunksize=3)
    tables = [(t["k"].to_pylist(), s.tolist()) for t, s in folds.whole_groups(iter(batches), ["k"])]
    assert sum((k for k, _ in tables), []) == keys
    groups = [set(k[i:j]) for k, s in tables for i, j in zip(s, [*s[1:], len(k)])]
    assert groups == [{1}, {2}, {None}, {3}]


@pytest.mark.parametrize("fold", [fusion.nms, fusion.weighted_box_fusion, fusion.merge_nearby_boxes])
def test_no_fold_is_interpreted_row_by_row(spark, fold):
    """Folds as higher-order functions took most of a query's time; images of any size take array steps."""
    d = spark.sql("select id as det_id, id div 300 as image_id, 0 as category_id, 'a' as label, 0.5d + id / 1e4 as score, double(id % 300) * 7 as x1, 0d as y1, double(id % 300) * 7 + 40 as x2, 40d as y2 from range(900)")
    out = fold(d)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.groupBy("image_id").count().count() == 3
