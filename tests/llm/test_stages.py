"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from boxloom.llm.secret_scan import base_spans

from . import fixtures as fx
from .test_dedup import brute_lines
from .test_near_copies import brute_groups


@pytest.fixture(scope="module")
def outputs(spark):
    docs = fx.table(spark)
    return {name: stage(spark, docs, fx.SF).collect() for name, stage in cp.STAGES}


def texts(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_columns_stay_and_empty_tables_give_empty_results(spark, outputs):
    docs = fx.table(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, fx.empty(spark), fx.SF)
        assert out.count() == 0, name
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert all((r["key"], r["fp"], r["score"], r["__key"]) == ("k", "f", "s", "z") for r in outputs[name]), name


def test_quality_keeps_rows_whole(outputs):
    assert texts(outputs["quality classifier"]) <= Counter(fx.rows())


def test_lines(outputs):
    assert texts(outputs["line dedup"]) == brute_lines(fx.rows(), 4, 3, 0.5, False)


def test_near_copies(outputs):
    """One of each group, the smallest id; rows that repeat id and text are one document."""
    data = sorted(set(fx.rows()), key=lambda r: (r[0] is None, r[0] or 0))
    root, got = brute_groups([t for _, t in data]), texts(outputs["simhash near-dedup"])
    of = dict(zip(data, root))
    assert all(n == 1 for n in got.values()) and len(got) == len(set(root)) and len({of[x] for x in got}) == len(got)
    least = {}
    for x in data:
        least.setdefault(of[x], x[0])
    assert all(x[0] == least[of[x]] for x in got)


def test_secrets(outputs):
    rows, got = fx.rows(), outputs["secret scan"]
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert sum("[SECRET]" in (r["text"] or "") for r in got) == sum(bool(base_spans(t or "")) for _, t in rows)
    assert {r["text"] is None for r in got if r["doc_id"] == 201} == {True}


def test_packing(outputs):
    got = outputs["best-fit packing"]
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in fx.rows())
