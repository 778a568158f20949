"""Near copies (five words, similarity 0.8) against brute force."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxloom.llm import near_copies as nc

from . import fixtures as fx


def shingle_set(text):
    w = fx.words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if root[a] != root[b] and (not union or Fraction(len(sets[a] & sets[b]), union) >= Fraction(4, 5)):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return root


def near_copies(seed=0, families=5, n=25):
    """Families of texts with 0 to 3 edited words of 120, so that similarities lie on both sides of 0.8, and a passage in all."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(families):
        base = [word() for _ in range(90)]
        for _ in range(n):
            own = base[:]
            for _ in range(rng.choice([0, 1, 2, 4, 5])):
                own[rng.randrange(90)] = word()
            out.append(" ".join(own + passage))
    return out


@pytest.mark.parametrize("rounds", [0, 4])
def test_groups(spark, rounds):
    texts = near_copies() + ["", None, " \n", "one two", "One  two", "one three"]
    rows = spark.createDataFrame(list(zip(range(len(texts)), range(len(texts)), texts)), "key long, id long, text string")
    got = {r["key"]: r["component"] for r in nc.near_copy_groups(rows, rounds=rounds).collect()}
    root = brute_groups(texts)
    assert len(got) == len(texts) and len(set(root)) > 10
    assert {(a, b) for a in got for b in got if got[a] == got[b]} == {(a, b) for a in got for b in got if root[a] == root[b]}


def test_sketches_never_differ_more_than_the_sets():
    texts = near_copies(3, 2, 20)
    sets = [nc.shingles(t) for t in texts]
    bits = [nc.sketch(s) for s in sets]
    for a in range(len(texts)):
        for b in range(a):
            apart = sum(int(x).bit_count() for x in (bits[a] ^ bits[b]).view("uint64"))
            assert apart <= len(set(sets[a].tolist()) ^ set(sets[b].tolist()))


def test_stage_keeps_one_of_near_copies(spark):
    texts = near_copies(1, 3, 8)
    docs = fx.table(spark, list(enumerate(texts)))
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, fx.SF).collect()}
    least = {}
    for i, r in enumerate(brute_groups(texts)):
        least.setdefault(r, i)
    assert got == set(least.values()) and len(got) < len(texts)
    assert corpus_pipeline.near_dedup_stage(spark, docs.where(F.lit(False)), fx.SF).count() == 0


def test_stage_treats_null_and_shared_ids_like_others(spark):
    a, b = near_copies(2, 2, 1)
    near = a.rsplit(" ", 1)[0] + " end"
    data = [(3, a), (None, a), (None, near), (None, "only without ids"), (None, "only without ids"), (4, b), (4, near), (4, b), (9, None)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, fx.table(spark, data), fx.SF).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (None, "only without ids"), (4, b), (9, None)], key=str)
