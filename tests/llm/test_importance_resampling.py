"""Importance resampling against a plain version that builds every feature's text."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from boxloom.llm import importance_resampling as ir
from boxloom.llm.queries import QUERIES

from . import fixtures as fx


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets_of(text, longest=3, buckets=10_000):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent=5, least=20, buckets=10_000):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, buckets=buckets))
    for text in target:
        t.update(buckets_of(text, buckets=buckets))
    total, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets))))
    rows = []
    for doc_id, text in docs:
        own = buckets_of(text, buckets=buckets)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((i for i, (_, text) in enumerate(docs) if len(words_of(text)) >= least), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0))
    for rank, i in enumerate(fit[: percent * len(fit) // 100], 1):
        rows[i][4] = rank
    return Counter(map(tuple, rows))


def got(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZé日\x00\x01 .\n0", max_size=40), max_size=6), st.sampled_from([1, 7, 20, 10_000]))
def test_buckets(texts, block):
    found = ir.Features(block=block).of_texts([t.encode() for t in texts])
    for t, (n, body) in zip(texts, found):
        assert n == len(words_of(t))
        assert Counter(np.frombuffer(body, "<u2").tolist()) == Counter(buckets_of(t))


def test_carry_is_the_crc_of_zero_bytes():
    carry, rng = ir.Carry(), random.Random(0)
    for n in [0, 1, 2, 63, 64, 65, 1000, 70_001]:
        a, b = rng.randbytes(9), rng.randbytes(n)
        assert int(carry.over(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_long_words_and_texts_over_many_blocks():
    rng = random.Random(2)
    texts = ["x" * 5000 + " y " + "é" * 300, " ".join(rng.choice("abcdef") * rng.randint(1, 90) for _ in range(4000)), "", "one"]
    for block in (100, 5000, 1_000_000):
        found = ir.Features(block=block).of_texts([t.encode() for t in texts])
        assert [Counter(np.frombuffer(b, "<u2").tolist()) for _, b in found] == [Counter(buckets_of(t)) for t in texts]


def test_odd_rows(spark):
    data = fx.rows()
    target = [None, "", "the river and the light of a window", "Green light, GREEN window"]
    goal = spark.createDataFrame([(i, t, "k") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    assert got(ir.importance_resample(fx.table(spark, data), goal, percent=30)) == resampled(data, target, percent=30)
    assert got(ir.importance_resample(fx.table(spark, data), goal.limit(0), percent=30)) == resampled(data, [], percent=30)
    assert ir.importance_resample(fx.empty(spark), goal).count() == 0


def test_the_draw_prefers_the_target(spark):
    rng = random.Random(4)
    kinds = ("red green blue white black".split(), "run jump walk swim climb".split())
    data = [(i, " ".join(rng.choice(kinds[i % 10 == 0]) for _ in range(40))) for i in range(400)]
    goal = spark.createDataFrame([(" ".join(rng.choice(kinds[1]) for _ in range(50)),) for _ in range(20)], "text string")
    drawn = [r["doc_id"] for r in ir.importance_resample(fx.table(spark, data), goal, percent=5).where("rank is not null").collect()]
    assert len(drawn) == 20 and all(d % 10 == 0 for d in drawn)


def test_query(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{fx.SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{fx.SF}/benchmark.parquet").collect()]
    assert got(QUERIES["op12_importance_resampling"](spark, fx.SF)) == resampled(data, target)
