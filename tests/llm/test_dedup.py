"""Exact dedup, SimHash, components and line templates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from boxloom.llm import exact_dedup as ed
from boxloom.llm import line_templates as lt
from boxloom.llm import simhash as sh
from boxloom.llm.components import connected_components

from . import fixtures as fx


def test_exact(spark):
    data = fx.rows()
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    ids = defaultdict(list)
    for i, t in data:
        ids[body(t)].append(i)
    want = Counter()
    for i, t in data:
        own = ids[body(t)]
        keep = min((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, hashlib.sha256(body(t).encode()).hexdigest()] += 1
    got = ed.exact_dedup(fx.table(spark))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert ed.exact_dedup(fx.empty(spark)).count() == 0


def test_exact_with_colliding_digests(spark, monkeypatch):
    """With a digest of one bit, texts are still told apart by their content."""
    monkeypatch.setattr(ed.F, "sha2", lambda c, n: (F.length(c) % 2).cast("string"))
    got = ed.exact_dedup(fx.table(spark)).collect()
    sizes = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in fx.rows())
    assert sorted(r["group_size"] for r in got) == sorted(n for t, n in sizes.items() for _ in range(n))


def brute_fp(text):
    w = fx.words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    n = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def groups(fps, distance):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                parent[find(a)] = find(b)
    return [find(a) for a in range(len(fps))]


def test_simhash(spark):
    data = fx.rows()
    fps = [brute_fp(t) for _, t in data]
    root = groups(fps, 2)
    least = defaultdict(list)
    for (i, _), r in zip(data, root):
        least[r].append(i)
    want = Counter((i, format(fp, "016x"), min((x for x in least[r] if x is not None), default=None)) for (i, _), fp, r in zip(data, fps, root))
    assert Counter(map(tuple, sh.simhash_query(fx.table(spark)).collect())) == want
    assert sh.simhash_query(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("dense", [2, 64])
def test_links_of_dense_and_sparse_groups(spark, distance, dense):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ ((1 << rng.randrange(64)) if rng.random() < 0.6 else 0) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = sh.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, 5, dense)
    comp = {r["node"]: r["component"] for r in connected_components(links).collect()}
    root = groups(fps, distance)
    pairs = lambda key: {frozenset((a, b)) for a in range(len(fps)) for b in range(a) if key(a) == key(b)}
    assert pairs(lambda i: comp.get(signed[i], ("alone", i))) == pairs(lambda i: root[i])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(data, min_docs, depth, similarity, keep_first):
    first_id = {}
    for i, t in data:
        first_id[t] = min(first_id.get(t, (True, 0)), (i is None, i or 0))
    lines = [(d, n, lt.masked(x)) for d in first_id for n, x in enumerate((d or "").split("\n")) if x.split()]
    leaf = lambda toks: (len(toks), *toks[:depth])
    in_leaf = defaultdict(set)
    for d, _, t in lines:
        in_leaf[leaf(t)].add(d)
    own = [x for x in lines if len(in_leaf[leaf(x[2])]) >= min_docs]
    docs_of = defaultdict(set)
    for d, _, t in own:
        docs_of[tuple(t)].add(d)
    support = Counter()
    for t, ds in docs_of.items():
        for k, tok in enumerate(t):
            if tok != lt.WILD:
                support[leaf(t), k, tok] += len(ds)
    templates = defaultdict(list)  # from the most specific on
    for t in docs_of:
        levels = [support[leaf(t), k, tok] for k, tok in enumerate(t)]
        for level in range(64):
            kept = tuple(tok if s >= min_docs << level else lt.WILD for tok, s in zip(t, levels))
            if sum(x != lt.WILD for x in kept) >= similarity * len(kept) and any(x != lt.WILD for x in kept):
                templates[t].append((leaf(t), kept))
    count = defaultdict(set)
    for d, _, t in own:
        for tpl in templates[tuple(t)]:
            count[tpl].add(d)
    lost, seen = defaultdict(set), set()
    for d, n, t in sorted(own, key=lambda x: (first_id[x[0]], x[1])):
        recurring = [tpl for tpl in templates[tuple(t)] if len(count[tpl]) >= min_docs]
        if recurring:
            if not keep_first or recurring[0] in seen:
                lost[d].add(n)
            seen.add(recurring[0])
    return Counter((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost[t])) for i, t in data)


@pytest.mark.parametrize("keep_first", [True, False])
def test_line_templates(spark, keep_first):
    data = fx.rows()
    data += [(300 + i, f"job {i} took {i * 7} ms on host h{i}\nplain words {'alpha' if i % 2 else 'beta'} tail end part {['p', 'q', 'r', 's'][i % 4]}") for i in range(9)]
    data += [(None, "job 99 took 1 ms on host h0")] + [(400 + i, "copies of one\ntext are no recurrence") for i in range(9)]
    got = lt.drop_recurring_lines(fx.table(spark, data), min_docs=4, keep_first=keep_first, count_col="n_lost")
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == brute_lines(data, 4, 3, 0.5, keep_first)
    assert got.columns == [*fx.table(spark, data).columns, "n_lost"]
    assert lt.drop_recurring_lines(fx.empty(spark)).count() == 0
