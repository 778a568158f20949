"""Top-k, piece segmentation, packing and the pipeline."""

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from boxloom.llm import packing as pk
from boxloom.llm import topk
from boxloom.llm.piece_nbest import PieceModel, encode_nbest
from boxloom.llm.queries import QUERIES, tokenizer_path

from . import fixtures as fx

BPE = tokenizer_path("word_bpe_49k.json")


def brute_top(data, k, is_query):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in good if is_query(i)}:
        v = min((len(w), w) for i, w in good if i == q)[1]
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_top_k(spark):
    rng = random.Random(5)
    data = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    data += [(i, data[1][1]) for i in range(300, 420)]  # one very common vector
    data += [(420, None), (421, [1.0, None]), (422, [float("nan")] * 8), (423, [float("inf")] * 8), (None, [1.0] * 8), (430, [0.5, 0.5]), (440, [0.1, 0.9]), (450, []), (460, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<float>, label int, score string")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    for rows in (64, 4096):
        got = topk.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=rows, block=7)
        assert {tuple(r) for r in got.collect()} == brute_top(single, 5, lambda i: i % 10 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(0)
    pts = rng.integers(-99, 99, (500, 6))
    tree = topk.BallTree(pts, leaf=16)
    q = rng.integers(-99, 99, (20, 6)).astype(float)
    ub = tree.bounds(q)
    for node, (lo, hi) in enumerate(tree.spans):
        assert ((q @ tree.sorted[lo:hi].T).max(axis=1) <= ub[:, node]).all()


PIECES = {p: (i, -float(i)) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "."], 10)}


def all_segmentations(text, model):
    """Scores of every path through the whole lattice."""
    s = "▁" + text.replace(" ", "▁")

    def walk(i):
        if i == len(s):
            yield 0.0, b""
            return
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in model.pieces:
                k, score = model.pieces[s[i:j]]
                for t, ids in walk(j):
                    yield score + t, k.to_bytes(4, "little") + ids
        if s[i] not in model.pieces:
            own = np.array([model.byte_ids[x] for x in s[i].encode()], dtype="<u4").tobytes()
            for t, ids in walk(i + 1):
                yield model.unknown + t, own + ids

    return list(walk(0))


@settings(max_examples=150, deadline=None)
@given(st.text("abc. zé\n", max_size=9), st.integers(1, 6))
def test_nbest_is_exact(text, n):
    model = PieceModel(pieces=PIECES, byte_ids=list(range(1000, 1256)), n=n)
    got = model.encode(text)
    if not text:
        assert got == [(0.0, b"")]
        return
    every = all_segmentations(text, model)
    assert [s for s, _ in got] == heapq.nlargest(n, [s for s, _ in every])
    assert len({ids for _, ids in got}) == len(got) and all((s, ids) in every for s, ids in got)
    assert all(model.decode(ids) == text for _, ids in got)


def words_of_the_real_model():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéüßABCXYZ019.,-"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["▁", "a▁b", "x\ny", "漢字", "😀", "\u2581 x", "s" * 60, "the" * 30]


def test_arrays_and_single_searches_agree_on_the_real_model():
    path = tokenizer_path("piece_bpe_32k.model")
    together, alone = PieceModel(path), PieceModel(path)
    words = words_of_the_real_model()
    list(together.encode_batch([" ".join(words)]))
    for word in words:
        for chunk in alone.split(word):
            assert together.chunk(chunk) == alone.chunk(chunk)
            assert alone.chunk(chunk)[0] == next(alone.search(chunk))[0]


def test_nbest_of_the_real_model_is_exact():
    model = PieceModel(tokenizer_path("piece_bpe_32k.model"), n=4)
    for word in [w for w in words_of_the_real_model() if len(w) < 8 and "▁" not in w]:
        text = word + " of it"
        assert [s for s, _ in model.encode(text)] == heapq.nlargest(4, [s for s, _ in all_segmentations(text, model)])


def test_every_text_is_restored():
    model = PieceModel(tokenizer_path("piece_bpe_32k.model"))
    for text in ["a▁b", "▁x", "▁ ▁▁", " lead", "two  spaces ", "x\n▁\ty", "😀▁😀", "▁" * 99, "\ufffd"]:
        assert all(model.decode(ids) == text for _, ids in model.encode(text))


def test_nbest_documents(spark):
    out = encode_nbest(fx.table(spark), tokenizer_path("piece_bpe_32k.model"), n=2)
    rows = out.collect()
    texts = defaultdict(set)
    for i, t in fx.rows():
        texts[i].add(t or "")
    assert all(r["decoded"] in texts[r["doc_id"]] for r in rows)
    assert Counter(r["doc_id"] for r in rows if r["rank"] == 1) == Counter(i for i, _ in fx.rows())
    assert encode_nbest(fx.empty(spark), tokenizer_path("piece_bpe_32k.model")).count() == 0


def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= capacity
    return len(places)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    runs = pk.plan_runs(dict(Counter(lengths)), 40)
    rows = []
    for n, count in Counter(lengths).items():
        for rank in range(count):
            at = int(np.searchsorted(runs[n][:, 0], rank, side="right")) - 1
            rows.append({"sequence_id": runs[n][at, 1] + rank - runs[n][at, 0], "offset": runs[n][at, 2], "length": n})
    assert check_packing(rows, 40) == best_fit_decreasing(lengths, 40)


def test_pack(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = pk.pack_documents(fx.table(spark), BPE).collect()
    want = Counter()
    for i, text in fx.rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert check_packing(rows, 4096) == best_fit_decreasing([r["length"] for r in rows], 4096)
    assert pk.pack_documents(fx.empty(spark), BPE).count() == 0


def test_word_ids_equal_the_tokenizer():
    w = pk.WordIds(BPE)
    for x in ["a\x01b c \x01 d", "<|endoftext|> Hi<|STARTOFTEXT|>", "e\u0301. É, don't 'S.' foo)). x\u00a0y 12.5% İstanbul ŉ ﬁ", "", "  ", "It's'll ...!!! a.b.c #1#"]:
        assert np.frombuffer(w.encode([x.encode()])[0], "<u4").tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids


def test_pipeline(spark, tmp_path):
    """Each stage against its own rule on the smallest tables; run() gives the last stage's rows."""
    from boxloom.llm.common import held_out
    from boxloom.llm.quality import quality_score, train_quality
    from boxloom.llm.secret_scan import base_spans

    from .test_dedup import brute_lines
    from .test_near_copies import brute_groups

    docs = spark.read.parquet(f"{fx.SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, fx.SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = out.collect()
        if k < 4:
            assert out.columns == names and all(r["n_chars"] == len(r["text"]) for r in after)
            got = {r["doc_id"]: r["text"] for r in after}
        if k == 0:
            model = train_quality(docs, spark.read.parquet(f"{fx.SF}/labels.parquet"), ~held_out("doc_id", 0))
            assert set(got) == {r["doc_id"] for r in docs.where(quality_score(spark, model, F.col("text")) >= 0.3).collect()}
        elif k == 1:
            assert Counter(got.items()) == brute_lines(list(before.items()), 4, 3, 0.5, False)
        elif k == 2:
            ids = sorted(before)
            root = brute_groups([before[i] for i in ids])
            least = {}
            for i, r in zip(ids, root):
                least.setdefault(r, i)
            assert set(got) == set(least.values())
        elif k == 3:
            assert set(got) == set(before) and all(g == before[i] or "[SECRET]" in g for i, g in got.items())
            assert all("[SECRET]" in g for i, g in got.items() if base_spans(before[i]))
        else:
            check_packing(after, 4096)
            assert {r["doc_id"] for r in after} == set(before)
        docs = out
    assert len(stages) == 5
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, fx.SF).collect()) == Counter(tuple(r)[:5] for r in after)


def test_queries_have_whole_tables(spark):
    n = spark.read.parquet(f"{fx.SF}/documents.parquet").count()
    for name in ("op1_line_dedup", "op3_exact_dedup"):
        assert QUERIES[name](spark, fx.SF).count() == n


def test_other_tokenizers_encode_whole_texts():
    assert not pk.WordIds.checked(BPE).whole
    w = pk.WordIds.checked(tokenizer_path("byte_bpe_50k.json"))
    assert w.whole and np.frombuffer(w.encode([b"Hello  world\n"])[0], "<u4").tolist() == w.tokenizer.encode("Hello  world\n", add_special_tokens=False).ids
