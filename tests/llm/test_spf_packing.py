"""Shortest-pack-first packing: pieces against the tokenizer itself, sequences against the contract."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from boxloom.llm import spf_packing as sp
from boxloom.llm.queries import QUERIES, tokenizer_path

from . import fixtures as fx

PATH = tokenizer_path("byte_bpe_50k.json")


def plain_ids(text, tokenizer=Tokenizer.from_file(PATH)):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def checked(rows, data, capacity=1024):
    """Each id of each document in exactly one piece, sequences without gaps and not too long; the padding."""
    want = Counter()
    for doc_id, text in data:
        want[doc_id, tuple(plain_ids(text))] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc_id, ids), n in want.items():
        own = pieces[doc_id, len(ids)]
        for start, length, value in own:
            fits = [x for (d, x), _ in want.items() if d == doc_id and len(x) == len(ids) and crc(x[start : start + length]) == value]
            assert fits
        same = sum(k for (d, x), k in want.items() if d == doc_id and len(x) == len(ids))
        assert Counter(i for s, k, _ in own for i in range(s, s + k)) == {i: same for i in range(len(ids))}
    assert sum(map(len, pieces.values())) == len(rows)
    pad = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad


def test_ids_are_the_tokenizers():
    own, rng = sp.ByteIds(PATH), random.Random(1)
    assert not own.whole
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\r", "'s", "'", "1", "23", ".", "!?", " ", "　", " ", "\u0085", "é", "日", "<|endoftext|>", "🙂", "\x00", "\x1c", "​", "x\n", "\n\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))).encode() for _ in range(5000)]
    assert own.encode(texts) == [own.raw(t) for t in texts]
    own.most = 10
    assert own.encode(texts[:300]) == [own.raw(t) for t in texts[:300]]


def test_another_kind_of_tokenizer_encodes_whole_texts():
    own = sp.ByteIds(tokenizer_path("word_bpe_49k.json"))
    assert own.whole and own.encode([b"Some words", b""]) == [own.raw(b"Some words"), b""]


def test_plan_fills_the_emptiest_pack():
    runs, fillings = sp.shortest_pack_first({6: 2, 5: 1, 4: 3, 1: 2}, 10)
    # 6, 6, 5 open packs; one 4 goes to the 5 and two to the 6s; the 1s to the emptiest, the 9
    assert runs[6] == [(0, 0, 0)] and runs[5] == [(0, 2, 0)]
    assert runs[4][0] == (0, 2, 5) and [r[0] for r in runs[4]] == [0, 1] and runs[4][1][2] == 6
    assert runs[1][0] == (0, 2, 9) and fillings == {10: 3, 1: 1}


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_everything_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 99): rng.randint(1, 500) for _ in range(40)}
    runs, fillings = sp.shortest_pack_first(counts, 100)
    filled = Counter()
    for length, own in runs.items():
        ends = [r[0] for r in own[1:]] + [counts[length]]
        for (rank, first, used), end in zip(own, ends):
            for k in range(end - rank):
                assert filled[first + k] == used
                filled[first + k] += length
    assert max(filled.values()) <= 100 and Counter(filled.values()) == fillings
    assert sum(filled.values()) == sum(k * n for k, n in counts.items())


def test_documents_with_odd_rows(spark):
    data = fx.rows()
    out = sp.pack_documents(fx.table(spark, data), PATH)
    checked(out.collect(), data)
    assert sp.pack_documents(fx.empty(spark), PATH).count() == 0


def test_rests_that_pad_too_much_are_cut(spark):
    """Texts of a little over half the capacity: whole they would pad 40 %."""
    word = " tree"
    data = [(i, "a" + word * (600 + i % 7)) for i in range(200)]
    rows = sp.pack_documents(fx.table(spark, data), PATH).collect()
    assert checked(rows, data) < 0.01 * sum(r["length"] for r in rows)


def test_one_length_holds_a_third_of_the_rows(spark):
    data = [(i, "a b c") for i in range(400)] + [(1000 + i, "a " * (i % 300)) for i in range(800)]
    rows = sp.pack_documents(fx.table(spark, data).repartition(7), PATH).collect()
    assert checked(rows, data) < 0.02 * sum(r["length"] for r in rows)


def test_query(spark):
    docs = spark.read.parquet(f"{fx.SF}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = QUERIES["op13_spf_packing"](spark, fx.SF).collect()
    assert checked(rows, data) < 0.02 * sum(r["length"] for r in rows)
