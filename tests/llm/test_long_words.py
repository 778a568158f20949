"""Piece segmentation of long unbroken words: time, memory, and the n best against a plain n-best recursion."""

import random
import resource
import time

import numpy as np
import pytest

from boxloom.llm.piece_nbest import SPACE, PieceModel
from boxloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def model():
    return PieceModel(tokenizer_path("piece_bpe_32k.model"))


def nbest_scores(model, text, n):
    """The n best scores over the whole lattice, place by place."""
    s = SPACE + text.replace(" ", SPACE)
    width = max(map(len, model.pieces))
    at = [[0.0]] + [[] for _ in s]
    for j in range(1, len(s) + 1):
        found = []
        for i in range(max(0, j - width), j):
            own = model.pieces.get(s[i:j])
            if own is not None:
                found += [x + own[1] for x in at[i]]
        if s[j - 1] not in model.pieces:
            found += [x + model.unknown for x in at[j - 1]]
        at[j] = sorted(found, reverse=True)[:n]
    return at[-1]


def score_of(model, ids):
    by = {i: s for i, s in model.pieces.values()}
    return sum(by.get(i, 0.0) for i in np.frombuffer(ids, "<u4").tolist())


@pytest.mark.parametrize("text", ["a" * 100_000, "." * 100_000, " " * 100_000, "ab" * 100_000, "x" + "-=" * 30_000 + " end", "\t" * 20_000])
def test_long_runs(model, text):
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = model.encode(text)
    assert time.perf_counter() - began < 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB
    assert len({ids for _, ids in found}) == len(found) == (1 if text[0] == "\t" else 3)  # a tab is no piece
    assert [s for s, _ in found] == sorted([s for s, _ in found], reverse=True)
    for _, ids in found:
        assert model.decode(ids) == text


@pytest.mark.parametrize("unit", ["a", ".", " ", "ab", "=-", "the", "  x", "▁", "aé"])
@pytest.mark.parametrize("size", [1, 2, 5, 30, 47, 48, 49, 90, 400])
def test_scores_are_the_n_best(model, unit, size):
    text = (unit * size)[:size]
    found = model.encode(text)
    if SPACE in text:
        assert all(model.decode(ids) == text for _, ids in found)
        return
    assert [s for s, _ in found] == nbest_scores(model, text, 3)
    assert len({ids for _, ids in found}) == len(found)


def test_mixed_texts(model):
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choice(["a", "b", ".", " ", "  ", "ing", "é", "——", "0"]) * rng.randint(1, 30) for _ in range(rng.randint(1, 12)))
        found = model.encode(text)
        assert [s for s, _ in found] == nbest_scores(model, text, 3)
        if all(c in model.pieces for c in text.replace(" ", SPACE)):
            assert [score_of(model, ids) for _, ids in found] == [s for s, _ in found]
