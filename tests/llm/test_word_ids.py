"""Plain words of op10 in the faster library."""

import numpy as np

from boxloom.llm import packing as pk
from boxloom.llm.queries import tokenizer_path

from . import fixtures as fx

BPE = tokenizer_path("word_bpe_49k.json")


def test_plain_words_have_the_ids_of_the_tokenizer(spark):
    w = pk.WordIds.checked(BPE)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{fx.SF}/documents.parquet").select("text").collect()]
    words = sorted({x for t in texts for x in t.encode().lower().split() if pk.PLAIN.fullmatch(x)} | {b"a", b"\xc3\x9f", b"stra\xc3\x9fe", b"x" * 5000, b"na\xc3\xafve"})
    w.learn_plain(words, block=100)
    assert len(words) > 1000 and not w.whole
    assert all(w.known[x] == w.raw(x) for x in words)


def test_other_files_have_no_quick_encoder():
    w = pk.WordIds.checked(tokenizer_path("byte_bpe_50k.json"))
    assert w.quick is None
    assert np.frombuffer(w.encode([b"plain words"])[0], "<u4").tolist() == w.tokenizer.encode("plain words", add_special_tokens=False).ids
