"""The language model with many hash ranges keeps few of its files mapped, and scores as with all of them."""

import numpy as np

from boxloom.llm import kneser_ney as kn

from . import fixtures as fx


def test_two_hundred_ranges_and_a_limit_of_maps(spark):
    docs = fx.table(spark).select("doc_id", "text")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        model = kn.train(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert model.ranges == 200
    texts = [t or "" for _, t in fx.rows()]
    hashes = kn.Hashes()
    words = [np.array([*[hashes[w.encode()] for w in fx.words(t)], int(kn.END)], dtype=np.uint64) for t in texts]
    tokens, lengths = np.concatenate(words), np.array([len(w) for w in words])
    every = model.open().log10(tokens, lengths)
    assert len(model.maps) > 300
    few = model.open(16).log10(tokens, lengths)
    assert len(model.maps) == 16
    for a, b in zip(every, few):
        assert (a == b).all()
