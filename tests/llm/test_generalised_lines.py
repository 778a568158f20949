"""Templates whose word fields have values that recur themselves."""

import random

import pytest

from boxloom.llm import line_templates as lt

from . import fixtures as fx


@pytest.mark.parametrize("n", [100, 1000, 10000])
def test_two_word_fields_are_found_at_every_size(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    names, cities = [word() for _ in range(300)], [word() for _ in range(300)]
    pick = lambda xs: xs[0] if rng.random() < 0.2 else rng.choice(xs)  # noqa: E731  one frequent value beside rare ones
    data = [(i, f"{word()} {word()}\nPosted here by {pick(names)} in {pick(cities)} with all rights reserved") for i in range(n)]
    got = lt.drop_recurring_lines(fx.table(spark, data), keep_first=False)
    assert sum("Posted" in r["text"] for r in got.collect()) == 0
