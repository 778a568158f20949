"""The new queries against their SQL on the smallest tables."""

import pytest

from boxloom.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connect, same
from . import fixtures as fx


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_importance_resampling"])
def test_same_rows(spark, name):
    same(QUERIES[name](spark, fx.SF), connect(fx.SF), ORACLE_SQL[name])
