"""Every query with SQL gives the rows DuckDB gives."""

import pytest

from checks.compare import compare, duck
from gridloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op4_ngram_jaccard_join", "op8_exact_top_k", "op10_embedding_near_dedup"])
def test_query(spark, sf, name):
    assert compare(spark, duck(sf), QUERIES[name], SQL[name], sf) == ""


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
