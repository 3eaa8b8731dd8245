"""The llm queries run on the test tables, and give what their columns promise."""

import os

import pytest

from matchloom.llm.queries import QUERIES
from matchloom.llm.oracles import oracles
from tests.sql_check import DATA, engine, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {"p1_found": ["player_id"], "p7_found": ["toon_id_a", "toon_id_b"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in oracles():
        same(spark, QUERIES[name], oracles()[name], engine())
        return
    df = QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and df.distinct().count() == df.count()
    else:
        assert df.count() > 0
