"""Every registered query outside of llm runs, and agrees with its SQL."""

import os

import pytest

from matchloom.plans import registry
from tests.sql_check import DATA, engine, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def sql_engine():
    return engine()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql_engine, name):
    if name in SQL:
        same(spark, QUERIES[name], SQL[name], sql_engine)
    else:
        assert QUERIES[name](spark, DATA).count() >= 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_without_llm(spark, monkeypatch):
    """The entry module works without the subpackage llm."""
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("matchloom.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "matchloom.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    assert entry.entry(spark).count() > 0
