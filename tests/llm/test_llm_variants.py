"""The llm queries on tables with nulls, repeats, clashing columns, or no rows."""

import os

import pytest

from matchloom.llm.queries import QUERIES
from tests.sql_check import DATA
from tests.variants import build, found

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SAME = ["p1_found", "p7_found", "p9_found", "p10_found"]


@pytest.fixture(scope="module", params=["empty", "nulls", "repeats", "columns"])
def variant(spark, request, tmp_path_factory):
    return request.param, build(spark, request.param, tmp_path_factory.mktemp(request.param))


@pytest.mark.parametrize("name", SAME)
def test_found(spark, variant, name):
    kind, folder = variant
    if kind == "repeats" and name == "p10_found":
        pytest.skip("document ids are unique")
    got = found(spark, QUERIES[name], folder)
    assert got == ([] if kind == "empty" else found(spark, QUERIES[name], DATA))


def test_packing_runs(spark, variant):
    kind, folder = variant
    n = QUERIES["p8_pack"](spark, folder).count()
    assert n == 0 if kind == "empty" else n > 0
