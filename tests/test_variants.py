"""The data-processing queries on tables with nulls, repeats, clashing columns, or no rows."""

import os

import pytest

from matchloom.plans.data_problems import QUERIES
from tests.sql_check import DATA
from tests.variants import build, found

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
FOUND = sorted(n for n in QUERIES if n.endswith("_found"))


@pytest.fixture(scope="module", params=["empty", "nulls", "repeats", "columns"])
def variant(spark, request, tmp_path_factory):
    return request.param, build(spark, request.param, tmp_path_factory.mktemp(request.param))


@pytest.mark.parametrize("name", FOUND)
def test_found(spark, variant, name):
    kind, folder = variant
    got = found(spark, QUERIES[name], folder)
    if kind == "empty":
        assert got == []
    elif name == "p3_found" and kind != "columns":
        assert len(got) > 0  # nulls and repeats are what a profile counts
    else:
        assert got == found(spark, QUERIES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(FOUND)))
def test_others_run(spark, variant, name):
    kind, folder = variant
    n = QUERIES[name](spark, folder).count()
    assert n == 0 if kind == "empty" else n > 0
