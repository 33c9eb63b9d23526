"""Every registered query against its SQL on the same tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import compare, connect  # noqa: E402

from foldloom.catalog import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, sf, name):
    assert compare(spark, db, sf, name) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["lasso_cv", "tree_cv", "search_best", "recommend_heads"])
def test_model_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
