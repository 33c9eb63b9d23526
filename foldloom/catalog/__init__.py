"""Named queries over the test tables, each with its SQL equivalent where one exists."""

from foldloom.catalog import (  # noqa: F401  (importing registers the queries)
    cleaning,
    deriving,
    encoding,
    evaluating,
    grids,
    logs,
    modelling,
    profiling,
    scaling,
    splitting,
    stored,
)
from foldloom.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
