"""Every registered query against its SQL, on the smallest test tables."""

import functools
import os

import pytest

import __spark_entry__ as registry
from checks import spark_queries
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
# At this size no supplier's series is short enough, or no merchant is large enough.
EMPTY_HERE = {"missing_forecasts"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Store each fact and series once for all queries of this file."""
    patch = pytest.MonkeyPatch()
    for name in ("stored_fact", "stored_observed", "stored_series"):
        patch.setattr(spark_queries, name, functools.cache(getattr(spark_queries, name)))
    yield
    patch.undo()


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) >= 70


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = registry.queries()[name](spark, FOLDER)
    problems = differences(frame, duck, registry.oracle_sql()[name])
    if name in EMPTY_HERE and problems == ["no rows on either side"]:
        problems = []
    assert problems == []


def test_flagship(spark):
    assert registry.entry(spark).count() == 5
