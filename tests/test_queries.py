"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from partcast.catalog import load
from check import compare, fetch_duck

# corpus operators have tests of their own
QUERIES = dict(load().queries)
SQL = dict(load().sql)
#: More replicates than SQL can hold; test_replicates compares them with fewer.
PUBLISHED = {n for n in QUERIES if n.rsplit("_", 1)[-1] in ("1000", "2000", "10000", "20000")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(x) for x in df.collect()]
    cols, want = fetch_duck(duck, SQL[name])
    assert compare(df.columns, rows, cols, want) == ""
    assert rows, "a query that returns nothing checks nothing"


def test_entry_is_lazy_and_named(spark):
    df = entry.entry(spark)
    assert {"model", "mae", "cost", "mae_rank", "cost_rank"} <= set(df.columns)
    assert df.count() == 9


def test_only_fitted_or_keyed_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == PUBLISHED | {
        "fill_matched_policy", "learner_forecast", "learner_importance", "learner_quantiles", "pseudonymise_blake2b"}


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
