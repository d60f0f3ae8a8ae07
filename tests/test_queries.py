"""Every registered query runs on sf0.001 and yields a stable schema; the flagship entry returns rows."""

import pytest

import __spark_entry__ as E

from .conftest import SF

#: 630 model fits; tests/test_edges.py runs its operator on small series
SLOW = {"q_auto_arima"}


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"clv", "RECENCY_normalised", "CustomerID"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n.startswith("q_") and n not in SLOW))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    assert len(cols) == len(set(cols))
    df.limit(5).collect()
