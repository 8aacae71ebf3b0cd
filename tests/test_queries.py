"""Every registered shop query against its DuckDB text on the small tables."""

import pytest

from lakeforge.plans.queries import ORACLES, QUERIES

from .conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, wanted = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


def test_every_query_has_a_text():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["sale_date", "category", "revenue", "units", "orders", "lines", "avg_ticket"]
    assert out.count() > 0
