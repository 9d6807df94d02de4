"""Every query of the engine's own operators against its oracle, on the smallest tables."""

import pytest

from colonnade.functions import queries as functions
from colonnade.plans import queries as plans
from colonnade.streaming import queries as streaming

SF = "/root/testdata/sf0.001"
QUERIES = {**plans.QUERIES, **streaming.QUERIES, **functions.QUERIES}
SQL = {**plans.ORACLE_SQL, **streaming.ORACLE_SQL, **functions.ORACLE_SQL}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, same, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in SQL:
        same(got, duck.sql(SQL[name]).to_arrow_table())
    else:
        assert got.num_columns


def test_whole_tables_are_run(spark, duck):
    number = lambda sql: duck.sql(sql).to_arrow_table().column(0)[0].as_py()
    events, customers = number("SELECT count(*) FROM events"), number("SELECT count(*) FROM customer")
    assert all(QUERIES[f"fn_{k}"](spark, SF).count() == events for k in ("cos", "sin", "tan", "power", "hypot", "exp"))
    assert QUERIES["fn_product"](spark, SF).count() == number("SELECT count(DISTINCT user_id) FROM events")
    semi, anti, left, right, inner = (QUERIES[f"join_{k}"](spark, SF).count() for k in ("semi", "anti", "left", "right", "inner"))
    assert semi + anti == left == customers and semi > 0 and anti > 0 and right > inner > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
