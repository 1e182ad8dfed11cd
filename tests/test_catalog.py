import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

from .conftest import SF


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_its_sql(spark, db, name):
    assert compare(spark, name, SF, db) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_round_robin_exchange(spark):
    for name, query in entry.queries().items():
        if name.startswith("op") or name in ("pipeline", "admit_stream"):
            continue
        assert "RoundRobinPartitioning" not in query(spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_texts_are_lowered_twice_at_most(spark):
    plan = entry.queries()["filter_output"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") <= 2
