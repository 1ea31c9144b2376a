import os

import duckdb
import pytest

import __spark_entry__
from emendata.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def shown(value):
    return "" if value is None else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(shown, r)) for r in frame.where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_recheck_covers_all_orders(spark, db):
    plan = catalogue.QUERIES["recheck_plan"](spark, SF).toPandas()
    assert sorted(plan.pos) == sorted(r[0] for r in db.sql("SELECT o_orderkey FROM orders").fetchall())


def test_fetch_verdicts_cover_all_events(spark, db):
    found = catalogue.QUERIES["fetch_verdicts"](spark, SF).toPandas()
    assert found.n.sum() == db.sql("SELECT count(*) FROM events").fetchall()[0][0]
    assert "BLOCKED_BY_ROBOTS" in set(found[found.event_type == "error"].verdict)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
