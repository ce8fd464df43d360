"""Every registered query against its SQL twin on the smallest tables."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries(), oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def text(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([text(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR)
    found = got.collect()
    assert found or name == "recent_errors"
    if name in ORACLES:
        want = tables.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, found) == rows(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_outbox_searches_replies_for_actions_once(spark):
    plan = QUERIES["sink_outbox"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "user_id" not in plan
