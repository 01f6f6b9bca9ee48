"""Every registered query against its SQL, row by row."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import differences, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# The corpus part has its own tests.
CORPUS = {n for n in QUERIES if n == "pipeline" or n[:2] == "op" and n[2].isdigit()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(set(SQL) - CORPUS))
def test_matches_sql(spark, con, sf_dir, name):
    assert differences(spark, con, name, QUERIES[name], SQL[name], sf_dir) is None


def test_all_queries_have_sql():
    assert set(QUERIES) - set(SQL) - CORPUS == set()
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"check_ins_week_ago", "planned_event"} <= set(df.columns)


def test_results_do_not_depend_on_session_zone(spark, con, sf_dir):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("planned_event", "weather_history", "future_grid", "posts_to_events", "event_times"):
            assert differences(spark, con, name, QUERIES[name], SQL[name], sf_dir) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
