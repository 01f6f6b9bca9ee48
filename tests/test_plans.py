"""Physical plans: what must not appear in them, and what must."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from stationflow.operators import weather

QUERIES = entry.queries()
MODELS = {"imputed_flows", "trained_scores", "forecast_rows"}
UNZIPS = {"scan_weather_any_extension"}  # the one reader that needs Python
CORPUS = {n for n in QUERIES if n == "pipeline" or n[:2] == "op" and n[2].isdigit()}  # has tests of its own


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS - UNZIPS - CORPUS))
def test_no_cross_joins_and_no_python_in_plans(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for word in ("NestedLoop", "CartesianProduct", "InPandas", "ArrowEvalPython", "BatchEvalPython"):
        assert word not in text


@pytest.mark.parametrize("name", ["events_unified", "weather_forecast", "model_log"])
def test_keep_first_is_cut_before_the_shuffle(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert re.search(r"WindowGroupLimit .*Partial", text)


@pytest.mark.parametrize(("name", "columns"), [
    ("hourly_flows", {"ts", "user_id", "event_type", "value"}),
    ("measures_daily", {"event_id", "ts", "user_id"}),
    ("stop_types", {"l_suppkey"}),
    ("link_extract", {"page_id", "html"}),
    ("holiday_calendar", {"o_orderdate"}),
])
def test_scans_read_only_what_they_use(spark, sf_dir, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, sf_dir, name))
    read = [set(part.split(":")[0] for part in s.split(",") if part) for s in schemas]
    assert any(r == columns for r in read)


def test_filters_reach_the_scan(spark, sf_dir):
    assert "PushedFilters: [In(event_type, [click,view])" in plan(spark, sf_dir, "hourly_flows") or (
        "PushedFilters: [In(event_type, [view,click])" in plan(spark, sf_dir, "hourly_flows"))
    # The station code is made of the user; only what it stands on can reach the scan.
    assert re.search(r"DataFilters: \[.*user_id#\d+L % 2", plan(spark, sf_dir, "weather_history"))


def test_flows_take_two_shuffles(spark, sf_dir):
    assert plan(spark, sf_dir, "hourly_flows").count("Exchange hashpartitioning") == 2


def test_week_ago_adds_one_shuffle_and_no_join(spark, sf_dir):
    text = plan(spark, sf_dir, "week_ago")
    assert text.count("Exchange hashpartitioning") == 3
    assert "Join" not in text


def test_no_station_is_sorted_as_a_whole(spark, sf_dir):
    """Windows by station alone only run over tallied classes, never over flow rows."""
    for name in sorted(set(QUERIES) - MODELS - {"busy_threshold", "crowding_flag"}):
        assert not re.search(r"hashpartitioning\(station#\d+, \d+\).*\n.*Window", plan(spark, sf_dir, name))


def test_planning_runs_no_job(spark, sf_dir):
    """A query without files or models of its own is only a plan until it is asked for rows."""
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        for name in ("measures_daily", "week_ago", "planned_event", "weather_as_of", "drifting_ticket_pages"):
            QUERIES[name](spark, sf_dir)
        # Only footers are read, once for each table that is opened (measures_daily opens it twice).
        started = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
        reads = [spark.sparkContext.statusTracker().getJobInfo(j) for j in started]
        assert all(len(r.stageIds) == 1 for r in reads if r) and len(started) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_filled_hours_are_grouped_only_around_clock_changes(spark):
    """Filled hours are many times the rows read: a task that groups them holds them all."""
    raw = spark.createDataFrame([("a", 1711756800 + 86400 * d, "1", str(d)) for d in range(220)], "loc string, tijd long, offset string, temp string")
    out = weather.weather_forecast(raw, "Europe/Amsterdam")
    top = out._jdf.queryExecution().optimizedPlan()
    parts = [top.children().apply(i).toString().split("\n")[0] for i in range(top.children().size())]
    assert top.nodeName() == "Union" and ["Aggregate [loc" in p for p in parts] == [False, True]
    rows = out.collect()
    assert len(rows) == len({(r["loc"], r["date"], r["hour"]) for r in rows}) > 220
