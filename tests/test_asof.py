"""As-of lookup against plain searches."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from stationflow.operators import weather
from stationflow.operators.asof import as_of

START = dt.datetime(2022, 3, 1)


def slow(moments, known, within):
    out = []
    for loc, ts, i in moments:
        best = max(((t, v) for k, t, v in known if k == loc and ts is not None and t is not None and t <= ts),
                   key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=None)
        if best and within is not None and ts > best[0] + dt.timedelta(hours=within):
            best = None
        out.append((loc, ts, i, *(best or (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("within", "block"), [(None, 24), (11, 24), (5, 1), (None, 1000)])
def test_like_a_search(spark, within, block):
    rng = random.Random(block)

    def time():
        return None if rng.random() < 0.02 else START + dt.timedelta(minutes=rng.randint(0, 20 * 1440))

    moments = [(rng.choice(["a", "a", "a", "b", None, "lonely"]), time(), i) for i in range(400)]
    moments += moments[:5]
    known = [(rng.choice(["a", "a", "b", None]), time(), rng.choice([None, *range(9)])) for _ in range(150)]
    known += [(k, t, 5) for k, t, _ in known[:20]] + [(k, t, None) for k, t, _ in moments[:20]]
    left = spark.createDataFrame(moments, "loc string, ts timestamp_ntz, i int")
    right = spark.createDataFrame(known, "loc string, ts timestamp_ntz, v int")
    got = as_of(left, right, ["loc"], within_hours=within, block_hours=block)
    assert got.columns == ["loc", "ts", "i", "found_ts", "v"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow(moments, known, within)


def test_nothing_known_or_asked(spark):
    left = spark.createDataFrame([("a", START)], "loc string, ts timestamp_ntz")
    right = spark.createDataFrame([], "loc string, ts timestamp_ntz, v int")
    assert [tuple(r) for r in as_of(left, right, ["loc"]).collect()] == [("a", START, None, None)]
    assert as_of(left.limit(0), right, ["loc"]).collect() == []


def test_full_hours_get_what_the_hourly_fill_gives(spark):
    rng = random.Random(1)
    rows = [(loc, START + dt.timedelta(minutes=30 * rng.randint(0, 600)), float(i)) for i, loc in enumerate("aab" * 20)]
    rows = list({r[:2]: r for r in rows}.values())
    known = spark.createDataFrame(rows, "loc string, ts timestamp_ntz, v double")
    filled = {(r["loc"], r["hour_index"]): r["v"] for r in weather.fill_hours(known).collect()}
    base = (START - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1)
    last = {loc: max(t for k, t, _ in rows if k == loc) for loc in "ab"}
    hours = [(loc, START + dt.timedelta(hours=h)) for loc in "ab" for h in range(301) if START + dt.timedelta(hours=h) <= last[loc]]
    asked = spark.createDataFrame(hours, "loc string, ts timestamp_ntz")
    got = {(r["loc"], base + (r["ts"] - START) // dt.timedelta(hours=1)): r["v"]
           for r in as_of(asked, known, ["loc"], within_hours=11).collect() if r["found_ts"] is not None}
    assert got == filled


def test_plan_lays_nothing_out(spark):
    left = spark.createDataFrame([("a", START)], "loc string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", START, 1)], "loc string, ts timestamp_ntz, v int")
    text = as_of(left, right, ["loc"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "NestedLoop" not in text
