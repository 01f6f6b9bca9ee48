from __future__ import annotations

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationflow.operators import indicators, weather

D = dt.date


def dates(df, column="date"):
    return sorted(r[column] for r in df.select(column).collect())


# --- measures --------------------------------------------------------------------------

def measures(spark, rows):
    return spark.createDataFrame(rows, "Country string, Response_measure string, date_start date, date_end date")


NAMES = {"Masks": "masks", "Curfew": "curfew"}


def test_measures_overlap_open_end_and_null_start(spark):
    raw = measures(spark, [
        ("Netherlands", "Masks", D(2021, 1, 1), D(2021, 1, 3)),
        ("Netherlands", "Masks", D(2021, 1, 2), D(2021, 1, 4)),
        ("Netherlands", "Curfew", D(2021, 1, 8), None),
        ("Netherlands", "Curfew", None, D(2021, 1, 2)),
        ("Belgium", "Curfew", D(2021, 1, 1), D(2021, 1, 9)),
    ])
    out = indicators.measures_daily(raw, "Netherlands", NAMES, D(2021, 1, 9))
    found = {r["date"]: (r["masks"], r["curfew"]) for r in out.collect()}
    assert found == {**{D(2021, 1, d): (1, 0) for d in (1, 2, 3, 4)}, **{D(2021, 1, d): (0, 1) for d in (8, 9)}}


def test_measures_equal_expanded_intervals(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        a = D(2021, 1, 1) + dt.timedelta(rng.randrange(200))
        b = None if rng.random() < 0.02 else a + dt.timedelta(rng.randrange(-2, 9))
        rows.append(("Netherlands", rng.choice(list(NAMES)), a, b))
    expected = {}
    as_of = D(2021, 6, 30)
    for _, m, a, b in rows:
        for i in range((((b or as_of) - a).days) + 1):
            expected.setdefault(a + dt.timedelta(i), set()).add(NAMES[m])
    out = indicators.measures_daily(measures(spark, rows), "Netherlands", NAMES, as_of)
    found = {r["date"]: {c for c in NAMES.values() if r[c]} for r in out.collect()}
    assert found == expected


# --- holidays and vacations --------------------------------------------------------------

def test_holidays(spark):
    years = spark.createDataFrame([(2013,), (2014,), (2021,), (2021,)], "year int")
    found = {(r["date"], r["holiday"]) for r in indicators.holiday_calendar(years).collect()}
    assert len(found) == 33
    assert (D(2021, 4, 4), "Easter Sunday") in found
    assert (D(2021, 5, 13), "Ascension Thursday") in found
    assert (D(2021, 5, 24), "Whit Monday") in found
    assert (D(2013, 4, 30), "King's day") in found
    assert (D(2014, 4, 26), "King's day") in found  # the 27th is a Sunday
    assert (D(2021, 4, 27), "King's day") in found


def test_easter_over_centuries(spark):
    # Published Easter Sundays.
    known = {1818: D(1818, 3, 22), 1943: D(1943, 4, 25), 2000: D(2000, 4, 23), 2008: D(2008, 3, 23),
             2038: D(2038, 4, 25), 2076: D(2076, 4, 19)}
    df = spark.createDataFrame([(y,) for y in known], "year int")
    found = {r["year"]: r["easter"] for r in indicators.easter_sunday(df).collect()}
    assert found == known


def test_vacations_every_year_shift_region_and_overlap(spark):
    docs = [
        {"content": [{"schoolyear": " 2019-2020 ", "vacations": [
            {"type": "Herfst ", "regions": [
                {"region": "noord", "startdate": "2019-10-18T22:00:00.000Z", "enddate": "2019-10-20T22:00:00.000Z"},
                {"region": "zuid", "startdate": "2019-11-01T22:00:00.000Z", "enddate": "2019-11-09T22:00:00.000Z"}]}]}]},
        {"content": [{"schoolyear": "2020-2021", "vacations": [
            {"type": "Kerst", "regions": [
                {"region": "heel Nederland", "startdate": "2020-12-18T23:00:00.000Z", "enddate": "2020-12-20T23:00:00.000Z"},
                {"region": "noord", "startdate": "2020-12-19T23:00:00.000Z", "enddate": "2020-12-21T23:00:00.000Z"}]},
            {"type": "Mei", "regions": []}]}]},
    ]
    from stationflow.sources import schemas
    path = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    years = path.select(F.from_json("value", f"struct<content: {schemas.SCHOOL_YEARS.split(None, 1)[1]}>").alias("d")).select("d.*")
    out = dates(indicators.vacation_calendar(years).where("date > '2019-09-01'"))
    assert out == [D(2019, 10, 19), D(2019, 10, 20), D(2019, 10, 21),
                   D(2020, 12, 19), D(2020, 12, 20), D(2020, 12, 21), D(2020, 12, 22)]
    early = dates(indicators.vacation_calendar(years).where("date < '2019-09-01'"))
    assert len(early) == 6 + 9 + 9 + 44
    ranges = indicators.vacation_ranges(years)
    assert {r["school_year"] for r in ranges.collect()} == {"2019-2020", "2020-2021"}
    assert {r["vacation"] for r in ranges.collect()} == {"Herfst", "Kerst", "Mei"}


# --- stringency and cases ------------------------------------------------------------------

def test_stringency_is_extended_by_13_days(spark):
    doc = {"2021-01-01": {"NLD": {"date_value": "2021-01-01", "stringency": 50.0}, "BEL": {"date_value": "2021-01-01", "stringency": 9.0}},
           "2021-01-02": {"NLD": {"date_value": "2021-01-02", "stringency": 60.5}},
           "2021-01-03": {"BEL": {"date_value": "2021-01-03", "stringency": 1.0}}}
    docs = spark.createDataFrame([(json.dumps(doc),), (json.dumps(doc),)], "document string")
    records = indicators.stringency_records(docs, "NLD")
    assert records.count() == 2  # overlapping documents give each date once
    out = {r["date"]: r["stringency"] for r in indicators.stringency_series(records).collect()}
    assert len(out) == 15
    assert out[D(2021, 1, 15)] == 60.5
    assert max(out) == D(2021, 1, 15)


def test_cases_use_the_given_date_format(spark):
    raw = spark.createDataFrame([("NL", "03/12/2021", 5.0, 1.0), ("BE", "03/12/2021", 9.0, 9.0)],
                                "geoId string, dateRep string, cases double, deaths double")
    r = indicators.cases_deaths(raw, "NL", "dd/MM/yyyy").collect()
    assert [tuple(x) for x in r] == [(D(2021, 12, 3), 5.0, 1.0)]


def test_fill_from_latest(spark):
    source = spark.createDataFrame([(D(2021, 1, 2), 7.0), (D(2021, 1, 1), 3.0)], "date date, cases double")
    grid = spark.createDataFrame([(D(2021, 1, 1),), (D(2021, 1, 9),)], "date date")
    out = indicators.fill_from_latest(grid, source, ["cases"])
    assert {r["date"]: r["cases"] for r in out.collect()} == {D(2021, 1, 1): 3.0, D(2021, 1, 9): 7.0}


# --- weather -------------------------------------------------------------------------------

def observed(spark, rows):
    return spark.createDataFrame(rows, "date string, hour int, station_code string, T double, Q double, WW double")


def test_weather_history_uses_local_hours_tenths_and_one_station(spark):
    raw = observed(spark, [
        ("2021-06-30T00:00:00.000Z", 23, "240", 215.0, 7.0, 1.0),  # 22:00 UTC is 00:00 local
        ("2021-06-30T00:00:00.000Z", 23, "240", 215.0, 7.0, 1.0),
        ("2021-06-30T00:00:00.000Z", 23, "260", 999.0, 9.0, 1.0),
    ])
    r = weather.weather_history(raw, "240", "Europe/Amsterdam").collect()
    assert [(x["date"], x["hour"], x["temperature"], x["global_radiation"]) for x in r] == [(D(2021, 7, 1), 0, 21.5, 7.0)]
    assert "weather_code" not in r[0].asDict()
    kept = weather.weather_history(raw, "240", "Europe/Amsterdam", hour_mode="utc_hour").first()
    assert (kept["date"], kept["hour"]) == (D(2021, 7, 1), 22)


def test_repeated_autumn_hour_gives_one_row(spark):
    raw = observed(spark, [("2021-10-31T00:00:00.000Z", h, "240", t, 0.0, 0.0) for h, t in ((1, 100.0), (2, 120.0), (3, 90.0))])
    out = {(r["date"], r["hour"]): r["temperature"] for r in weather.weather_history(raw, "240", "Europe/Amsterdam").collect()}
    assert out == {(D(2021, 10, 31), 2): 11.0, (D(2021, 10, 31), 3): 9.0}


def predicted(spark, rows):
    return spark.createDataFrame(
        rows, "loc string, tijd bigint, offset string, temp string, vis string, tw string, ico string")


def epoch(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp())


def test_forecast_keeps_smallest_offset_shifts_and_limits_the_fill(spark):
    raw = predicted(spark, [
        ("a", epoch("2021-01-01T00:00"), "6", "1.0", "333", "25", "x"),
        ("a", epoch("2021-01-01T00:00"), "2", "2.0", "666", "50", "x"),
        ("a", epoch("2021-01-02T00:00"), "2", "3.0", "bad", "100", "x"),
    ])
    out = {(r["date"], r["hour"]): r for r in weather.weather_forecast(raw, "Europe/Amsterdam").collect()}
    # 00:00 UTC plus one hour is 02:00 local; filled for 11 more hours.
    assert sorted(out) == [(D(2021, 1, 1), h) for h in range(2, 14)] + [(D(2021, 1, 2), 2)]
    first = out[D(2021, 1, 1), 13]
    assert (first["temperature"], first["sight"], first["cloud_cover"]) == (2.0, 2.0, 4.0)
    assert out[D(2021, 1, 2), 2]["sight"] is None


@pytest.mark.parametrize("seed", range(4))
def test_fill_hours_equals_pandas_resample(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], set()
    for loc in "abc":
        t, times = dt.datetime(2021, 3, 27, 5), []
        for _ in range(40):
            t += dt.timedelta(minutes=rng.choice([15, 30, 60, 60, 60 * 11, 60 * 12, 60 * 13, 60 * 30, 645]))
            times.append(t)
        series = pd.Series(range(len(times)), index=pd.DatetimeIndex(times), dtype="float64")
        rows += [(loc, x, float(i)) for i, x in enumerate(times)]
        filled = series.resample("1h").ffill(limit=11).dropna()
        base = dt.datetime(1970, 1, 1)
        expected |= {(loc, int((ts.to_pydatetime() - base).total_seconds() // 3600), v) for ts, v in filled.items()}
    df = spark.createDataFrame(rows, "loc string, ts timestamp_ntz, v double")
    found = [tuple(r) for r in weather.fill_hours(df).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected


def test_side_tables_with_two_rows_for_a_key_fail(spark):
    from stationflow.operators.shared import unique

    twice = spark.createDataFrame([("2021-01-01", 1), ("2021-01-01", 2), ("2021-01-02", 3)], "date string, v int")
    with pytest.raises(Exception, match="more than one row for one date"):
        unique(twice, "date").collect()
    with pytest.raises(Exception, match="more than one row"):
        spark.createDataFrame([("2021-01-01",)], "date string").join(unique(twice, "date"), "date", "left").collect()
    once = twice.where("v <> 2")
    assert sorted(unique(once, "date").collect()) == sorted(once.collect())


def test_of_revised_readings_the_newest_is_valid(spark):
    rows = [("2021-01-01T00:00:00.000Z", 5, "240", 10.0, "b"), ("2021-01-01T00:00:00.000Z", 5, "240", 30.0, "a"),
            ("2021-01-01T00:00:00.000Z", 5, "260", 99.0, "c")]
    raw = spark.createDataFrame(rows, "date string, hour int, station_code string, T double, revision string")
    assert [r["temperature"] for r in weather.weather_history(raw, "240", "Europe/Amsterdam").collect()] == [1.0]
    with pytest.raises(Exception, match="more than one row"):
        weather.weather_history(raw.drop("revision"), "240", "Europe/Amsterdam").collect()
    same = raw.where("revision = 'a'").drop("revision")
    assert weather.weather_history(same.unionByName(same), "240", "Europe/Amsterdam").count() == 1


def test_hours_around_both_clock_changes(spark):
    """One row per local hour: 02 is missing in March and averaged in October."""
    rows = [(f"{d}T00:00:00.000Z", h, "240", float(10 * h)) for d in ("2021-03-28", "2021-10-31") for h in range(1, 25)]
    raw = spark.createDataFrame(rows, "date string, hour int, station_code string, T double")
    got = {(str(r["date"]), r["hour"]): r["temperature"] for r in weather.weather_history(raw, "240", "Europe/Amsterdam").collect()}
    assert ("2021-03-28", 2) not in got and got["2021-03-28", 3] == 2.0 and got["2021-03-28", 1] == 1.0
    assert got["2021-10-31", 2] == 1.5 and got["2021-10-31", 3] == 3.0
    assert len(got) == 47


def test_measures_without_a_column_are_named(spark):
    raw = spark.createDataFrame([("Netherlands", "Masks", dt.date(2021, 1, 1), None), ("Netherlands", "Curfew", dt.date(2021, 1, 2), None),
                                 ("Belgium", "Other", dt.date(2021, 1, 2), None)],
                                "Country string, Response_measure string, date_start date, date_end date")
    assert indicators.measure_columns(raw, "Netherlands") == {"Curfew": "Curfew", "Masks": "Masks"}
    assert raw.agg(indicators.unlisted("Netherlands", {"Masks": "masks"})).first()[0] == ["Curfew"]
    assert raw.agg(indicators.unlisted("Netherlands", {})).first()[0] == ["Curfew", "Masks"]
    out = indicators.measures_daily(raw, "Netherlands", {"Masks": "masks"}, dt.date(2021, 1, 3))
    assert out.columns == ["date", "masks"] and out.count() == 3
