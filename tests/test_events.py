from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from stationflow.config import ForecastConfig
from stationflow.functions.geo import STATION_POINTS, VENUES, geodesic_km
from stationflow.functions.text import CLOCK_BEFORE_20, with_caption_datetime
from stationflow.operators import analysis, events, extract
from stationflow.operators.planned_event import planned_event

T = dt.datetime
CFG = ForecastConfig()
SHEET = ("ord bigint, Datum string, Locatie string, `Naam evenement` string, `Start show` string, "
         "`Einde show` string, `Aantal bezoekers` double")


def haversine_km(a, b):
    """Spherical distance, a plausibility bound."""
    la, lo, lb, lp = (math.radians(x) for x in (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def sheet(spark, rows):
    return spark.createDataFrame(rows, SHEET)


# --- cleaning and union ----------------------------------------------------------------------

def test_sheet_cleaning(spark):
    raw = sheet(spark, [
        (1, None, None, None, None, None, None),
        (2, events.SHEET_FOOTER, "x", None, None, None, None),
        (3, "2021-01-01", None, "n", "20:00:00", None, None),
        (4, "2021-01-01", "Overig", "n", "20:00:00", None, None),
        (5, "2021-01-01", "Arena", "n", None, None, None),
        (6, "2021-01-01", "Arena", "n", "20:00:00", None, None),
        (7, None, "Arena", "n", "20:00:00", None, None),
    ])
    assert [r["ord"] for r in events.events_clean(raw).orderBy("ord").collect()] == [6, 7]
    assert [r["ord"] for r in events.events_clean(raw, with_time=False).orderBy("ord").collect()] == [5, 6, 7]


def test_event_times_prefix_tolerance_and_midnight(spark):
    raw = sheet(spark, [(1, "2021-01-01 00:00:00", "Arena", "n", "1899-12-30 20:00:00", "00:30:00", None),
                        (2, "2021-01-01", "Arena", "n", "20:15", "laat", None)])
    out = {r["ord"]: r for r in events.event_times(raw).collect()}
    assert out[1]["start_ts"] == T(2021, 1, 1, 20)
    assert out[1]["end_ts"] == T(2021, 1, 1, 0, 30)
    assert (out[2]["start_show"], out[2]["start_ts"], out[2]["end_ts"]) == ("20:15", T(2021, 1, 1, 20, 15), None)
    rolled = {r["ord"]: r for r in events.event_times(raw, roll_midnight=True).collect()}
    assert rolled[1]["end_ts"] == T(2021, 1, 2, 0, 30)


def sources(spark):
    raw = sheet(spark, [(1, "2021-07-01", " Ziggo dome ", "Concert", "20:00:00", "23:00:00", 100.0),
                        (2, "2018-07-01", "Arena", "Old", "20:00:00", "23:00:00", 999.0),
                        (3, "2021-07-02", "Arena", "Match", "1899-12-30 18:00:00", None, 50.0)])
    posts = spark.createDataFrame([(1, "ziggodome", "2021-07-01 20:00:00"), (2, "nobody", "2021-07-03 20:00:00")],
                                  "ord bigint, venue string, event_date string")
    tickets = spark.createDataFrame(
        [(1, "Play", "Koninklijk Theater Carre", "2021-07-01T18:00:00Z"),
         (2, "Play", "Koninklijk Theater Carre", "2021-07-01T18:00:00Z"),
         (3, "Late", "Melkweg", "2021-12-31T23:30:00Z")],
        "ord bigint, name string, venue string, datetime string")
    return raw, posts, tickets


def test_union_dedups_across_sources_and_adds_manual_matches(spark):
    out = events.events_unified(*sources(spark), CFG)
    found = {(r["venue"], r["start_ts"], r["source_rank"]) for r in out.where("source_rank < 3").collect()}
    assert found == {
        ("Ziggo Dome", T(2021, 7, 1, 20), 0),          # the post of the same show is dropped
        ("Arena", T(2021, 7, 2, 18), 0),
        ("nobody", T(2021, 7, 3, 20), 1),              # unknown account stays
        ("Royal Theater Carré", T(2021, 7, 1, 20), 2),  # UTC became local, the copy is gone
        ("Melkweg", T(2022, 1, 1, 0, 30), 2),          # local date moves with the time
    }
    assert out.where("source_rank = 3").count() == 8
    assert tuple(out.agg(*[c.alias(n) for n, c in events.unknown_venues().items()]).first()) == (1, ["nobody"])


def test_source_switches_and_utc_mode(spark):
    only_sheet = events.events_unified(*sources(spark), CFG.with_(include_social_events=False, include_ticketed_events=False))
    assert {r["source_rank"] for r in only_sheet.collect()} == {0, 3}
    as_is = events.events_unified(*sources(spark), CFG.with_(ticket_zone_mode="as_is"))
    assert as_is.where("venue = 'Royal Theater Carré'").first()["start_ts"] == T(2021, 7, 1, 18)


def test_normalised_visitors(spark):
    out = events.events_normalized(events.events_unified(*sources(spark), CFG))
    found = {r["venue"]: r["visitors_normalized"] for r in out.where("source_rank = 0").collect()}
    assert found == {"Ziggo Dome": 1.0, "Arena": 0.5}


# --- distances -------------------------------------------------------------------------------

def test_distances_match_known_values(spark):
    out = {(r["venue"], r["station"]): r["distance_km"] for r in events.venue_distances(spark).collect()}
    assert len(out) == len(VENUES) * len(STATION_POINTS)
    assert out["Ziggo Dome", "Station Bijlmer ArenA"] == pytest.approx(0.7474, abs=1e-4)
    assert out["Gaasperplas", "Centraal Station"] == pytest.approx(1.5183, abs=1e-4)
    for (v, s), km in out.items():
        assert km == pytest.approx(haversine_km(VENUES[v], STATION_POINTS[s]), rel=0.0035)


def test_station_without_coordinates_is_an_error(spark):
    with pytest.raises(ValueError, match="no coordinates"):
        events.venue_distances(spark, ["A"])
    assert events.venue_distances(spark, ["A"], {"A": (52.0, 4.9)}).count() == len(VENUES)


def test_geodesic_on_far_and_equal_points(spark):
    # A published test line of the WGS-84 ellipsoid (Flinders Peak - Buninyong, metres).
    df = spark.createDataFrame(
        [(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), (52.0, 4.0, 52.0, 4.0)],
        "a double, b double, c double, d double")
    found = [r[0] for r in df.select(geodesic_km("a", "b", "c", "d")).collect()]
    assert found[0] == pytest.approx(54.972271, abs=2e-3)
    assert found[1] == pytest.approx(0.0, abs=1e-9)


# --- score -----------------------------------------------------------------------------------

HOURS = "station string, date date, hour int"
EVENTS = "ord bigint, venue string, date date, start_ts timestamp_ntz, end_ts timestamp_ntz, visitors double"


def distances(spark, values):
    return spark.createDataFrame(values, "venue string, station string, distance_km double")


def brute_score(hour_rows, event_rows, km, cfg):
    out = {}
    before = dt.timedelta(hours=cfg.hours_before, minutes=cfg.minutes_before)
    after = dt.timedelta(hours=cfg.hours_after, minutes=cfg.minutes_after)
    for station, date, hour in hour_rows:
        t = T.combine(date, dt.time(hour))
        hits = []
        for o, venue, d, st, en, v in event_rows:
            if cfg.use_event_time:
                hit = (st is not None and st - before <= t <= st) or (en is not None and en <= t <= en + after)
                if cfg.cover_show and st is not None and en is not None:
                    hit = hit or st - before <= t <= en + after
            else:
                hit = d == date
            if hit:
                hits.append((km.get((venue, station), math.inf) if cfg.use_distance else 0.0, o, v))
        known = sorted((d, o, v) for d, o, v in hits if v is not None)
        if not hits:
            score = 0.0
        elif not cfg.use_attendance:
            score = 1 / (1 + min(h[0] for h in hits))
        elif not known:
            score = 0.5 / (1 + min(h[0] for h in hits))
        else:
            score = known[0][2] / (1 + known[0][0])
        out[station, date, hour] = score
    return out


@pytest.mark.parametrize("changes", [
    {}, {"use_attendance": False}, {"use_distance": False}, {"use_event_time": False}, {"cover_show": True},
    {"minutes_before": 20, "minutes_after": 45, "hours_before": 1}, {"hours_after": 0, "hours_before": 0},
    {"use_attendance": False, "use_distance": False},
])
def test_score_equals_range_join(spark, changes):
    cfg = CFG.with_(stations=("A", "B"), **changes)
    rng = random.Random(11)
    km = {(v, s): float(rng.randrange(1, 9)) for v in "uvw" for s in "AB"}
    day = dt.date(2021, 3, 1)
    event_rows = []
    for o in range(60):
        d = day + dt.timedelta(rng.randrange(12))
        st = None if rng.random() < 0.1 else T.combine(d, dt.time(rng.randrange(24), rng.choice([0, 0, 15, 40])))
        en = None if st is None or rng.random() < 0.3 else st + dt.timedelta(minutes=rng.choice([30, 90, 120, -300]))
        event_rows.append((o, rng.choice("uvwx"), d, st, en, None if rng.random() < 0.5 else rng.randrange(1, 9) / 8))
    hour_rows = [(s, day + dt.timedelta(i), h) for s in "AB" for i in range(14) for h in range(24)]
    out = planned_event(spark.createDataFrame(hour_rows, HOURS), spark.createDataFrame(event_rows, EVENTS),
                        distances(spark, [(v, s, d) for (v, s), d in km.items()]), cfg)
    found = {(r["station"], r["date"], r["hour"]): r["planned_event"] for r in out.collect()}
    expected = brute_score(hour_rows, event_rows, km, cfg)
    assert found == pytest.approx(expected)
    # With attendance and distance both off a score can only be 0 or 1.
    assert len(set(expected.values())) >= (2 if len(changes) == 2 and "use_distance" in changes else 3)
    assert all(0 <= v <= 1 for v in found.values())


def test_unknown_venue_never_hides_a_known_one(spark):
    cfg = CFG.with_(stations=("A",))
    rows = [(1, "mystery", dt.date(2021, 3, 1), T(2021, 3, 1, 20), None, 1.0),
            (2, "u", dt.date(2021, 3, 1), T(2021, 3, 1, 20), None, 0.5)]
    hour = spark.createDataFrame([("A", dt.date(2021, 3, 1), 20)], HOURS)
    out = planned_event(hour, spark.createDataFrame(rows, EVENTS), distances(spark, [("u", "A", 1.0)]), cfg)
    assert out.first()["planned_event"] == 0.25


# --- reports ---------------------------------------------------------------------------------

def brute_busy(values, per_mille):
    n = round(len(values) / 1000 * per_mille)
    return None if n == 0 else sorted(values)[-n:][0]


@pytest.mark.parametrize(("seed", "per_mille"), list(itertools.product(range(4), (1, 20, 125, 900))))
def test_busy_threshold_equals_sorting(spark, seed, per_mille):
    rng = random.Random(seed)
    groups = {
        "wide": [rng.randrange(10**rng.randrange(1, 8)) for _ in range(400)],
        "hot": [100] * 300 + [rng.randrange(95, 106) for _ in range(60)],
        "tiny": [rng.randrange(5) for _ in range(3)],
    }
    data = [(s, v) for s, vs in groups.items() for v in vs] + [("wide", None)]
    out = analysis.busy_threshold(spark.createDataFrame(data, "station string, check_outs bigint"), per_mille)
    found = {r["station"]: r["threshold"] for r in out.collect()}
    expected = {s: brute_busy(v, per_mille) for s, v in groups.items()}
    assert found == {s: v for s, v in expected.items() if v is not None}


def test_crowding_uses_published_lines_by_default(spark):
    df = spark.createDataFrame([("Centraal Station", 8845), ("Station Zuid", 5427), ("Elsewhere", 9)], "station string, n bigint")
    out = {r["station"]: r["crowded"] for r in analysis.crowding_flag(df, F.col("n")).collect()}
    assert out == {"Centraal Station": 1, "Station Zuid": 0, "Elsewhere": 0}


def test_peak_lead_counts_strict_running_maxima(spark):
    day = dt.date(2021, 3, 1)
    outs = {15: 9, 16: 50, 17: 40, 18: 60, 19: 60, 20: 30, 21: None}
    flow = spark.createDataFrame([("A", T.combine(day, dt.time(h)), v) for h, v in outs.items()],
                                 "station string, ts timestamp_ntz, check_outs bigint")
    counters = {r["slot"] % 24: r["counter"] for r in analysis.peak_counters(flow).collect()}
    # 20h: 30 < 60 (19h) -> 1 more; 18h equals, 17h lower. 21h: null, 30, 60, 60.
    assert counters[20] == 1 and counters[21] == 1 and counters[19] == 0
    assert 15 not in counters  # first hour of the station
    ev = spark.createDataFrame(
        [(T(2021, 3, 1, 20), 5.0), (T(2021, 3, 1, 20), 0.0), (T(2021, 3, 1, 19), 5.0), (T(2021, 3, 1, 20, 30), 5.0),
         (T(2021, 3, 2, 20), 5.0)], "start_ts timestamp_ntz, visitors double")
    r = analysis.peak_lead(flow, ev).first()
    assert (r["events"], r["mean_counter"]) == (2, 0.5)


# --- documents -------------------------------------------------------------------------------

@pytest.mark.parametrize(("text", "expected"), [
    ("Zaterdag 05 maart om 20:30 uur", T(2022, 3, 5, 20, 30)),
    ("05\n\n JAN. deuren 19.05", T(2022, 1, 5, 19, 5)),
    ("5 maart 20:30", None),
    ("05 maart, straks", None),
    ("20:30 op een dag", None),
    ("29 februari 20:30", None),
    ("10 juni 09:00 en 11 juli 10:00", T(2022, 6, 10, 9)),
    ("12 MRT 23:59", T(2022, 3, 12, 23, 59)),
    ("07 augustus 24:10 18:10", T(2022, 8, 7, 18, 10)),
])
def test_caption_datetime(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert with_caption_datetime(df, "t", "2022").first()["event_date"] == expected


def test_caption_clock_pattern_is_a_parameter(spark):
    df = spark.createDataFrame([("05 maart 20:30",)], "t string")
    assert with_caption_datetime(df, "t", "2022", clock_pattern=CLOCK_BEFORE_20).first()["event_date"] is None


def test_first_measures_link(spark):
    base = "https://www.ecdc.europa.eu/sites/default/files/documents/response_graphs_data_"
    html = f'<a href="{base}2021-12-20.csv">x</a> <a href="{base}2021-11-20.csv">y</a>'
    out = extract.link_extract(spark.createDataFrame([(html,), ("none",)], "html string")).collect()
    assert out[0]["first_link"] == base + "2021-12-20.csv"
    assert [r["n_links"] for r in out] == [2, 0]
    assert out[1]["first_link"] is None


def test_pages_of_drifting_shape(spark):
    texts = ['{"_embedded":{"events":[{"name":"a","id":1,"_embedded":{"venues":[{"name":"X","address":{"line1":"Lijnbaansgracht 238"}}]}},'
             '{"name":["b"],"dates":{"start":{"dateTime":"t"}}},{"name":null,"_embedded":{"venues":{"name":"Y"}}},7]}}',
             '{"page":1}', '{"_embedded":{"events":[]}}', "[1,", None, ""]
    out = extract.drifting_ticket_pages(spark.createDataFrame([(t,) for t in texts], "document string"))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([
        ("a", "Lovelee", None, ["id"], []), (None, None, "t", [], ["name"]), (None, "Y", None, [], []), (None, None, None, [], []),
        *[(None, None, None, [], ["document"])] * 3], key=repr)
