"""The registered queries in SQL that DuckDB runs on the same tables.

Written in another way than the operators where there is a choice: full joins instead of
tagged sums, range joins instead of hour lists, self joins instead of window frames.
"""

from __future__ import annotations

STATIONS = "['Centraal Station', 'Station Zuid', 'Station Bijlmer ArenA']"
VENUES = (
    "['Ziggo Dome', 'Endemol', 'AFAS Live', 'De Toekomst', 'Arena', 'Gaasperplas', 'Paradiso', "
    "'Afas Live', 'Olympisch Stadion', 'Melkweg', 'Royal Theater Carré', 'Beurs van Berlage', "
    "'Concertgebouw', 'De Waalse Kerk', 'Lovelee']")
ACCOUNTS = (
    "['ziggodome', 'paradisoadam', 'afaslive', 'johancruijffarena', 'melkwegamsterdam', "
    "'theatercarre', 'beursvanberlageofficial', 'concertgebouw', 'olympischstadion', 'newaccount']")
ACCOUNT_VENUES = (
    "['Ziggo Dome', 'Paradiso', 'Afas Live', 'Arena', 'Melkweg', 'Royal Theater Carré', "
    "'Beurs van Berlage', 'Concertgebouw', 'Olympisch Stadion', 'newaccount']")

# Geodesic kilometres to the three stations, from an independent computation.
DISTANCES = """
distance(venue, c, z, b) AS (VALUES
  ('Ziggo Dome', 7.7455, 5.2484, 0.7474), ('Endemol', 7.5024, 5.0067, 0.9640),
  ('AFAS Live', 8.0703, 5.7535, 0.2245), ('De Toekomst', 7.6253, 4.7965, 1.3287),
  ('Arena', 7.7533, 5.4615, 0.5050), ('Gaasperplas', 1.5183, 6.2205, 9.5569),
  ('Paradiso', 2.1834, 2.6092, 7.1225), ('Afas Live', 8.0807, 5.7600, 0.2219),
  ('Olympisch Stadion', 5.1262, 1.4413, 7.3603), ('Melkweg', 2.0680, 2.8278, 7.4522),
  ('Royal Theater Carré', 1.9034, 3.2733, 6.3745), ('Beurs van Berlage', 0.5398, 4.2211, 7.8844),
  ('Concertgebouw', 2.9258, 1.8841, 6.8360), ('De Waalse Kerk', 0.9377, 3.8366, 7.4527),
  ('Lovelee', 2.0375, 2.8402, 7.4278)),
km AS (
  SELECT venue, 'Centraal Station' AS station, CAST(c AS DOUBLE) AS distance_km FROM distance
  UNION ALL SELECT venue, 'Station Zuid', CAST(z AS DOUBLE) FROM distance
  UNION ALL SELECT venue, 'Station Bijlmer ArenA', CAST(b AS DOUBLE) FROM distance)
"""

# Easter Sundays as published.
EASTER = """
easter(d) AS (VALUES
  (DATE '1990-04-15'), (DATE '1991-03-31'), (DATE '1992-04-19'), (DATE '1993-04-11'),
  (DATE '1994-04-03'), (DATE '1995-04-16'), (DATE '1996-04-07'), (DATE '1997-03-30'),
  (DATE '1998-04-12'), (DATE '1999-04-04'), (DATE '2000-04-23'), (DATE '2001-04-15'),
  (DATE '2002-03-31'), (DATE '2003-04-20'), (DATE '2004-04-11'), (DATE '2005-03-27'),
  (DATE '2019-04-21'), (DATE '2020-04-12'), (DATE '2021-04-04'), (DATE '2022-04-17'),
  (DATE '2023-04-09'), (DATE '2024-03-31'), (DATE '2025-04-20'), (DATE '2026-04-05'))
"""


def _holidays(years: str) -> str:
    return EASTER + f""",
hyear AS ({years}),
heaster AS (SELECT y, d FROM hyear JOIN easter ON year(d) = y),
holiday AS (
  SELECT make_date(y, 1, 1) AS date, 'New year' AS holiday FROM hyear
  UNION ALL SELECT d - 2, 'Good Friday' FROM heaster
  UNION ALL SELECT d, 'Easter Sunday' FROM heaster
  UNION ALL SELECT d + 1, 'Easter Monday' FROM heaster
  UNION ALL SELECT CASE WHEN y >= 2014
      THEN CASE WHEN isodow(make_date(y, 4, 27)) = 7 THEN make_date(y, 4, 26) ELSE make_date(y, 4, 27) END
      ELSE CASE WHEN isodow(make_date(y, 4, 30)) = 7 THEN make_date(y, 4, 29) ELSE make_date(y, 4, 30) END
    END, 'King''s day' FROM hyear
  UNION ALL SELECT make_date(y, 5, 5), 'Liberation Day' FROM hyear
  UNION ALL SELECT d + 39, 'Ascension Thursday' FROM heaster
  UNION ALL SELECT d + 49, 'Whit Sunday' FROM heaster
  UNION ALL SELECT d + 50, 'Whit Monday' FROM heaster
  UNION ALL SELECT make_date(y, 12, 25), 'Christmas Day' FROM hyear
  UNION ALL SELECT make_date(y, 12, 26), 'Boxing Day' FROM hyear)
"""


HOLIDAYS = _holidays("SELECT DISTINCT year(ts) AS y FROM events")

# --- flows -----------------------------------------------------------------------------

FLOWS = f"""
trip AS (
  SELECT DISTINCT event_type IN ('view', 'click') AS is_in, CAST(ts AS DATE) AS d, hour(ts) AS h,
         user_id, CAST(round(value * 100) AS BIGINT) AS n
  FROM events),
ins AS (SELECT d, h, user_id % 3 AS s, CAST(SUM(n) AS BIGINT) AS n FROM trip WHERE is_in GROUP BY ALL),
outs AS (SELECT d, h, user_id % 3 AS s, CAST(SUM(n) AS BIGINT) AS n FROM trip WHERE NOT is_in GROUP BY ALL),
pair AS (
  SELECT COALESCE(i.d, o.d) AS date, COALESCE(i.h, o.h) AS h, COALESCE(i.s, o.s) AS s,
         i.n AS check_ins, o.n AS check_outs
  FROM ins i FULL JOIN outs o ON i.d = o.d AND i.h = o.h AND i.s = o.s),
flow AS (
  SELECT {STATIONS}[s + 1] AS station, date, CAST(h AS INTEGER) AS hour, check_ins, check_outs,
         CAST(date AS TIMESTAMP) + to_hours(CAST(h AS BIGINT)) AS ts,
         CAST(weekofyear(date) AS INTEGER) AS week, CAST(month(date) AS INTEGER) AS month,
         CAST(year(date) AS INTEGER) AS year, CAST(isodow(date) - 1 AS INTEGER) AS weekday
  FROM pair)
"""
HOURLY = """
SELECT station, date, printf('%02d:00 - %02d:59', hour, hour) AS hour_band, check_ins, check_outs FROM flow
"""

# --- side tables -----------------------------------------------------------------------

_READINGS = {
    "wind_direction": ("event_id % 360", 1), "wind_speed_h": ("user_id % 50", 1),
    "wind_speed": ("event_id % 120", 10), "wind_gust": ("event_id % 200", 10),
    "temperature": ("round(value * 10)", 10),
    "temperature_min": ("CASE WHEN event_id % 5 <> 0 THEN round(value * 10) - 5 END", 10),
    "dew_point_temperature": ("round(value * 10) - 30", 10), "radiation_duration": ("event_id % 11", 10),
    "global_radiation": ("event_id % 300", 1), "precipitation_duration": ("event_id % 10", 10),
    "precipitation_h": ("event_id % 40", 10), "pressure": ("10000 + event_id % 300", 10),
    "sight": ("event_id % 80", 1), "cloud_cover": ("event_id % 9", 1),
    "relative_humidity": ("50 + event_id % 50", 1), "weather_index": ("event_id % 7", 1),
    "fog": ("event_id % 2", 1), "rain": ("event_id % 3", 1), "snow": ("user_id % 2", 1),
    "thunder": ("user_id % 3", 1), "ice": ("(event_id + user_id) % 2", 1),
}
# Of several readings for an hour the newest is valid. The data lies in winter time: UTC + 1 hour.
OBSERVED = f"""
reading AS (
  SELECT date_trunc('hour', ts) AS utc, event_id % 100 AS weather_code,
         {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, (e, _) in _READINGS.items())}
  FROM events WHERE user_id % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id DESC) = 1),
observed AS (
  SELECT CAST(utc + INTERVAL 1 HOUR AS DATE) AS date, CAST(hour(utc + INTERVAL 1 HOUR) AS INTEGER) AS hour,
         {", ".join(f"avg({n}) / {d} AS {n}" for n, (_, d) in _READINGS.items())}
  FROM reading GROUP BY 1, 2)
"""

_PREDICTED = {
    "wind_direction": "CAST(event_id % 360 AS DOUBLE)", "relative_humidity": "CAST(event_id % 100 AS DOUBLE)",
    "pressure": "CAST(1000 + event_id % 30 AS DOUBLE)", "temperature": "value",
    "wind_speed": "CAST(event_id % 25 AS DOUBLE)", "sight_m": "CAST(event_id % 9000 AS DOUBLE)",
    "precipitation_h": "CASE WHEN event_id % 50 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END",
    "global_radiation": "CAST(event_id % 800 AS DOUBLE)", "clouds": "CAST(event_id % 101 AS DOUBLE)",
}


def _predicted(loc: str, ahead: int = 0) -> str:
    values = ", ".join(_PREDICTED)
    return f"""
given AS (
  SELECT {loc} AS loc,
         date_trunc('hour', ts) + INTERVAL {ahead} DAYS + CASE WHEN event_id % 2 = 0 THEN INTERVAL 60 MINUTES
                                       ELSE INTERVAL 90 MINUTES END AS t,
         event_id % 5 AS offset_h, {", ".join(f"{e} AS {n}" for n, e in _PREDICTED.items())}
  FROM events),
best AS (
  SELECT * FROM given QUALIFY row_number() OVER (
    PARTITION BY loc, t ORDER BY offset_h, {", ".join(f"{n} NULLS FIRST" for n in _PREDICTED)}) = 1),
span AS (SELECT loc, min(t) AS a, date_trunc('hour', max(t)) AS b FROM best GROUP BY loc),
hours AS (SELECT loc, unnest(generate_series(date_trunc('hour', a), b, INTERVAL 1 HOUR)) AS h FROM span),
ahead AS (
  SELECT h.loc, h.h + INTERVAL 1 HOUR AS local, {values}
  FROM hours h ASOF JOIN best g ON h.loc = g.loc AND h.h >= g.t
  WHERE h.h <= g.t + INTERVAL 11 HOURS),
predicted AS (
  SELECT loc, CAST(local AS DATE) AS date, CAST(hour(local) AS INTEGER) AS hour, {values},
         clouds / 12.5 AS cloud_cover, sight_m / 333 AS sight
  FROM ahead)
"""


MEASURES = """
span_m AS (
  SELECT DISTINCT user_id % 5 AS k,
         CAST(date_trunc('week', ts) AS DATE) + CAST(user_id % 5 AS INTEGER) AS a,
         CASE WHEN (SELECT max(CAST(ts AS DATE)) FROM events) - CAST(date_trunc('week', ts) AS DATE) > 7
              THEN CAST(date_trunc('week', ts) AS DATE) + CAST(user_id % 5 + user_id % 5 % 3 AS INTEGER)
              ELSE (SELECT max(CAST(ts AS DATE)) + 15 FROM events) END AS b
  FROM events WHERE event_id % 4 <> 0),
day_m AS (SELECT k, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span_m),
measure AS (
  SELECT date, CAST(max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS INTEGER) AS measure_0,
         CAST(max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS INTEGER) AS measure_1,
         CAST(max(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS INTEGER) AS measure_2,
         CAST(max(CASE WHEN k = 3 THEN 1 ELSE 0 END) AS INTEGER) AS measure_3,
         CAST(max(CASE WHEN k = 4 THEN 1 ELSE 0 END) AS INTEGER) AS measure_4
  FROM day_m GROUP BY date)
"""
CASES = """
cases AS (
  SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS cases,
         CAST(count(*) FILTER (WHERE value > 100) AS DOUBLE) AS deaths
  FROM events WHERE user_id % 2 = 0 GROUP BY 1)
"""
STRINGENCY = """
daily_s AS (
  SELECT CAST(ts AS DATE) AS date,
         CAST(SUM(CAST(round(value * 100) AS BIGINT)) % 100 AS DOUBLE) AS stringency
  FROM events WHERE user_id % 2 = 0 AND day(ts) <> 13 GROUP BY 1),
stringency AS (
  SELECT * FROM daily_s
  UNION ALL
  SELECT CAST(l.date + CAST(n AS INTEGER) AS DATE), l.stringency
  FROM (SELECT * FROM daily_s ORDER BY date DESC LIMIT 1) l, range(1, 14) r(n))
"""
VACATIONS = """
range_v AS (
  SELECT date_trunc('week', ts) AS w, user_id % 4 AS region, min(CAST(ts AS DATE)) AS a, count(*) AS n
  FROM events GROUP BY 1, 2),
vacation AS (
  SELECT DISTINCT date FROM (
    SELECT a + 1 + CAST(unnest(range(n % 3 + 1)) AS INTEGER) AS date FROM range_v WHERE region IN (0, 3)
    UNION ALL SELECT DATE '2019-01-01' + CAST(i AS INTEGER) FROM range(6) r(i)
    UNION ALL SELECT DATE '2019-02-16' + CAST(i AS INTEGER) FROM range(9) r(i)
    UNION ALL SELECT DATE '2019-04-27' + CAST(i AS INTEGER) FROM range(9) r(i)
    UNION ALL SELECT DATE '2019-07-13' + CAST(i AS INTEGER) FROM range(44) r(i)))
"""

# --- venue events ----------------------------------------------------------------------

def _venue_events(ahead: int = 0) -> str:
    return f"""
started AS (
  SELECT * REPLACE (ts + INTERVAL {ahead} DAYS AS ts),
         CASE WHEN user_id % 2 = 0 THEN date_trunc('hour', ts) ELSE date_trunc('minute', ts) END
         + INTERVAL {ahead} DAYS AS st FROM events),
perf AS (
  SELECT event_id AS o, {VENUES}[user_id % 15 + 1] AS venue, CAST(ts AS DATE) AS d, st,
         CASE WHEN user_id % 5 <> 0 THEN st + INTERVAL 2 HOURS END AS en,
         CASE WHEN user_id % 4 <> 0 THEN value END AS visitors
  FROM started),
share AS (SELECT * EXCLUDE visitors, visitors / (SELECT max(visitors) FROM perf) AS v FROM perf)
"""


VENUE_EVENTS = _venue_events()
ATTENDANCE = """CASE WHEN b.v IS NULL THEN CAST(0.5 AS DOUBLE) / (1 + n.km) ELSE b.v / (1 + b.km) END"""
PRESENCE = "CAST(1 AS DOUBLE) / (1 + n.km)"


def _score(rows: str, matches: tuple[str, ...], score: str, km: str = "k.distance_km") -> str:
    """Range joins of hour rows and events, ranked per row. An event may hit twice: that
    changes neither the least distance nor the best event."""
    hits = " UNION ALL ".join(f"""
  SELECT f.station, f.date, f.hour, s.o, s.v, {km} AS km
  FROM {rows} f JOIN share s ON {match} JOIN km k ON k.venue = s.venue AND k.station = f.station""" for match in matches)
    best = "" if score == PRESENCE else _BEST
    return f"""
hit AS MATERIALIZED ({hits}),
near AS (SELECT station, date, hour, min(km) AS km FROM hit GROUP BY ALL),{best}
score AS (
  SELECT station, date, hour, {score} AS planned_event
  FROM near n {"LEFT JOIN best_v b USING (station, date, hour)" if best else ""})
"""


_BEST = """
best_v AS (
  SELECT station, date, hour, v, km FROM hit WHERE v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY station, date, hour ORDER BY km, o) = 1),"""
HOURS_MATCH = ("f.ts >= s.st - INTERVAL 3 HOURS AND f.ts <= s.st",
               "f.ts >= s.en AND f.ts <= s.en + INTERVAL 3 HOURS")
DAY_MATCH = ("f.date = s.d",)
SCORE_OUT = """
SELECT station, date, hour, round(COALESCE(planned_event, 0), 9) + 0.0 AS planned_event
FROM flow LEFT JOIN score USING (station, date, hour)
"""

SHEET = f"""
bought AS (
  SELECT *, {VENUES}[user_id % 15 + 1] AS venue, printf('%02d', hour(ts)) AS hh,
         printf('%02d', (hour(ts) + 2) % 24) AS h2 FROM events),
sheet AS (
  SELECT event_id AS ord,
    CASE WHEN event_id % 23 = 0 THEN 'Niet bijzonder evenementen zijn hierboven niet meegenomen.'
         WHEN event_id % 37 = 0 THEN CAST(CAST(ts AS DATE) - 2200 AS VARCHAR) || ' 00:00:00'
         ELSE CAST(CAST(ts AS DATE) AS VARCHAR) || ' 00:00:00' END AS Datum,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'Overig'
         WHEN event_id % 4 = 0 THEN ' ' || called || '  ' ELSE called END AS Locatie,
    'Event ' || event_id AS "Naam evenement",
    CASE WHEN event_id % 29 <> 0 THEN pre || hh || ':00:00' END AS "Start show",
    CASE WHEN event_id % 5 = 0 THEN 'onbekend' ELSE pre || h2 || ':00:00' END AS "Einde show",
    CASE WHEN user_id % 4 <> 0 THEN value END AS "Aantal bezoekers"
  FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN '1899-12-30 ' ELSE '' END AS pre,
               CASE WHEN venue <> 'Ziggo Dome' THEN venue WHEN event_id % 2 = 0 THEN 'Ziggo dome'
                    ELSE 'Ziggo Dome (2x)' END AS called
        FROM bought WHERE event_id % 31 <> 0)),
cleaned AS (
  SELECT * FROM sheet WHERE Datum NOT LIKE 'Niet bijzonder%' AND Locatie IS NOT NULL
    AND Locatie <> 'Overig' AND "Start show" IS NOT NULL),
timed AS (
  SELECT *, CAST(substr(Datum, 1, 10) AS DATE) AS date,
         substr(replace("Start show", '1899-12-30 ', ''), 1, 5) AS start_show,
         TRY_CAST(substr(Datum, 1, 10) || ' ' || substr(replace("Start show", '1899-12-30 ', ''), 1, 5) || ':00'
                  AS TIMESTAMP) AS start_ts,
         TRY_CAST(substr(Datum, 1, 10) || ' ' || substr(replace("Einde show", '1899-12-30 ', ''), 1, 5) || ':00'
                  AS TIMESTAMP) AS end_ts
  FROM cleaned)
"""
UNIFIED = SHEET + f""",
all_events AS (
  SELECT 0 AS source_rank, ord,
         CASE WHEN trim(Locatie) IN ('Ziggo dome', 'Ziggo Dome (2x)') THEN 'Ziggo Dome' ELSE trim(Locatie) END AS venue,
         "Naam evenement" AS event_name, date, start_show, start_ts, end_ts, "Aantal bezoekers" AS visitors
  FROM timed WHERE year(date) >= 2019
  UNION ALL
  SELECT 1, event_id, {ACCOUNT_VENUES}[user_id % 10 + 1], NULL, CAST(ts AS DATE), hh || ':00',
         date_trunc('hour', ts), NULL, NULL FROM bought
  UNION ALL
  SELECT 2, event_id, venue, 'Show ' || event_id, CAST(ts + INTERVAL 1 HOUR AS DATE),
         printf('%02d:00', (hour(ts) + 1) % 24), date_trunc('hour', ts) + INTERVAL 1 HOUR, NULL, NULL
  FROM bought
  UNION ALL
  SELECT 3, i, 'Arena', NULL, d, NULL, NULL, NULL, NULL FROM (VALUES
    (0, DATE '2020-01-19'), (1, DATE '2020-02-02'), (2, DATE '2020-02-16'), (3, DATE '2020-01-03'),
    (4, DATE '2021-06-13'), (5, DATE '2021-06-17'), (6, DATE '2021-06-21'), (7, DATE '2021-06-26')) m(i, d)),
united AS (
  SELECT * FROM all_events
  QUALIFY row_number() OVER (PARTITION BY venue, date, start_show ORDER BY source_rank, ord) = 1)
"""

# --- features --------------------------------------------------------------------------

WEEK_AGO = """
exact AS (
  SELECT station, date + 7 AS date, hour, avg(check_ins) AS ci, avg(check_outs) AS co, count(*) AS n
  FROM {history} GROUP BY ALL),
weekly AS (
  SELECT station, year, week, hour, avg(check_ins) AS ci, avg(check_outs) AS co
  FROM {history} GROUP BY ALL),
lagged AS (
  SELECT f.station, f.date, f.hour,
         CASE WHEN e.n > 0 THEN e.ci ELSE w.ci END AS check_ins_week_ago,
         CASE WHEN e.n > 0 THEN e.co ELSE w.co END AS check_outs_week_ago
  FROM {rows} f
  LEFT JOIN exact e ON e.station = f.station AND e.date = f.date AND e.hour = f.hour
  LEFT JOIN weekly w ON w.station = f.station AND w.year = f.year AND w.week = f.week AND w.hour = f.hour)
"""
_W = list(_READINGS)
ENRICHED_CTES = ",".join([
    FLOWS, OBSERVED, STRINGENCY, MEASURES, CASES, VACATIONS, HOLIDAYS, VENUE_EVENTS, DISTANCES,
    _score("flow", HOURS_MATCH, ATTENDANCE)]) + f""",
rich AS (
  SELECT f.*, {", ".join(f"round(w.{n}, 6) + 0.0 AS {n}" for n in _W)},
         round(COALESCE(s.stringency, 0), 6) + 0.0 AS stringency,
         CAST(f.date IN (SELECT date FROM holiday) AS INTEGER) AS holiday,
         CAST(f.date IN (SELECT date FROM vacation) AS INTEGER) AS vacation,
         round(COALESCE(p.planned_event, 0), 6) + 0.0 AS planned_event,
         {", ".join(f"COALESCE(m.measure_{i}, 0) AS measure_{i}" for i in range(5))},
         COALESCE(c.cases, 0) AS cases, COALESCE(c.deaths, 0) AS deaths
  FROM flow f
  LEFT JOIN observed w ON w.date = f.date AND w.hour = f.hour
  LEFT JOIN stringency s ON s.date = f.date
  LEFT JOIN score p ON p.station = f.station AND p.date = f.date AND p.hour = f.hour
  LEFT JOIN measure m ON m.date = f.date
  LEFT JOIN cases c ON c.date = f.date)
"""
_MODEL = [
    "year", "month", "weekday", "holiday", "vacation", "temperature", "wind_speed", "precipitation_h",
    "global_radiation", "check_ins_week_ago", "check_outs_week_ago", "stringency", "cases", "deaths",
    *[f"measure_{i}" for i in range(5)], "planned_event"]
MATRIX = "WITH " + ENRICHED_CTES + "," + WEEK_AGO.format(history="flow", rows="flow") + f""",
wide AS (
  SELECT r.*, round(l.check_ins_week_ago, 6) + 0.0 AS check_ins_week_ago,
         round(l.check_outs_week_ago, 6) + 0.0 AS check_outs_week_ago
  FROM rich r JOIN lagged l USING (station, date, hour))
SELECT station, date, hour, {", ".join(_MODEL)}, check_ins, check_outs FROM wide
WHERE check_ins IS NOT NULL AND check_outs IS NOT NULL
  AND {" AND ".join(f"{c} IS NOT NULL" for c in _MODEL)}
"""
FUTURE_CTES = "WITH " + ",".join([
    FLOWS, _predicted("'city'", 7), STRINGENCY, MEASURES, CASES, VACATIONS,
    _holidays("SELECT DISTINCT unnest([year(ts), year(ts + INTERVAL 7 DAYS)]) AS y FROM events"), _venue_events(7), DISTANCES,
]) + f""",
past AS (SELECT * FROM flow),
grid AS (
  SELECT station, h AS ts, CAST(h AS DATE) AS date, CAST(hour(h) AS INTEGER) AS hour,
         CAST(weekofyear(h) AS INTEGER) AS week, CAST(month(h) AS INTEGER) AS month,
         CAST(year(h) AS INTEGER) AS year, CAST(isodow(h) - 1 AS INTEGER) AS weekday
  FROM (SELECT DISTINCT station FROM past),
       (SELECT CAST(max(CAST(ts AS DATE)) + 1 AS TIMESTAMP) + to_hours(n) AS h
        FROM events, range(168) r(n) GROUP BY n)),
{_score("grid", HOURS_MATCH, ATTENDANCE)},
{WEEK_AGO.format(history="past", rows="grid")},
top AS (SELECT max(hour) AS hm, max(month) AS mm, max(weekday) AS wm FROM grid)
"""
FUTURE = FUTURE_CTES + f"""
SELECT g.station, g.date, g.hour, g.week, g.month, g.year, g.weekday,
       round(cos(2 * pi() * g.hour / hm), 6) + 0.0 AS cos_hour, round(sin(2 * pi() * g.hour / hm), 6) + 0.0 AS sin_hour,
       round(cos(2 * pi() * g.month / mm), 6) + 0.0 AS cos_month,
       round(sin(2 * pi() * g.month / mm), 6) + 0.0 AS sin_month,
       round(cos(2 * pi() * g.weekday / wm), 6) + 0.0 AS cos_weekday,
       round(sin(2 * pi() * g.weekday / wm), 6) + 0.0 AS sin_weekday,
       CAST(g.hour IN (7, 8, 17, 18) AS INTEGER) AS peak_period,
       CAST(g.date IN (SELECT date FROM holiday) AS INTEGER) AS holiday,
       CAST(g.date IN (SELECT date FROM vacation) AS INTEGER) AS vacation,
       round(COALESCE(p.planned_event, 0), 6) + 0.0 AS planned_event,
       round(w.temperature, 6) AS temperature, round(w.wind_speed, 6) AS wind_speed,
       round(w.precipitation_h, 6) AS precipitation_h, round(w.global_radiation, 6) AS global_radiation,
       round(w.cloud_cover, 6) AS cloud_cover, round(w.sight, 6) AS sight,
       (SELECT arg_max(stringency, date) FROM stringency) AS stringency,
       {", ".join(f"COALESCE(m.measure_{i}, (SELECT arg_max(measure_{i}, date) FROM measure)) AS measure_{i}"
                  for i in range(5))},
       round(l.check_ins_week_ago, 6) + 0.0 AS check_ins_week_ago,
       round(l.check_outs_week_ago, 6) + 0.0 AS check_outs_week_ago,
       COALESCE(c.cases, (SELECT arg_max(cases, date) FROM cases)) AS cases,
       COALESCE(c.deaths, (SELECT arg_max(deaths, date) FROM cases)) AS deaths
FROM grid g CROSS JOIN top
JOIN lagged l ON l.station = g.station AND l.date = g.date AND l.hour = g.hour
LEFT JOIN score p ON p.station = g.station AND p.date = g.date AND p.hour = g.hour
LEFT JOIN predicted w ON w.date = g.date AND w.hour = g.hour
LEFT JOIN measure m ON m.date = g.date
LEFT JOIN cases c ON c.date = g.date
"""

# --- metrics ---------------------------------------------------------------------------

METRICS = """
guess AS (
  SELECT station, run, check_ins AS a, check_outs AS b,
         CASE WHEN run = 'fair' THEN check_ins - 10 * hour ELSE 5000 END AS pa,
         CASE WHEN run = 'fair' THEN check_outs - 10 * hour ELSE 5000 END AS pb
  FROM flow, (VALUES ('fair'), ('flat')) r(run)
  WHERE check_ins IS NOT NULL AND check_outs IS NOT NULL),
mean AS (SELECT station, run, avg(a) AS ma, avg(b) AS mb FROM guess GROUP BY ALL),
metric AS (
  SELECT g.station, g.run, count(*) AS n,
         ((1 - SUM(CAST(a - pa AS DOUBLE) * (a - pa)) / SUM((a - ma) * (a - ma)))
          + (1 - SUM(CAST(b - pb AS DOUBLE) * (b - pb)) / SUM((b - mb) * (b - mb)))) / 2 AS r2,
         (avg(abs(a - pa)) + avg(abs(b - pb))) / 2 AS mae,
         sqrt((avg(CAST(a - pa AS DOUBLE) * (a - pa)) + avg(CAST(b - pb AS DOUBLE) * (b - pb))) / 2) AS rmse
  FROM guess g JOIN mean m ON m.station = g.station AND m.run = g.run GROUP BY ALL)
"""
_METRIC_OUT = "SELECT station, run, n, round(r2, 6) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM metric"
_SETTINGS = """
true AS "IncludeInstagramEvents", true AS "IncludeTicketmasterEvents", true AS "UseNormalizedVisitors",
true AS "UseEventStationDistance", true AS "UseTimeOfEvents", {before} AS "MaxHoursBeforeEvent",
0 AS "MaxMinutesBeforeEvent", 3 AS "MaxHoursAfterEvent", 0 AS "MaxMinutesAfterEvent",
true AS "UseCOVIDStringency", true AS "UseCOVIDMeasures", true AS "UseCOVIDCases", true AS "UseCOVIDDeaths",
round_even(r2, 3) AS "R-squared", round_even(mae, 3) AS "MAE", round_even(rmse, 3) AS "RMSE",
{on} AS "Global radiation", {on} AS "Check-ins week ago", {on} AS "Check-outs week ago"
"""


def _log(run: str, before: int, on: str, more: str = "") -> str:
    settings = _SETTINGS.format(before=before, on=on)
    return f"""SELECT station AS "Station", 'RandomForestRegressor' AS "Model", {settings}{more and ", " + more} FROM metric WHERE run = '{run}'"""


BUSY = """
ranked AS (
  SELECT station, check_outs, row_number() OVER (PARTITION BY station ORDER BY check_outs DESC) AS r,
         CAST(round_even(CAST(count(*) OVER (PARTITION BY station) AS DOUBLE) / 1000 * 20, 0) AS BIGINT) AS top_rows
  FROM flow WHERE check_outs IS NOT NULL),
busy AS (SELECT station, min(check_outs) AS threshold, min(top_rows) AS top_rows
         FROM ranked WHERE r <= top_rows GROUP BY station)
"""
PEAK = """
counter AS (
  SELECT f.station, f.ts,
         list_reduce(
           [{'c': -1, 'm': CAST(0 AS BIGINT)}] || [{'c': 0, 'm': COALESCE(x, 0)} FOR x IN
             [f.check_outs, b1.check_outs, b2.check_outs, b3.check_outs]],
           lambda s, x: {'c': s.c + CASE WHEN x.m > s.m THEN 1 ELSE 0 END, 'm': greatest(s.m, x.m)}).c AS c
  FROM flow f
  LEFT JOIN flow b1 ON b1.station = f.station AND b1.ts = f.ts - INTERVAL 1 HOUR
  LEFT JOIN flow b2 ON b2.station = f.station AND b2.ts = f.ts - INTERVAL 2 HOURS
  LEFT JOIN flow b3 ON b3.station = f.station AND b3.ts = f.ts - INTERVAL 3 HOURS
  WHERE f.ts > (SELECT min(ts) FROM flow g WHERE g.station = f.station))
"""

_LONG = ("['januari', 'februari', 'maart', 'april', 'mei', 'juni', 'juli', 'augustus', 'september', "
         "'oktober', 'november', 'december']")
_SHORT = "['JAN', 'FEB', 'MRT', 'APR', 'MEI', 'juni', 'juli', 'AUG', 'SEP', 'OKT', 'NOV', 'DEC']"
CAPTIONS = f"""
captioned AS (
  SELECT *, CASE event_id % 4
      WHEN 0 THEN 'Show op ' || dd || ' ' || {_LONG}[event_id % 12 + 1] || ' om ' || hh || ':' || mi
                  || ' uur, of 31 dec 23:59'
      WHEN 1 THEN dd || chr(10) || {_SHORT}[event_id % 12 + 1] || '. Deuren ' || hh || '.' || mi
      WHEN 2 THEN 'Vanaf ' || hh || ':' || mi || ' open'
      ELSE '31 feb om ' || hh || ':' || mi END AS caption,
    CASE WHEN event_id % 4 < 2 THEN make_timestamp(
        {{year}}, event_id % 12 + 1, 1 + event_id % 28, hour(ts), minute(ts), 0) END AS event_date
  FROM (SELECT *, printf('%02d', 1 + event_id % 28) AS dd, strftime(ts, '%H') AS hh, strftime(ts, '%M') AS mi
        FROM events))
"""

# One-hot columns of hours and weekdays.
_HOTS = ", ".join(
    [f"CAST(hour = {h} AS INTEGER) AS hour_{h}" for h in range(24)]
    + [f"CAST(weekday = {d} AS INTEGER) AS weekday_{d}" for d in range(7)])

_KINDS = ["click", "error", "purchase", "signup", "view"]
_OPTIONS = [  # option, activity that switches it
    ("useNormalizedVisitors:true", "purchase"), ("useEventStationDistance:true", "signup"),
    ("includeInstagramEvents:true", "click"), ("includeTicketmasterEvents:true", "error"),
    ("useTimeOfEvents:true", "view")]


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


_TRIPS = f"""
SELECT CAST(ts AS DATE) AS date, strftime(ts, '%H') || ':00 - ' || strftime(ts, '%H') || ':59' AS hour_band,
       'S' || user_id AS stop_code, {STATIONS}[user_id % 3 + 1] AS station,
       CAST(round(value * 100) AS BIGINT) AS trips
FROM events"""


_TICKET_PAGES = f"""
SELECT DISTINCT 'Show ' || event_id % 50 AS name,
       CASE event_id % 7 WHEN 0 THEN 'Lovelee' WHEN 1 THEN 'Melkweg' ELSE {VENUES}[user_id % 15 + 1] END AS venue,
       strftime(ts, '%Y-%m-%dT%H:00:00Z') AS datetime
FROM events WHERE event_id % 13 <> 0"""
# Model features that may be missing; counts, events and indicators never are.
_WEATHER_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in ("temperature", "wind_speed", "precipitation_h", "global_radiation"))


def _waves(digits: int) -> str:
    return ", ".join(
        f"round({fn}(2 * pi() * {p} / m{p}), {digits}) + 0.0 AS {fn}_{p}"
        for p in ("hour", "month", "weekday") for fn in ("cos", "sin"))


_WEATHER_ROWS = f"""
            SELECT CAST(CAST(ts AS DATE) AS VARCHAR) || 'T00:00:00.000Z' AS date,
                   CAST(hour(ts) + 1 AS INTEGER) AS hour,
                   CASE WHEN user_id % 2 = 0 THEN '240' ELSE '260' END AS station_code,
                   CAST(event_id % 100 AS DOUBLE) AS "WW",
                   {", ".join(f'CAST({e} AS DOUBLE) AS "{code}"' for code, (e, _) in zip(
                       "DD FH FF FX T T10N TD SQ Q DR RH P VV N U IX M R S O Y".split(),
                       _READINGS.values(), strict=True))}
            FROM events"""


def oracle_sql() -> dict[str, str]:
    flow = _with(FLOWS)
    score = [FLOWS, VENUE_EVENTS, DISTANCES]
    stop_side = """
      SELECT d, flag, code, s, CAST(SUM(q) AS BIGINT) AS n FROM (
        SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_returnflag AS flag,
               CAST(nullif(l_linenumber, 3) AS VARCHAR) AS code, l_suppkey % 3 AS s, CAST(l_quantity AS BIGINT) AS q
        FROM lineitem WHERE l_linestatus = '{}') GROUP BY ALL"""
    split_age = "datediff('day', date, max(date) OVER (PARTITION BY station))"
    complete = "check_ins IS NOT NULL AND check_outs IS NOT NULL"
    return {
        "dedup_rows": "SELECT DISTINCT * FROM (SELECT * FROM events UNION ALL SELECT * FROM events)",
        "hourly_flows": flow + HOURLY,
        "station_slice": flow + HOURLY + " WHERE station = 'Station Zuid'",
        "stop_flows": f"""
            WITH i AS ({stop_side.format('O')}), o AS ({stop_side.format('F')})
            SELECT COALESCE(i.d, o.d) AS date, COALESCE(i.flag, o.flag) AS hour_band,
                   COALESCE(i.code, o.code) AS stop_code, {STATIONS}[COALESCE(i.s, o.s) + 1] AS station,
                   i.n AS check_ins, o.n AS check_outs
            FROM i FULL JOIN o ON i.d = o.d AND i.flag = o.flag AND i.s = o.s
              AND COALESCE(i.code, '-') = COALESCE(o.code, '-')""",
        "stop_types": """
            SELECT l_suppkey AS stop_code, count(*) AS trips, n_name AS type
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
            GROUP BY l_suppkey, n_name""",
        "missing_profile": flow + """
            SELECT station, count(*) AS n_rows,
                   count(*) FILTER (WHERE check_ins IS NULL AND check_outs IS NOT NULL) AS only_ins_missing,
                   count(*) FILTER (WHERE check_ins IS NOT NULL AND check_outs IS NULL) AS only_outs_missing,
                   count(*) FILTER (WHERE check_ins IS NULL AND check_outs IS NULL) AS both_missing,
                   count(*) FILTER (WHERE check_ins IS NOT NULL AND check_outs IS NOT NULL) AS complete
            FROM flow GROUP BY station""",
        "training_rows": flow + f"SELECT * FROM flow WHERE {complete}",
        "calendar_features": flow + "SELECT * FROM flow",
        "one_hot": flow + f"SELECT station, date, hour, check_ins, check_outs, weekday, {_HOTS} FROM flow",
        "peak_period": flow + """
            SELECT station, date, hour, check_ins, check_outs,
                   CASE WHEN hour IN (7, 8, 17, 18) THEN 1 ELSE 0 END AS peak_period FROM flow""",
        "cyclic_features": flow + f"""
            SELECT station, date, hour, {_waves(9)} FROM flow,
                   (SELECT max(hour) AS mhour, max(month) AS mmonth, max(weekday) AS mweekday FROM flow)""",
        "calendar_flags": _with(FLOWS, HOLIDAYS, VACATIONS) + """
            SELECT station, date, hour, CAST(date IN (SELECT date FROM holiday) AS INTEGER) AS holiday,
                   CAST(date IN (SELECT date FROM vacation) AS INTEGER) AS vacation FROM flow""",
        "holiday_calendar": _with(_holidays("SELECT DISTINCT year(o_orderdate) AS y FROM orders"))
        + "SELECT * FROM holiday",
        "vacation_calendar": _with(VACATIONS) + "SELECT date FROM vacation",
        "future_grid": f"""
            WITH s AS (SELECT DISTINCT {STATIONS}[user_id % 3 + 1] AS station FROM events),
            a AS (SELECT CAST(CAST(max(ts) AS DATE) + 1 AS TIMESTAMP) AS a FROM events),
            g AS (SELECT station, a + to_hours(n) AS ts FROM s, a, range(168) r(n))
            SELECT station, ts, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
                   CAST(weekofyear(ts) AS INTEGER) AS week, CAST(month(ts) AS INTEGER) AS month,
                   CAST(year(ts) AS INTEGER) AS year, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM g""",
        "measures_daily": _with(MEASURES) + "SELECT * FROM measure",
        "cases_deaths": _with(CASES) + "SELECT * FROM cases",
        "stringency_series": _with(STRINGENCY) + "SELECT * FROM stringency",
        "fill_from_latest": _with(FLOWS, CASES) + """,
            known AS (SELECT * FROM cases WHERE (SELECT max(CAST(ts AS DATE)) FROM events) - date > 10),
            last AS (SELECT * FROM known ORDER BY date DESC LIMIT 1)
            SELECT f.station, f.date, f.hour, COALESCE(k.cases, l.cases) AS cases,
                   COALESCE(k.deaths, l.deaths) AS deaths
            FROM flow f LEFT JOIN known k ON k.date = f.date CROSS JOIN last l""",
        "weather_history": _with(OBSERVED) + "SELECT * FROM observed",
        "weather_clock_changes": """
            WITH r AS (
              SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(o_orderkey % 24) AS utc,
                     CAST(o_orderkey % 400 AS DOUBLE) AS t FROM orders
              QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), o_orderkey % 24 ORDER BY o_orderkey DESC) = 1),
            ends AS (
              SELECT *, make_date(year(utc), 3, 31) AS march,
                     CASE WHEN year(utc) < 1996 THEN make_date(year(utc), 9, 30) ELSE make_date(year(utc), 10, 31) END AS fall
              FROM r),
            zoned AS (
              SELECT t, utc + CASE
                WHEN utc >= CAST(march - CAST(isodow(march) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR
                 AND utc < CAST(fall - CAST(isodow(fall) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR
                THEN INTERVAL 2 HOURS ELSE INTERVAL 1 HOUR END AS local FROM ends)
            SELECT CAST(local AS DATE) AS date, CAST(hour(local) AS INTEGER) AS hour, avg(t) / 10 AS temperature
            FROM zoned GROUP BY 1, 2""",
        "weather_forecast": _with(_predicted("'L' || user_id")) + "SELECT * FROM predicted",
        "events_clean": _with(SHEET) + "SELECT * FROM cleaned",
        "event_times": _with(SHEET) + "SELECT ord, date, start_show, start_ts, end_ts FROM timed",
        "events_unified": _with(UNIFIED) + "SELECT * FROM united",
        "events_normalized": _with(UNIFIED) + """
            SELECT venue, date, start_show, visitors,
                   visitors / (SELECT max(visitors) FROM united) AS visitors_normalized FROM united""",
        "venue_distance": _with(VENUE_EVENTS, DISTANCES) + """
            SELECT venue, events, station, distance_km
            FROM (SELECT venue, count(*) AS events FROM perf GROUP BY venue) JOIN km USING (venue)""",
        "planned_event": _with(*score, _score("flow", HOURS_MATCH, ATTENDANCE)) + SCORE_OUT,
        "planned_event_daily": _with(*score, _score("flow", DAY_MATCH, ATTENDANCE)) + SCORE_OUT,
        "planned_event_presence": _with(*score, _score("flow", HOURS_MATCH, PRESENCE)) + SCORE_OUT,
        "planned_event_no_distance": _with(*score, _score("flow", HOURS_MATCH, ATTENDANCE, "0.0")) + SCORE_OUT,
        "peak_lead": _with(FLOWS, VENUE_EVENTS, PEAK) + """
            SELECT station, count(*) AS events, avg(c) AS mean_counter
            FROM perf JOIN counter ON counter.ts = perf.st WHERE visitors > 0 GROUP BY station""",
        "week_ago": _with(FLOWS, WEEK_AGO.format(history="flow", rows="flow")) + """
            SELECT station, date, hour, round(check_ins_week_ago, 4) AS check_ins_week_ago,
                   round(check_outs_week_ago, 4) AS check_outs_week_ago FROM lagged""",
        "enriched_flows": "WITH " + ENRICHED_CTES + "SELECT * FROM rich",
        "feature_matrix": MATRIX,
        "future_features": FUTURE,
        "split_labels": flow + f"""
            SELECT station, date, hour, CASE WHEN {split_age} < 7 THEN 'test'
                   WHEN {split_age} < 14 THEN 'validation' ELSE 'train' END AS split
            FROM flow WHERE {complete}""",
        "split_labels_2way": flow + f"""
            SELECT station, date, hour, CASE WHEN {split_age} < 7 THEN 'test' ELSE 'train' END AS split
            FROM flow WHERE {complete}""",
        "forecast_metrics": _with(FLOWS, METRICS) + _METRIC_OUT,
        "quality_gate": _with(FLOWS, METRICS) + _METRIC_OUT + " WHERE r2 < 0.7",
        "busy_threshold": _with(FLOWS, BUSY) + "SELECT * FROM busy",
        "crowding_flag": _with(FLOWS, BUSY) + """
            SELECT station, date, hour, COALESCE(check_ins, 0) + COALESCE(check_outs, 0) AS total, threshold,
                   CASE WHEN COALESCE(check_ins, 0) + COALESCE(check_outs, 0) >= threshold THEN 1 ELSE 0 END AS crowded
            FROM flow LEFT JOIN busy USING (station)""",
        "forecast_serving": flow + f""",
            newest AS (
              SELECT *, CASE WHEN station = 'Station Zuid' THEN 0 ELSE 7 END AS shift,
                     CASE WHEN station = 'Station Zuid' THEN TIMESTAMP '2024-02-01 06:00:00'
                          ELSE TIMESTAMP '2024-02-02 06:00:00' END AS run_ts,
                     CASE station WHEN 'Centraal Station' THEN 8845 WHEN 'Station Zuid' THEN 5428 ELSE 3562 END
                     AS threshold
              FROM flow WHERE {complete} AND date = (SELECT max(CAST(ts AS DATE)) FROM events))
            SELECT station, run_ts, date, hour, check_ins + shift AS check_ins_predicted,
                   check_outs + shift AS check_outs_predicted, CAST(threshold AS BIGINT) AS threshold,
                   check_ins + check_outs + 2 * shift AS total,
                   CAST(check_ins + check_outs + 2 * shift >= threshold AS INTEGER) AS crowded FROM newest""",
        "model_log": _with(FLOWS, METRICS) + _log("fair", 3, "true") + " UNION ALL " + _log("flat", 2, "false"),
        "config_flags": f"""
            WITH c AS (SELECT user_id, {", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS)}
                       FROM events GROUP BY user_id)
            SELECT user_id, array_to_string(list_filter([
                {", ".join(f"CASE WHEN \"{k}\" % 2 = 1 THEN '{o}' END" for o, k in _OPTIONS)}],
                lambda x: x IS NOT NULL), ',') AS enabled FROM c""",
        "caption_datetime": _with(CAPTIONS.format(year="year(ts)")) + "SELECT event_id, event_date FROM captioned",
        "link_extract": """
            WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="/[^"]+"') AS found FROM pages)
            SELECT page_id, found[1] AS first_link, CAST(len(found) AS BIGINT) AS n_links,
                   CASE WHEN len(found) > 0 THEN 1 ELSE 0 END AS has_link FROM l""",
        "posts_to_events": _with(CAPTIONS.format(year="year(ts + INTERVAL 1 HOUR)")) + f"""
            SELECT {ACCOUNTS}[user_id % 10 + 1] AS venue, event_id % 1000 AS likes, event_id % 50 AS comments,
                   date_trunc('second', ts) + INTERVAL 1 HOUR AS date_uploaded, caption, event_date
            FROM captioned WHERE event_id % 11 <> 0 AND event_date IS NOT NULL""",
        "ticket_pages_to_events": _TICKET_PAGES,
        "scan_trips_csv": _TRIPS,
        "scan_trips_union": _TRIPS,
        "scan_weather": _WEATHER_ROWS, "scan_weather_any_extension": _WEATHER_ROWS,
        "scan_venue_events": _with(SHEET) + """
            SELECT * FROM sheet UNION ALL
            SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL FROM events
            WHERE event_id % 31 = 0""",
        "scan_social_events": f"""
            SELECT (dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1) * 4294967296 + event_id AS ord, {ACCOUNTS}[user_id % 10 + 1] AS venue,
                   strftime(ts, '%Y-%m-%d %H:00:00') AS event_date FROM events""",
        "scan_ticketed_events": f"""
            SELECT (dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1) * 4294967296 + event_id AS ord, 'Show ' || event_id AS name,
                   replace({VENUES}[user_id % 15 + 1], 'Royal Theater Carré', 'Koninklijk Theater Carre') AS venue,
                   strftime(ts, '%Y-%m-%dT%H:00:00Z') AS datetime FROM events""",
        "scan_measures": """
            WITH m AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS monday, CAST(user_id % 5 AS INTEGER) AS k FROM events)
            SELECT CASE WHEN event_id % 4 = 0 THEN 'Belgium' ELSE 'Netherlands' END AS "Country",
                   'Measure' || k AS "Response_measure", monday + k AS date_start,
                   CASE WHEN (SELECT max(CAST(ts AS DATE)) FROM events) - monday > 7 THEN monday + k + k % 3 END AS date_end
            FROM m""",
        "scan_cases": """
            SELECT strftime(ts, '%d/%m/%Y') AS "dateRep", CASE WHEN user_id % 2 = 0 THEN 'NL' ELSE 'BE' END AS "geoId",
                   CAST(count(*) AS DOUBLE) AS cases, CAST(count(*) FILTER (WHERE value > 100) AS DOUBLE) AS deaths
            FROM events GROUP BY 1, 2""",
        "scan_documents": _with(STRINGENCY) + "SELECT * FROM stringency",
        "scan_school_years": _with(VACATIONS) + "SELECT date FROM vacation",
        "scan_posts": _with(CAPTIONS.format(year="year(ts + INTERVAL 1 HOUR)")) + """
            SELECT event_id % 1000 AS likes, event_id % 50 AS comments,
                   date_trunc('second', ts) + INTERVAL 1 HOUR AS date_uploaded, caption, event_date
            FROM captioned WHERE event_id % 11 <> 0 AND event_date IS NOT NULL""",
        "scan_ticket_pages": _TICKET_PAGES,
        "saved_forecasts": flow + f"""
            SELECT station, date, hour, CAST(run_ts AS DATE) AS run_date, run_ts, check_ins + more AS check_ins_predicted,
                   check_outs + more AS check_outs_predicted
            FROM (SELECT *, CASE WHEN station = 'Centraal Station' THEN 0 ELSE 1 END AS more,
                         CASE WHEN station = 'Centraal Station' THEN TIMESTAMP '2024-02-02 06:00:00'
                              ELSE TIMESTAMP '2024-02-01 09:00:00' END AS run_ts FROM flow WHERE {complete})""",
        "published_forecasts": flow + f"""
            SELECT station, date, hour, check_ins + 1 AS check_ins_predicted, check_outs + 1 AS check_outs_predicted
            FROM flow WHERE {complete}""",
        "logged_runs": _with(FLOWS, METRICS) + _log("fair", 3, "true", "DATE '2024-02-01' AS logged_at")
            + " UNION ALL " + _log("flat", 2, "false", "DATE '2024-02-03' AS logged_at"),
        "typed_trips": """
            SELECT CAST(ts AS DATE) AS date, strftime(ts, '%H:00 - %H:59') AS hour_band, 'S' || user_id AS stop_code,
                   ['Centraal Station', 'Station Zuid', 'Station Bijlmer ArenA'][user_id % 3 + 1] AS station,
                   CAST(round(value * 100) AS BIGINT) + CASE WHEN day(ts) % 7 = 0 THEN 1 ELSE 0 END AS trips
            FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) - 10 FROM events)""",
        "drifting_ticket_pages": f"""
            SELECT CASE WHEN event_id % 6 = 2 THEN CAST(event_id AS VARCHAR) ELSE 'Show ' || event_id % 50 END AS name,
                   CASE WHEN event_id % 6 <> 5 THEN {VENUES}[user_id % 15 + 1] END AS venue,
                   CASE WHEN event_id % 6 <> 3 THEN strftime(ts, '%Y-%m-%dT%H:00:00Z') END AS datetime,
                   CASE WHEN event_id % 6 = 1 THEN 'currency,price' ELSE '' END AS unknown,
                   CASE WHEN event_id % 6 = 3 THEN 'datetime' ELSE '' END AS misfits
            FROM events WHERE event_id // 200 % 9 <> 0
            UNION ALL SELECT NULL, NULL, NULL, '', 'document' FROM events
            WHERE event_id // 200 % 9 = 0 GROUP BY event_id // 200""",
        "collected_events": f"""
            SELECT event_id AS ord, 'Show ' || event_id AS name, 'page-' || event_id % 50 AS source,
                   replace({VENUES}[user_id % 15 + 1], 'Royal Theater Carré', 'Koninklijk Theater Carre') AS venue,
                   strftime(ts, '%Y-%m-%dT%H:00:00Z') AS datetime FROM events""",
        "weather_as_of": "WITH " + _predicted("'L' || user_id") + """,
            asked AS (SELECT e.event_id, 'L' || e.user_id AS loc, e.ts, b.t, b.temperature, b.clouds
                      FROM events e ASOF LEFT JOIN best b ON 'L' || e.user_id = b.loc AND e.ts >= b.t)
            SELECT event_id, loc, ts, CASE WHEN ts <= t + INTERVAL 11 HOURS THEN t END AS found_ts,
                   CASE WHEN ts <= t + INTERVAL 11 HOURS THEN temperature END AS temperature,
                   CASE WHEN ts <= t + INTERVAL 11 HOURS THEN clouds END AS clouds FROM asked""",
        "imputed_flows": flow + """
            SELECT station, date, hour, check_ins, check_outs, CAST(check_ins IS NULL AS INTEGER) AS filled_check_ins,
                   CAST(check_outs IS NULL AS INTEGER) AS filled_check_outs,
                   CASE WHEN check_ins IS NULL THEN 1 END AS inside_check_ins,
                   CASE WHEN check_outs IS NULL THEN 1 END AS inside_check_outs FROM flow""",
        "trained_scores": "WITH " + ENRICHED_CTES + f""",
            usable AS (SELECT station, {split_age} AS age FROM rich WHERE {_WEATHER_KNOWN})
            SELECT station, count(*) AS n, 1 AS r2_valid, 1 AS mae_valid, 1 AS rmse_valid, 1 AS beats_profile
            FROM usable WHERE age < 7 GROUP BY station""",
        "forecast_rows": FUTURE_CTES + f"""
            SELECT g.station, g.date, g.hour, 1 AS inside_check_ins, 1 AS inside_check_outs
            FROM grid g JOIN predicted w ON w.date = g.date AND w.hour = g.hour
            LEFT JOIN exact e ON e.station = g.station AND e.date = g.date AND e.hour = g.hour
            LEFT JOIN weekly k ON k.station = g.station AND k.year = g.year AND k.week = g.week AND k.hour = g.hour
            WHERE (e.station IS NOT NULL OR k.station IS NOT NULL) AND {_WEATHER_KNOWN}""",
    }
