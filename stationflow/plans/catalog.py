"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.config import STATIONS, ForecastConfig
from stationflow.functions import clock
from stationflow.functions.text import with_caption_datetime
from stationflow.operators import (
    analysis, calendar, events, extract, features, flows, forests, indicators, serving, splits, weather,
)
from stationflow.operators.asof import as_of
from stationflow.operators.planned_event import planned_event
from stationflow.operators.shared import flag
from stationflow.plans import standins as st
from stationflow.session import fresh_path, materialise
from stationflow.sources import readers, schemas, sinks, typed

Query = Callable[[SparkSession, str], DataFrame]
CFG = ForecastConfig()
MODEL_FEATURES = CFG.model_features(tuple(st.MEASURE_NAMES.values()))
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__.removeprefix("run_")] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _mod_of(column: str, n: int) -> Column:
    return F.pmod(F.col(column), F.lit(n))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return st.table(spark, sf, "events")


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return st.flow_rows(_events(spark, sf))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Station hours with week-ago counts and event score."""
    ev = _events(spark, sf)
    scored = events.events_normalized(st.venue_events(ev)).withColumn("visitors", F.col("visitors_normalized"))
    return planned_event(features.week_ago(st.flow_rows(ev)), scored, st.rounded_distances(spark), CFG)


# --- flows -----------------------------------------------------------------------------

@query
def dedup_rows(spark, sf):
    ev = _events(spark, sf)
    return flows.dedup_rows(ev.unionByName(ev))


@query
def hourly_flows(spark, sf):
    return st.hourly(_events(spark, sf))


@query
def station_slice(spark, sf):
    return calendar.station_slice(st.hourly(_events(spark, sf)), STATIONS[1])


def _stop_trips(spark, sf, status: str) -> DataFrame:
    li = st.table(spark, sf, "lineitem").where(F.col("l_linestatus") == status)
    return li.select(
        F.trunc("l_shipdate", "month").alias("date"), F.col("l_returnflag").alias("hour_band"),
        F.nullif(F.col("l_linenumber"), F.lit(3)).cast("string").alias("stop_code"),
        st.station_of(F.col("l_suppkey")).alias("station"), F.col("l_quantity").cast("bigint").alias("trips"))


@query
def stop_flows(spark, sf):
    return flows.stop_flows(_stop_trips(spark, sf, "O"), _stop_trips(spark, sf, "F"))


@query
def stop_types(spark, sf):
    li = st.table(spark, sf, "lineitem")
    counted = li.groupBy(F.col("l_suppkey").alias("stop_code")).agg(F.count("*").alias("trips"))
    nation = st.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    stops = st.table(spark, sf, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("arrival_stop_code"), F.col("n_name").alias("type"))
    return flows.stop_types(counted, stops)


@query
def missing_profile(spark, sf):
    return analysis.missing_profile(_flows(spark, sf))


@query
def training_rows(spark, sf):
    return features.training_rows(_flows(spark, sf))


# --- calendar --------------------------------------------------------------------------

@query
def calendar_features(spark, sf):
    return _flows(spark, sf)


@query
def one_hot(spark, sf):
    return calendar.one_hot(_flows(spark, sf)).drop("week", "month", "year", "ts")


@query
def peak_period(spark, sf):
    return calendar.peak_period(_flows(spark, sf)).select(
        "station", "date", "hour", "check_ins", "check_outs", "peak_period")


@query
def cyclic_features(spark, sf):
    out = calendar.cyclic_features(_flows(spark, sf))
    waves = [c for c in out.columns if c.startswith(("sin_", "cos_"))]
    return out.select("station", "date", "hour", *[F.round(c, 9).alias(c) for c in waves])


@query
def calendar_flags(spark, sf):
    ev = _events(spark, sf)
    holidays = indicators.holiday_calendar(st.years_of(ev, "ts"))
    vacations = indicators.vacation_calendar(st.school_years(ev))
    return calendar.calendar_flags(st.flow_rows(ev), holidays, vacations).select(
        "station", "date", "hour", "holiday", "vacation")


@query
def holiday_calendar(spark, sf):
    return indicators.holiday_calendar(st.years_of(st.table(spark, sf, "orders"), "o_orderdate"))


@query
def vacation_calendar(spark, sf):
    return indicators.vacation_calendar(st.school_years(_events(spark, sf)))


def _next_day(ev: DataFrame):
    return F.date_add(st.last_day(ev), 1).cast(clock.NTZ)


@query
def future_grid(spark, sf):
    ev = _events(spark, sf)
    stations = ev.select(st.station_of(F.col("user_id")).alias("station"))
    return calendar.future_grid(stations, _next_day(ev))


# --- date-keyed sources ----------------------------------------------------------------

@query
def measures_daily(spark, sf):
    return indicators.measures_daily(st.raw_measures(_events(spark, sf)), CFG.country, st.MEASURE_NAMES, st.as_of(_events(spark, sf)))


@query
def cases_deaths(spark, sf):
    return indicators.cases_deaths(st.raw_cases(_events(spark, sf)), CFG.geo_id, CFG.case_date_format)


@query
def stringency_series(spark, sf):
    records = indicators.stringency_records(st.stringency_documents(_events(spark, sf)), CFG.country_code)
    return indicators.stringency_series(records, CFG.stringency_horizon_days)


@query
def fill_from_latest(spark, sf):
    ev = _events(spark, sf)
    known = indicators.cases_deaths(st.raw_cases(ev), CFG.geo_id, CFG.case_date_format).where(
        F.date_diff(st.last_day(ev), "date") > 10)
    return indicators.fill_from_latest(
        st.flow_rows(ev).select("station", "date", "hour"), known, ["cases", "deaths"])


# --- weather ---------------------------------------------------------------------------

@query
def weather_history(spark, sf):
    return weather.weather_history(st.raw_observations(_events(spark, sf)), CFG.weather_station, CFG.zone)


@query
def weather_clock_changes(spark, sf):
    """Readings over years of order dates, across every change of the clocks."""
    raw = st.table(spark, sf, "orders").selectExpr(
        "concat(to_date(o_orderdate), 'T00:00:00.000Z') AS date", "CAST(o_orderkey % 24 + 1 AS int) AS hour",
        "'240' AS station_code", "o_orderkey AS revision", "CAST(o_orderkey % 400 AS double) AS T")
    return weather.weather_history(raw, CFG.weather_station, CFG.zone)


@query
def weather_forecast(spark, sf):
    return weather.weather_forecast(st.raw_predictions(_events(spark, sf)), CFG.zone)


@query
def weather_as_of(spark, sf):
    """The prediction valid at the minute of every event, made for the same or an earlier time."""
    ev = _events(spark, sf)
    latest = weather.latest_predictions(st.raw_predictions(ev)).select("loc", "ts", "temperature", "clouds")
    moments = ev.select("event_id", F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("loc"), "ts")
    return as_of(moments, latest, ["loc"], within_hours=11)


# --- venue events ----------------------------------------------------------------------

@query
def events_clean(spark, sf):
    return events.events_clean(st.raw_sheet(_events(spark, sf)))


@query
def event_times(spark, sf):
    timed = events.event_times(events.events_clean(st.raw_sheet(_events(spark, sf))))
    return timed.select("ord", "date", "start_show", "start_ts", "end_ts")


@query
def events_unified(spark, sf):
    return st.unified(_events(spark, sf), CFG)


@query
def events_normalized(spark, sf):
    return events.events_normalized(st.unified(_events(spark, sf), CFG)).select(
        "venue", "date", "start_show", "visitors", "visitors_normalized")


@query
def venue_distance(spark, sf):
    held = st.venue_events(_events(spark, sf)).groupBy("venue").agg(F.count("*").alias("events"))
    return held.join(st.rounded_distances(spark), "venue")


def _score(spark, sf, cfg: ForecastConfig) -> DataFrame:
    ev = _events(spark, sf)
    scored = events.events_normalized(st.venue_events(ev)).withColumn("visitors", F.col("visitors_normalized"))
    return planned_event(st.flow_rows(ev), scored, st.rounded_distances(spark), cfg).select(
        "station", "date", "hour", F.round("planned_event", 9).alias("planned_event"))


@query
def run_planned_event(spark, sf):
    return _score(spark, sf, CFG)


@query
def planned_event_daily(spark, sf):
    return _score(spark, sf, CFG.with_(use_event_time=False))


@query
def planned_event_presence(spark, sf):
    """Attendance off: only the nearest event counts."""
    return _score(spark, sf, CFG.with_(use_attendance=False))


@query
def planned_event_no_distance(spark, sf):
    """Distance off: every event is at the station."""
    return _score(spark, sf, CFG.with_(use_distance=False))


@query
def peak_lead(spark, sf):
    ev = _events(spark, sf)
    return analysis.peak_lead(st.flow_rows(ev), st.venue_events(ev))


# --- features --------------------------------------------------------------------------

@query
def week_ago(spark, sf):
    out = features.week_ago(_flows(spark, sf))
    return out.select("station", "date", "hour", F.round("check_ins_week_ago", 4).alias("check_ins_week_ago"),
                      F.round("check_outs_week_ago", 4).alias("check_outs_week_ago"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name
                       for f in df.schema])


@query
def enriched_flows(spark, sf):
    return _rounded(st.enriched(_events(spark, sf), CFG))


@query
def feature_matrix(spark, sf):
    rows = features.week_ago(st.enriched(_events(spark, sf), CFG))
    return _rounded(features.feature_matrix(rows, MODEL_FEATURES))


@query
def future_features(spark, sf):
    """The week after the last row, with forecasts and planned events for it."""
    ev = _events(spark, sf)
    dims = st.written(st.dimensions(ev, CFG, future=True))
    out = features.future_features(st.flow_rows(ev), dims, CFG, _next_day(ev))
    return _rounded(out.drop("ts", "wind_direction", "relative_humidity", "pressure", "clouds", "sight_m"))


# --- splits and metrics ----------------------------------------------------------------

@query
def split_labels(spark, sf):
    return splits.split_labels(_flows(spark, sf)).select("station", "date", "hour", "split")


@query
def split_labels_2way(spark, sf):
    return splits.split_labels_2way(_flows(spark, sf)).select("station", "date", "hour", "split")


def _guesses(flow: DataFrame) -> DataFrame:
    """Two stand-in predictions per row, a fair and a flat one."""
    runs = F.explode(F.array(F.lit("fair"), F.lit("flat")))
    both = flow.withColumn("run", runs)
    return both.withColumns({
        f"{t}_predicted": F.when(F.col("run") == "fair", F.col(t) - 10 * F.col("hour")).otherwise(F.lit(5000))
        for t in forests.TARGETS})


def _metrics(spark, sf) -> DataFrame:
    return splits.forecast_metrics(_guesses(_flows(spark, sf)), ("station", "run"))


@query
def forecast_metrics(spark, sf):
    out = _metrics(spark, sf)
    return out.select("station", "run", "n", *[F.round(c, 6).alias(c) for c in ("r2", "mae", "rmse")])


@query
def quality_gate(spark, sf):
    out = splits.quality_gate(_metrics(spark, sf))
    return out.select("station", "run", "n", *[F.round(c, 6).alias(c) for c in ("r2", "mae", "rmse")])


# --- models ----------------------------------------------------------------------------

def _enriched_rows(spark, sf) -> DataFrame:
    return materialise(st.enriched(_events(spark, sf), CFG), "enriched", ("station",))


def _complete_rows(spark, sf) -> DataFrame:
    filled = forests.impute(_enriched_rows(spark, sf), CFG).where("check_ins IS NOT NULL AND check_outs IS NOT NULL")
    return materialise(features.week_ago(filled), "clean", ("station",))


def _inside(value: str, by_station: DataFrame) -> Column:
    """1 where a value lies within the range that its station has shown."""
    return flag(F.col(value).between(F.col(f"min_{value.removesuffix('_predicted')}"),
                                     F.col(f"max_{value.removesuffix('_predicted')}")))


def _ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("station").agg(*[f(t).alias(f"{n}_{t}") for t in forests.TARGETS
                                         for n, f in (("min", F.min), ("max", F.max))])


@query
def imputed_flows(spark, sf):
    """Every row; known counts as they were, filled ones as a flag and whether they lie within
    what the station has shown (a forest averages training rows, so they must)."""
    before = _enriched_rows(spark, sf)
    keys = ["station", "date", "hour"]
    known = before.select(*keys, *[F.col(t).alias(f"known_{t}") for t in forests.TARGETS])
    out = forests.impute(before, CFG).join(known, keys).join(_ranges(before), "station")
    filled = {t: F.col(f"known_{t}").isNull() & F.col(t).isNotNull() for t in forests.TARGETS}
    return out.select(*keys, *[F.when(~filled[t], F.col(t)).alias(t) for t in forests.TARGETS],
                      *[flag(filled[t]).alias(f"filled_{t}") for t in forests.TARGETS],
                      *[F.when(filled[t], _inside(t, out)).alias(f"inside_{t}") for t in forests.TARGETS])


@query
def trained_scores(spark, sf):
    """Test rows per station, what any honest score meets, and whether the forest explains more
    than the station's mean for the weekday and hour does."""
    rows = _complete_rows(spark, sf)
    matrix = features.feature_matrix(rows, MODEL_FEATURES)
    labelled = materialise(splits.split_labels(matrix), "labelled", ("station",))
    models = forests.train(labelled.where("split <> 'test'"), MODEL_FEATURES, CFG)
    learnt, test = labelled.where("split <> 'test'"), labelled.where("split = 'test'")
    profile = learnt.groupBy("station", "weekday", "hour").agg(*[F.avg(t).alias(f"{t}_hourly") for t in forests.TARGETS])
    level = learnt.groupBy("station").agg(*[F.avg(t).alias(f"{t}_mean") for t in forests.TARGETS])
    plain = test.join(level, "station").join(profile, ["station", "weekday", "hour"], "left").withColumns({
        f"{t}_predicted": F.coalesce(f"{t}_hourly", f"{t}_mean") for t in forests.TARGETS})
    plain = splits.forecast_metrics(plain).select("station", F.col("r2").alias("plain_r2"))
    return splits.forecast_metrics(forests.predict(models, test, MODEL_FEATURES)).join(plain, "station").select(
        "station", "n", flag(F.col("r2") <= 1).alias("r2_valid"), flag(F.col("mae") >= 0).alias("mae_valid"),
        flag(F.col("rmse") >= F.col("mae") - 1e-9).alias("rmse_valid"),
        flag(F.col("r2") > F.col("plain_r2")).alias("beats_profile"))


@query
def forecast_rows(spark, sf):
    """Hours of the coming week whose features are complete, with both predictions inside
    the counts that the station has shown."""
    ev = _events(spark, sf)
    rows = _complete_rows(spark, sf)
    models = forests.train(rows, MODEL_FEATURES, CFG)
    dims = st.written(st.dimensions(ev, CFG, future=True))
    future = materialise(features.future_features(rows, dims, CFG, _next_day(ev), MODEL_FEATURES), "future")
    out = forests.predict(models, future, MODEL_FEATURES).join(_ranges(rows), "station")
    return out.select("station", "date", "hour",
                      *[_inside(f"{t}_predicted", out).alias(f"inside_{t}") for t in forests.TARGETS])


@query
def saved_forecasts(spark, sf):
    """Two runs of one date and a later one are saved; only the last of each date stays, and the
    newest date is served."""
    path = fresh_path(spark, "forecasts")
    flow = _flows(spark, sf).dropna(subset=["check_ins", "check_outs"]).select("station", "date", "hour", *[
        F.col(t).alias(f"{t}_predicted") for t in forests.TARGETS])
    more = flow.withColumns({f"{t}_predicted": F.col(f"{t}_predicted") + 1 for t in forests.TARGETS})
    sinks.save_forecasts(flow, path, datetime(2024, 2, 1, 6))
    sinks.save_forecasts(more, path, datetime(2024, 2, 1, 9))
    sinks.save_forecasts(flow.where(F.col("station") == STATIONS[0]), path, datetime(2024, 2, 2, 6))
    return sinks.read_forecasts(spark, path)


@query
def published_forecasts(spark, sf):
    """A date's files are published twice, the second time with other figures, and then another
    date's of one station; the first date's are read back."""
    path, day = fresh_path(spark, "published"), date(2024, 2, 1)
    flow = _flows(spark, sf).dropna(subset=["check_ins", "check_outs"]).select("station", "date", "hour", *[
        F.col(t).alias(f"{t}_predicted") for t in forests.TARGETS])
    more = flow.withColumns({f"{t}_predicted": F.col(f"{t}_predicted") + 1 for t in forests.TARGETS})
    sinks.publish_forecasts(flow, path, day)
    sinks.publish_forecasts(more, path, day)
    sinks.publish_forecasts(flow.where(F.col("station") == STATIONS[0]), path, date(2024, 2, 2))
    back = sinks.read_published(spark, path, day).withColumnsRenamed({new: old for old, new in sinks.PUBLISHED_NAMES.items()})
    return back.select("station", F.col("date").cast("date").alias("date"), F.col("hour").cast("int").alias("hour"), *[
        F.col(f"{t}_predicted").cast("bigint").alias(f"{t}_predicted") for t in forests.TARGETS])


# --- reports and serving ---------------------------------------------------------------

@query
def busy_threshold(spark, sf):
    return analysis.busy_threshold(_flows(spark, sf), per_mille=20)


@query
def crowding_flag(spark, sf):
    flow = _flows(spark, sf)
    total = F.coalesce("check_ins", F.lit(0)) + F.coalesce("check_outs", F.lit(0))
    return analysis.crowding_flag(flow, total, analysis.busy_threshold(flow, per_mille=20)).select(
        "station", "date", "hour", "total", "threshold", "crowded")


@query
def forecast_serving(spark, sf):
    early, late = datetime(2024, 2, 1, 6), datetime(2024, 2, 2, 6)
    # The second run leaves one station out.
    runs = F.when(F.col("station") == STATIONS[1], F.array(F.lit(early))).otherwise(
        F.array(F.lit(early), F.lit(late)))
    forecasts = _flows(spark, sf).dropna(subset=["check_ins", "check_outs"]).withColumn(
        "run_ts", F.explode(runs.cast("array<timestamp_ntz>")))
    shift = F.when(F.col("run_ts") == F.lit(late).cast(clock.NTZ), 7).otherwise(0)
    forecasts = forecasts.select(
        "station", "run_ts", "date", "hour", (F.col("check_ins") + shift).alias("check_ins_predicted"),
        (F.col("check_outs") + shift).alias("check_outs_predicted"))
    return serving.forecast_serving(forecasts, st.last_day(_events(spark, sf)))


@query
def model_log(spark, sf):
    metrics = _metrics(spark, sf)
    old = serving.model_log_rows(metrics.where("run = 'fair'"), CFG, MODEL_FEATURES)
    flat = metrics.where("run = 'flat'")
    again = serving.model_log_rows(flat, CFG, MODEL_FEATURES)
    other = serving.model_log_rows(flat, CFG.with_(hours_before=2), ["hour"])
    return serving.model_log(old, again.unionByName(other))


@query
def logged_runs(spark, sf):
    """Three runs log through files: the second meets the first one's keys, the third has its own."""
    path, metrics = fresh_path(spark, "log"), materialise(_metrics(spark, sf), "metrics")
    fair, flat = metrics.where("run = 'fair'"), metrics.where("run = 'flat'")
    runs = [(fair, CFG, MODEL_FEATURES), (flat, CFG, MODEL_FEATURES), (flat, CFG.with_(hours_before=2), ["hour"])]
    for day, (rows, cfg, chosen) in enumerate(runs, 1):
        sinks.save_model_log(serving.model_log_rows(rows, cfg, chosen), path, datetime(2024, 2, day))
    return sinks.read_model_log(spark, path).withColumn("logged_at", F.to_date("logged_at"))


@query
def config_flags(spark, sf):
    out = serving.config_flags(st.config_documents(_events(spark, sf)))
    return out.select("user_id", F.array_join("enabled", ",").alias("enabled"))


# --- collected documents ---------------------------------------------------------------

@query
def run_caption_datetime(spark, sf):
    ev = _events(spark, sf)
    captions = ev.select("event_id", "ts", st.caption().alias("caption"))
    return with_caption_datetime(captions, "caption", "year(ts)").select("event_id", "event_date")


@query
def link_extract(spark, sf):
    pages = st.table(spark, sf, "pages")
    return extract.link_extract(pages, 'href="/[^"]+"').select("page_id", "first_link", "n_links", "has_link")


@query
def posts_to_events(spark, sf):
    posts = extract.parse_documents(st.post_documents(_events(spark, sf)), extract.POSTS_SCHEMA)
    return extract.posts_to_events(posts, CFG.zone)


@query
def ticket_pages_to_events(spark, sf):
    pages = extract.parse_documents(st.ticket_documents(_events(spark, sf)), extract.TICKETS_SCHEMA)
    return extract.ticket_pages_to_events(pages)


@query
def collected_events(spark, sf):
    """Pages of events, some of them collected two and three times."""
    path, page = fresh_path(spark, "collected"), _mod_of("ord", 50)
    rows = st.raw_tickets(_events(spark, sf)).withColumn("source", F.concat(F.lit("page-"), page.cast("string")))
    for day, pages in enumerate((30, 40, 50), 1):
        sinks.append_events(rows.where(page < pages), path, datetime(2024, 2, day))
    return sinks.read_events(spark, path, rows.schema)


@query
def drifting_ticket_pages(spark, sf):
    """Pages whose fields come, go and change their types."""
    out = extract.drifting_ticket_pages(st.drifting_documents(_events(spark, sf)))
    return out.withColumns({c: F.array_join(c, ",") for c in ("unknown", "misfits")})


# --- scans: tables are written to the shared folder in the raw layout and read back ------

def _landed(rows: DataFrame, day: str) -> DataFrame:
    """Adds year/month/day folders; ranges keep each task to few of them."""
    folders = {"y": F.substring(day, 1, 4), "m": F.substring(day, 6, 2), "d": F.substring(day, 9, 2)}
    return rows.withColumns(folders).repartitionByRange(day)


def _land_csv(rows: DataFrame, path: str) -> str:
    _landed(rows, "Datum").write.partitionBy("y", "m", "d").csv(path, sep=";", header=True)
    return path


def _land_json(rows: DataFrame, path: str) -> str:
    _landed(rows, "Datum").write.partitionBy("y", "m", "d").json(path, compression="gzip")
    return path


@query
def scan_trips_csv(spark, sf):
    path = _land_csv(st.raw_trips(_events(spark, sf), "in", whole=True), fresh_path(spark, "trips-csv"))
    return flows.normalise_trips(readers.scan_trips_csv(spark, path, "part-", "in"), "in")


@query
def scan_trips_union(spark, sf):
    ev = _events(spark, sf)
    early = F.col("event_type").isin(*st.IN_TYPES)
    csv = _land_csv(st.raw_trips(ev.where(early), "out", whole=True), fresh_path(spark, "trips-csv"))
    json = _land_json(st.raw_trips(ev.where(~early), "out", whole=True), fresh_path(spark, "trips-json"))
    return flows.normalise_trips(readers.scan_trips_union(spark, csv, json, "part-", "out"), "out")


@query
def scan_weather(spark, sf):
    path = fresh_path(spark, "weather-json")
    st.raw_observations(_events(spark, sf)).write.json(path, compression="gzip")
    return readers.scan_weather(spark, path, schemas.OBSERVED_WEATHER)


@query
def scan_weather_any_extension(spark, sf):
    """Gzipped files, half of them without the ending that says so."""
    path = fresh_path(spark, "weather-any")
    st.raw_observations(_events(spark, sf)).repartition(4).write.json(path, compression="gzip")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    named = sorted(f.getPath().toString() for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.gz")))
    for name in named[::2]:
        files.rename(*map(spark._jvm.org.apache.hadoop.fs.Path, (name, name.removesuffix(".gz"))))
    return readers.scan_weather(spark, path, schemas.OBSERVED_WEATHER, any_extension=True)


@query
def typed_trips(spark, sf):
    """Raw days go into the typed layer once; some of them are landed anew and only these are
    read again. Back come the last ten days."""
    ev = _events(spark, sf)
    raw, layer = fresh_path(spark, "trips-csv"), fresh_path(spark, "trips-typed")
    trips = st.raw_trips(ev, "in", whole=True)
    _land_csv(trips, raw)
    typed.update_trips(spark, raw, layer, "part-", "in")
    again = trips.where(F.substring("Datum", 9, 2).cast("int") % 7 == 0)
    more = (F.col("AantalReizen").cast("bigint") + 1).cast("string")
    _landed(again.withColumn("AantalReizen", more), "Datum").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("y", "m", "d").csv(raw, sep=";", header=True)
    typed.update_trips(spark, raw, layer, "part-", "in")
    return typed.read_trips(spark, layer, F.date_sub(st.last_day(ev), 9))


def _csv_path(rows: DataFrame, name: str) -> str:
    path = fresh_path(rows.sparkSession, name)
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(header=True, escape='"', **keep_spaces).csv(path)
    return path


@query
def scan_venue_events(spark, sf):
    return readers.scan_venue_events(spark, _csv_path(st.raw_sheet(_events(spark, sf)), "sheet-csv"))


def _day_files(rows: DataFrame, name: str, *layouts: list) -> str:
    """One file a day, the days by turns with one or the other layout of columns."""
    path = fresh_path(rows.sparkSession, name)
    for turn, columns in enumerate(layouts):
        part = rows.where(F.dayofmonth(F.col("day").cast("date")) % len(layouts) == turn).select("day", *columns)
        part.repartition("day").sortWithinPartitions("day", "ord").write.mode("append").partitionBy("day").options(
            header=True, escape='"').csv(path)
    return path


@query
def scan_social_events(spark, sf):
    """With columns beside the used ones, in files that differ in them."""
    rows = st.raw_social(_events(spark, sf)).withColumn("day", F.substring("event_date", 1, 10))
    caption = F.lit("a, \"b\"\nc").alias("caption")
    path = _day_files(rows, "social-csv", ["ord", "venue", F.lit(1).alias("likes"), caption, "event_date"],
                      ["event_date", caption, "ord", "venue"])
    return readers.scan_social_events(spark, path)


@query
def scan_ticketed_events(spark, sf):
    rows = st.raw_tickets(_events(spark, sf)).withColumn("day", F.substring("datetime", 1, 10))
    path = _day_files(rows, "tickets-csv", ["venue", "datetime", "name", "ord"], ["ord", "name", F.lit(5).alias("price"), "venue", "datetime"])
    return readers.scan_ticketed_events(spark, path)


@query
def scan_measures(spark, sf):
    rows = st.raw_measures(_events(spark, sf)).select(
        "date_end", F.lit("x").alias("note"), "Country", "Response_measure", "date_start")
    return readers.scan_measures(spark, _csv_path(rows, "measures-csv"))


@query
def scan_cases(spark, sf):
    rows = st.raw_cases(_events(spark, sf)).select(F.lit(1).alias("day"), "geoId", "deaths", "cases", "dateRep")
    return readers.scan_cases(spark, _csv_path(rows, "cases-csv"))


def _files(documents: DataFrame, key: str, name: str) -> str:
    """One file for each document, all in one folder: it is listed at once, while a folder of
    their own would cost each file a listing task and a step of the commit."""
    path = fresh_path(documents.sparkSession, name)
    documents.repartition(F.col(key)).select("document").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query
def scan_documents(spark, sf):
    """Stringency files read whole, then parsed."""
    docs = st.stringency_documents(_events(spark, sf)).withColumn("day", F.substring("document", 3, 10))
    found = readers.scan_documents(spark, _files(docs, "day", "stringency"))
    records = indicators.stringency_records(found, CFG.country_code)
    return indicators.stringency_series(records, CFG.stringency_horizon_days)


@query
def scan_posts(spark, sf):
    docs = st.post_documents(_events(spark, sf), per_account=True).withColumn("part", F.xxhash64("document").cast("string"))
    rows = readers.scan_posts(spark, _files(docs, "part", "posts"))
    return extract.posts_to_events(rows, CFG.zone).drop("venue")


@query
def scan_ticket_pages(spark, sf):
    docs = st.ticket_documents(_events(spark, sf)).withColumn("page", F.xxhash64("document").cast("string"))
    return extract.ticket_pages_to_events(readers.scan_ticket_pages(spark, _files(docs, "page", "pages")))


@query
def scan_school_years(spark, sf):
    docs = st.school_years(_events(spark, sf)).select(F.to_json(F.struct("content")).alias("document"))
    docs = docs.withColumn("week", F.xxhash64("document").cast("string"))
    rows = readers.scan_school_years(spark, _files(docs, "week", "school"))
    return indicators.vacation_calendar(rows)
