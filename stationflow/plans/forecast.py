"""The whole run: sources to enriched flows, forests and a one-week forecast."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.config import ForecastConfig
from stationflow.operators import calendar, events, features, flows, forests, indicators, splits, weather
from stationflow.operators.serving import model_log_rows
from stationflow.operators.shared import fixed_table
from stationflow.operators.trees import Forest
from stationflow.session import materialise, materialise_counted, run_folder
from stationflow.sources import sinks
from stationflow.sources.readers import Sources


@dataclass(frozen=True)
class Prepared:
    """Enriched flows of the past and the side tables of the future."""

    rows: DataFrame
    future_dims: features.Dimensions


@dataclass(frozen=True)
class Trained:
    models: Forest
    metrics: DataFrame
    log_rows: DataFrame


def prepare(src: Sources, cfg: ForecastConfig, as_of: date, measures: dict[str, str],
            forecast_place: str | None = None) -> Prepared:
    """Flows joined with all side tables, written once to the shared folder."""
    ins, outs = flows.normalise_trips(src.ins, "in"), flows.normalise_trips(src.outs, "out")
    hourly = flows.hourly_flows(ins, outs)
    hourly = calendar.calendar_features(hourly, cfg.stations)
    unified, seen = materialise_counted(
        events.events_unified(src.sheet, src.posts, src.tickets, cfg), "events", events.unknown_venues())
    if seen["events"]:
        warnings.warn(f"{seen['events']} events at venues without coordinates: {', '.join(seen['venues'])}", stacklevel=2)
    typed, seen = materialise_counted(src.measures, "measures-typed", {"names": indicators.unlisted(cfg.country, measures)})
    if seen["names"] and cfg.use_measures:
        warnings.warn(f"measures without a column are left out: {', '.join(seen['names'])}", stacklevel=2)
    scored = events.events_normalized(unified).withColumns({
        "visitors": F.col("visitors_normalized"),
        "ord": F.col("source_rank").cast("bigint") * (1 << 56) + F.col("ord")})
    spark = hourly.sparkSession
    # From the first raw date to the last; the flows themselves are not planned for it.
    span = ins.select("date").unionByName(outs.select("date")).agg(
        F.year(F.min("date")).alias("a"), F.year(F.max("date")).alias("b")).where("a IS NOT NULL")
    years = span.select(F.explode(F.sequence("a", "b")).alias("year")).unionByName(
        fixed_table(spark, [(as_of.year,), (as_of.year + 1,)], ["year"]))
    dims = features.Dimensions(
        weather=weather.weather_history(src.weather, cfg.weather_station, cfg.zone, cfg.weather_hour_mode),
        stringency=indicators.stringency_series(
            indicators.stringency_records(src.stringency, cfg.country_code), cfg.stringency_horizon_days),
        measures=indicators.measures_daily(typed, cfg.country, measures, as_of),
        cases=indicators.cases_deaths(src.cases, cfg.geo_id, cfg.case_date_format),
        holidays=indicators.holiday_calendar(years),
        vacations=indicators.vacation_calendar(src.school_years, cfg.vacation_shift_days),
        events=scored,
        distances=events.venue_distances(
            spark, cfg.stations, {name: (lat, lon) for name, lat, lon in cfg.station_points}),
    )
    # Read again for the future: small tables whose raw files need no second pass.
    dims = replace(
        dims,
        stringency=materialise(dims.stringency, "stringency"),
        measures=materialise(dims.measures, "measures"),
        cases=materialise(dims.cases, "cases"),
        vacations=materialise(dims.vacations, "vacations"),
    )
    rows = materialise(features.enrich(hourly, dims, cfg), "enriched", ("station",))
    # One place, or all records taken as one: either way one row per date and hour.
    if forecast_place is not None:
        predictions = src.predictions.where(F.col("loc") == forecast_place)
    else:
        predictions = src.predictions.withColumn("loc", F.lit("all"))
    ahead = weather.weather_forecast(
        predictions, cfg.zone, cfg.forecast_shift_hours, cfg.forecast_fill_hours)
    return Prepared(rows, replace(dims, weather=ahead.drop("loc")))


def clean(rows: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """One-sided gaps filled, then the counts of a week ago."""
    filled = forests.impute(rows, cfg).where("check_ins IS NOT NULL AND check_outs IS NOT NULL")
    return materialise(features.week_ago(filled, fallback=cfg.week_ago_fallback), "clean", ("station",))


def train_and_score(rows: DataFrame, model_features: list[str], cfg: ForecastConfig) -> Trained:
    """Scores on the last week with a model that has not seen it, then fits on all rows.

    Warns about stations whose score is below the line.
    """
    matrix = features.feature_matrix(rows, model_features)
    labelled = materialise(splits.split_labels(matrix), "labelled", ("station",))
    trial = forests.train(labelled.where("split <> 'test'"), model_features, cfg)
    scored = forests.predict(trial, labelled.where("split = 'test'"), model_features)
    metrics, seen = materialise_counted(splits.forecast_metrics(scored), "metrics", {"low": splits.below_line()})
    for station, r2 in seen["low"]:  # at most one per station
        warnings.warn(f"model for {station} shows unexpected performance: R2 {r2:.3f}", stacklevel=2)
    final = forests.train(labelled, model_features, cfg)
    return Trained(final, metrics, model_log_rows(metrics, cfg, model_features))


def forecast(trained: Trained, history: DataFrame, dims: features.Dimensions, model_features: list[str],
             cfg: ForecastConfig, as_of: datetime) -> DataFrame:
    """Both predictions for every complete hour of the week from ``as_of`` on.

    Warns about hours that lack a feature and about stations without a model.
    """
    future, left_out = materialise_counted(
        features.future_features(history, dims, cfg, as_of, model_features), "future",
        forests.incomplete(model_features, cfg.stations))
    for station in cfg.stations:
        if left_out[station]:
            warnings.warn(f"{left_out[station]} hours of {station} lack a feature and get no forecast", stacklevel=2)
        if station not in trained.models.models:
            warnings.warn(f"{station} has no rows to learn from and gets no forecast", stacklevel=2)
    return forests.predict(trained.models, future, model_features)


def run_forecast(src: Sources, cfg: ForecastConfig, as_of: datetime, measures: dict[str, str] | None, out: str,
                 forecast_place: str | None = None) -> DataFrame:
    """Everything above in order; saves forecast, model log and configuration under ``out``.

    ``measures`` maps measure names to columns; None takes every measure of the country.
    Each run plans anew from ``cfg``, so every switch takes effect. Intermediate tables are
    removed at the end; the returned rows are read from what was saved.
    """
    if not cfg.features:
        raise ValueError("choose at least one feature")
    spark = src.ins.sparkSession
    if measures is None:
        measures = indicators.measure_columns(src.measures, cfg.country) if cfg.use_measures else {}
    model_features = cfg.model_features(tuple(measures.values()))
    with run_folder(spark):
        prepared = prepare(src, cfg, as_of.date(), measures, forecast_place)
        rows = clean(prepared.rows, cfg)
        trained = train_and_score(rows, model_features, cfg)
        predictions = forecast(trained, rows, prepared.future_dims, model_features, cfg, as_of)
        sinks.save_forecasts(predictions, f"{out}/forecasts", as_of)
        sinks.save_model_log(trained.log_rows, f"{out}/model-log", as_of)
        sinks.save_config(spark, cfg, f"{out}/config")
    saved = sinks.read_forecasts(spark, f"{out}/forecasts", newest=False)
    saved = saved.where(F.col("run_ts") == F.lit(as_of).cast("timestamp_ntz")).drop("run_ts", "run_date")
    sinks.publish_forecasts(saved, f"{out}/published", as_of.date())
    return saved
