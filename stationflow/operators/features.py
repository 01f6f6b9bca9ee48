"""Enrichment of the hourly flows and the features of past and future rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.config import ForecastConfig
from stationflow.operators import calendar
from stationflow.operators.indicators import fill_from_latest, latest_values
from stationflow.operators.planned_event import planned_event
from stationflow.operators.shared import fixed_table, unique


@dataclass(frozen=True)
class Dimensions:
    """Side tables of the enrichment. All but ``events`` are keyed by date or hour."""

    weather: DataFrame            # date, hour, ...; one row per hour
    stringency: DataFrame         # date, stringency; one row per date
    measures: DataFrame           # date, one 0/1 column per measure; one row per date
    cases: DataFrame              # date, cases, deaths; one row per date
    holidays: DataFrame           # date
    vacations: DataFrame          # date
    events: DataFrame             # venue, date, start_ts, end_ts, visitors, ord
    distances: DataFrame          # venue, station, distance_km


def _measure_columns(measures: DataFrame) -> list[str]:
    return [c for c in measures.columns if c != "date"]


def enrich(flows: DataFrame, dims: Dimensions, cfg: ForecastConfig) -> DataFrame:
    """Left joins of all side tables; gaps of stringency, measures and cases become 0.

    The side tables hold one row per date, the weather one per (date, hour); a second row
    for a key fails the run. Their joins are left to adaptive execution: a side that turns
    out small is broadcast, a larger one is shuffled.
    """
    out = flows.join(unique(dims.weather, "date", "hour"), ["date", "hour"], "left")
    if cfg.use_stringency:
        out = out.join(unique(dims.stringency.select("date", "stringency"), "date"), "date", "left")
        out = out.fillna({"stringency": 0.0})
    out = calendar.calendar_flags(out, dims.holidays, dims.vacations)
    out = planned_event(out, dims.events, dims.distances, cfg)
    if cfg.use_measures and _measure_columns(dims.measures):
        out = out.join(unique(dims.measures, "date"), "date", "left").fillna(
            0, subset=_measure_columns(dims.measures))
    counted = [c for c, on in (("cases", cfg.use_cases), ("deaths", cfg.use_deaths)) if on]
    if counted:
        out = out.join(unique(dims.cases.select("date", *counted), "date"), "date", "left").fillna(
            0.0, subset=counted)
    return out


def week_ago(rows: DataFrame, targets: DataFrame | None = None,
             fallback: str = "same_week") -> DataFrame:
    """Adds counts of one week earlier: same date and hour, else a weekly mean.

    The exact value is taken when a row exists a week earlier, even if its count is null.
    The fallback averages the hour over the row's own (calendar year, ISO week);
    ``"previous_week"`` uses the week of seven days earlier. With ``targets`` (future
    rows) ``rows`` is the history and only targets are returned.

    Both look-ups are window frames over (station, hour), a group that holds one row per
    date, so the table is shuffled once and never joined to itself.
    """
    keyed = rows.withColumn("_past", F.lit(True))
    if targets is not None:
        keep = targets.columns
        lags = ["station", "date", "hour", "year", "week", "check_ins", "check_outs"]
        keyed = keyed.select(*lags, "_past").unionByName(
            targets.withColumn("_past", F.lit(False)), allowMissingColumns=True)
    past = F.col("_past")
    hour = Window.partitionBy("station", "hour")
    exact = hour.orderBy(F.unix_date("date")).rangeBetween(-7, -7)
    if fallback == "same_week":
        week = Window.partitionBy("station", "hour", "year", "week")
    elif fallback == "previous_week":
        # Days of the ISO week before the row's own week.
        monday = F.unix_date("date") - F.weekday("date")
        keyed = keyed.withColumn("_monday", monday)
        week = hour.orderBy("_monday").rangeBetween(-7, -7)
    else:
        raise ValueError(f"unknown fallback {fallback!r}")
    seen = F.count(F.when(past, 1)).over(exact) > 0
    columns = {
        f"{side}_week_ago": F.when(seen, F.avg(F.when(past, F.col(side))).over(exact)).otherwise(
            F.avg(F.when(past, F.col(side))).over(week))
        for side in ("check_ins", "check_outs")
    }
    out = keyed.withColumns(columns).drop("_monday")
    if targets is None:
        return out.drop("_past")
    return out.where(~past).select(*keep, *columns)


def future_features(history: DataFrame, dims: Dimensions, cfg: ForecastConfig,
                    as_of: datetime | Column, features: Sequence[str] | None = None) -> DataFrame:
    """Feature rows of the 168 hours from ``as_of`` on, per station of ``cfg``.

    ``dims.weather`` is the forecast (date, hour, ...). Measures and case counts of days
    not yet known take their latest values; stringency is the last one of the series.
    """
    stations = fixed_table(history.sparkSession, [(s,) for s in cfg.stations], ["station"])
    grid = calendar.future_grid(stations, as_of)
    out = calendar.peak_period(calendar.cyclic_features(grid))
    out = calendar.calendar_flags(out, dims.holidays, dims.vacations)
    out = planned_event(out, dims.events, dims.distances, cfg)
    out = out.join(unique(dims.weather, "date", "hour"), ["date", "hour"], "left")
    if cfg.use_stringency:
        latest = latest_values(dims.stringency, ["stringency"])
        out = out.withColumn("stringency", latest.getField("stringency"))
    if cfg.use_measures and _measure_columns(dims.measures):
        out = fill_from_latest(out, dims.measures, _measure_columns(dims.measures))
    if features is None or {"check_ins_week_ago", "check_outs_week_ago"} & set(features):
        out = week_ago(history, out, cfg.week_ago_fallback)
    counted = [c for c, on in (("cases", cfg.use_cases), ("deaths", cfg.use_deaths)) if on]
    if counted:
        out = fill_from_latest(out, dims.cases, counted)
    if features is not None:
        keys = ["station", "date", "hour"]
        out = out.select(*keys, *[f for f in features if f not in keys])
    return out


def feature_matrix(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Keys, features and targets of complete rows."""
    keys = ["station", "date", "hour"]
    targets = ["check_ins", "check_outs"]
    chosen = rows.select(*keys, *[f for f in features if f not in keys], *targets)
    return chosen.dropna("any")


def training_rows(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``columns`` (all columns by default)."""
    return rows.dropna("any", subset=list(columns) if columns else None)
