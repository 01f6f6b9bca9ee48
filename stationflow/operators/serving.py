"""Serving of forecasts, the model log and the saved configuration."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.config import PUBLISHED_KEYS, SELECTABLE_FEATURES, ForecastConfig
from stationflow.operators.analysis import crowding_flag
from stationflow.operators.shared import keep_first, union_all

# Options that are reported as enabled, setting -> text.
REPORTED_OPTIONS = {
    "UseNormalizedVisitors": "useNormalizedVisitors:true",
    "UseEventStationDistance": "useEventStationDistance:true",
    "IncludeInstagramEvents": "includeInstagramEvents:true",
    "IncludeTicketmasterEvents": "includeTicketmasterEvents:true",
    "UseTimeOfEvents": "useTimeOfEvents:true",
}
# Log columns beside station, model and settings.
METRIC_COLUMNS = ("R-squared", "MAE", "RMSE")
FEATURE_COLUMNS = {
    "Global radiation": "global_radiation",
    "Check-ins week ago": "check_ins_week_ago",
    "Check-outs week ago": "check_outs_week_ago",
}
LOG_KEYS = ("Station", *FEATURE_COLUMNS, *PUBLISHED_KEYS)


def forecast_serving(forecasts: DataFrame, day: date | Column, station: str | None = None,
                     thresholds: DataFrame | None = None) -> DataFrame:
    """Rows of one day from each station's newest run, with total and crowding flag.

    ``forecasts`` carries ``station, run_ts, date, hour`` and both predictions. The
    newest run is a one-row-per-station aggregate, not a sort of all forecasts.
    """
    if station is not None:
        forecasts = forecasts.where(F.col("station") == station)
    newest = forecasts.groupBy("station").agg(F.max("run_ts").alias("run_ts"))
    wanted = forecasts.where(F.col("date") == (day if isinstance(day, Column) else F.lit(day)))
    rows = wanted.join(newest, ["station", "run_ts"])
    total = F.col("check_ins_predicted") + F.col("check_outs_predicted")
    return crowding_flag(rows, total, thresholds)


def model_log_rows(metrics: DataFrame, cfg: ForecastConfig, features: Sequence[str],
                   model: str = "RandomForestRegressor") -> DataFrame:
    """Log rows (one per station) in the published column layout."""
    settings = {k: F.lit(v) for k, v in cfg.published().items()}
    switches = {k: F.lit(f in features) for k, f in FEATURE_COLUMNS.items()}
    scores = {k: F.bround(F.col(c), 3) for k, c in zip(METRIC_COLUMNS, ("r2", "mae", "rmse"), strict=True)}
    return metrics.select(
        F.col("station").alias("Station"), F.lit(model).alias("Model"),
        *[c.alias(k) for k, c in (settings | scores | switches).items()])


def model_log(old: DataFrame | None, new: DataFrame, keep: str = "first") -> DataFrame:
    """Old and new log rows united; of equal keys the old row stays.

    ``keep="latest"`` lets the new row replace it.
    """
    frames = [new.withColumn("_age", F.lit(1))]
    if old is not None:
        frames.insert(0, old.withColumn("_age", F.lit(0)))
    order = F.asc("_age") if keep == "first" else F.desc("_age")
    scores = [F.col(f"`{m}`") for m in METRIC_COLUMNS]
    merged = keep_first(union_all(frames), [F.col(f"`{k}`") for k in LOG_KEYS], [order, *scores])
    return merged.drop("_age")


def active_features(columns: Sequence[str], measures: Sequence[str] = ()) -> list[str]:
    """Selectable features and indicators that a saved forecast was made with.

    Looks at column names only, under their published or internal spelling. ``measures``
    lists the columns of measures; any of them present adds the option ``measures``.
    """
    present = {c.replace("check-", "check_") for c in columns}
    found = [f for f in (*SELECTABLE_FEATURES, "stringency", "cases", "deaths") if f in present]
    return found + ["measures"] * bool(present & set(measures))


def config_flags(documents: DataFrame, column: str = "document") -> DataFrame:
    """Adds ``enabled``, the list of switched-on event options, to JSON documents."""
    schema = ", ".join(f"{k} {'boolean' if t is bool else 'int'}" for k, (_, t) in PUBLISHED_KEYS.items())
    parsed = documents.withColumn("_config", F.from_json(column, schema))
    options = [F.when(F.col("_config")[key], F.lit(text)) for key, text in REPORTED_OPTIONS.items()]
    return parsed.withColumn("enabled", F.array_compact(F.array(*options))).drop("_config")


def config_document(*settings: Column) -> Column:
    """JSON text of the 13 settings, given in the published order."""
    named = [c.alias(k) for k, c in zip(PUBLISHED_KEYS, settings, strict=True)]
    return F.to_json(F.struct(*named))


def config_rows(spark, cfg: ForecastConfig) -> DataFrame:
    """One row with the configuration as a JSON document."""
    return spark.range(1).select(
        config_document(*[F.lit(v) for v in cfg.published().values()]).alias("document"))
