"""Calendar features, one-hot and cyclic encodings, date flags and the future grid."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clock
from stationflow.operators.shared import flag

# Hours that count as peak.
PEAK_HOURS = (7, 8, 17, 18)


def station_slice(flows: DataFrame, *stations: str) -> DataFrame:
    return flows.where(F.col("station").isin(*stations))


def _date_parts(date: Column) -> dict[str, Column]:
    # ISO week beside the calendar year: the two disagree around New Year, as intended.
    return {
        "week": F.weekofyear(date),
        "month": F.month(date),
        "year": F.year(date),
        "weekday": F.weekday(date),
    }


def calendar_features(flows: DataFrame, stations: Sequence[str] | None = None) -> DataFrame:
    """Hour, timestamp and date parts from ``date`` and ``hour_band``."""
    if stations:
        flows = station_slice(flows, *stations)
    return flows.withColumns({
        "hour": F.substring("hour_band", 1, 2).cast("int"),
        "ts": clock.join_date_time("date", "substring(hour_band, 1, 5)"),
        **_date_parts(F.col("date")),
    }).drop("hour_band")


def one_hot(df: DataFrame) -> DataFrame:
    """0/1 columns for 24 hours and 7 weekdays; the set does not depend on the data."""
    columns = {f"hour_{h}": F.expr(f"IF(hour = {h}, 1, 0)") for h in range(24)}
    columns |= {f"weekday_{d}": F.expr(f"IF(weekday = {d}, 1, 0)") for d in range(7)}
    return df.withColumns(columns)


def peak_period(df: DataFrame) -> DataFrame:
    return df.withColumn("peak_period", flag(F.col("hour").isin(*PEAK_HOURS)))


def cyclic_features(df: DataFrame, period: str = "observed") -> DataFrame:
    """sin/cos of hour, month and weekday.

    ``period="observed"`` divides by the largest value in ``df``, ``"fixed"`` by 23, 12
    and 6. The maxima come from one scalar subquery, so no join is planned.
    """
    parts = ("hour", "month", "weekday")
    if period == "fixed":
        limits = {"hour": F.lit(23), "month": F.lit(12), "weekday": F.lit(6)}
    else:
        top = df.agg(F.struct(*[F.max(p).alias(p) for p in parts]).alias("top")).scalar()
        limits = {p: top.getField(p) for p in parts}
    columns = {}
    for part in parts:
        angle = F.lit(2 * math.pi) * F.try_divide(F.col(part), limits[part])
        columns[f"cos_{part}"] = F.cos(angle)
        columns[f"sin_{part}"] = F.sin(angle)
    return df.withColumns(columns)


def calendar_flags(df: DataFrame, holidays: DataFrame, vacations: DataFrame) -> DataFrame:
    """0/1 membership of ``date`` in the holiday and vacation dates.

    Both sides are made distinct; how they are joined is left to adaptive execution.
    """
    for name, dates in (("holiday", holidays), ("vacation", vacations)):
        marked = dates.select("date").where("date IS NOT NULL").distinct().withColumn("_on", F.lit(1))
        df = df.join(marked, "date", "left").withColumn(
            name, F.coalesce("_on", F.lit(0))).drop("_on")
    return df


def future_grid(stations: DataFrame, as_of: datetime | Column, horizon_hours: int = 168) -> DataFrame:
    """One row per station and hour from ``as_of`` (cut to the hour) on."""
    start = as_of if isinstance(as_of, Column) else F.lit(as_of).cast(clock.NTZ)
    grid = stations.select("station").distinct().withColumn("_as_of", start)
    step = F.explode(F.sequence(F.lit(0), F.lit(horizon_hours - 1)))
    grid = grid.withColumn("_step", step).select(
        "station", (clock.hour_floor("_as_of") + F.expr("make_dt_interval(0, _step)")).alias("ts"))
    grid = grid.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})
    return grid.withColumns(_date_parts(F.col("date")))
