"""Observed and predicted weather per local date and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.functions import clock
from stationflow.operators.shared import keep_first, safe_sequence, unique

# Observation codes and their names.
OBSERVED = {
    "DD": "wind_direction", "FH": "wind_speed_h", "FF": "wind_speed", "FX": "wind_gust",
    "T": "temperature", "T10N": "temperature_min", "TD": "dew_point_temperature",
    "SQ": "radiation_duration", "Q": "global_radiation",
    "DR": "precipitation_duration", "RH": "precipitation_h",
    "P": "pressure", "VV": "sight", "N": "cloud_cover", "U": "relative_humidity",
    "WW": "weather_code", "IX": "weather_index",
    "M": "fog", "R": "rain", "S": "snow", "O": "thunder", "Y": "ice",
}
# Observations delivered in tenths of their unit.
TENTHS = (
    "wind_speed", "wind_gust", "temperature", "temperature_min", "dew_point_temperature",
    "radiation_duration", "precipitation_duration", "precipitation_h", "pressure",
)
# Forecast codes and their names.
PREDICTED = {
    "windr": "wind_direction", "rv": "relative_humidity", "luchtd": "pressure",
    "temp": "temperature", "windb": "wind_force", "winds": "wind_speed",
    "gust": "wind_gust", "vis": "sight_m", "neersl": "precipitation_h",
    "gr": "global_radiation", "tw": "clouds",
}
FORECAST_KEPT = (
    "wind_direction", "relative_humidity", "pressure", "temperature", "wind_speed",
    "sight_m", "precipitation_h", "global_radiation", "clouds",
)


def weather_history(raw: DataFrame, station_code: str, zone: str,
                    hour_mode: str = "local") -> DataFrame:
    """One row per (date, hour) for one weather station.

    Hours 1-24 are UTC hour ends. ``hour_mode="utc_hour"`` keeps the UTC hour beside the
    local date. The two readings of the hour that repeats in autumn are averaged. Of several
    readings for one UTC hour the one with the greatest ``revision`` is valid; without that
    column different readings for one hour fail the run.
    """
    readings = raw.where(F.col("station_code").cast("string") == station_code)
    if "revision" in raw.columns:
        values = sorted(c for c in raw.columns if c not in ("date", "hour", "revision"))
        readings = keep_first(readings, ["date", "hour"], [F.desc("revision"), *values]).drop("revision")
    else:
        readings = unique(readings.dropDuplicates(), "date", "hour")
    readings = readings.withColumnsRenamed(OBSERVED)
    names = [n for n in OBSERVED.values() if n != "weather_code" and n in readings.columns]
    utc = clock.utc_at_hour("CAST(date AS string)", "hour - 1")
    timed = readings.withColumn("_utc", utc).withColumn("_local", clock.utc_to_local("_utc", zone))
    typed = timed.selectExpr(
        "to_date(_local) AS date", f"hour({'_local' if hour_mode == 'local' else '_utc'}) AS hour",
        *[f"try_cast({n} AS double) AS {n}" for n in names])
    return typed.groupBy("date", "hour").agg(
        *[F.expr(f"avg({n}) / 10 AS {n}" if n in TENTHS else f"avg({n}) AS {n}") for n in names])


def latest_predictions(raw: DataFrame, shift_hours: int = 1) -> DataFrame:
    """Per place and hour the prediction made last (smallest offset), in UTC."""
    renamed = raw.withColumnsRenamed(PREDICTED)
    kept = [n for n in FORECAST_KEPT if n in renamed.columns]
    typed = renamed.select(
        "loc",
        clock.utc_from_epoch("tijd", shift_hours).alias("ts"),
        F.expr("CAST(offset AS double) AS offset_h"),
        *[F.expr(f"try_cast({n} AS double) AS {n}") for n in kept],
    )
    # Remaining ties are broken by the values themselves, so reruns agree; exact duplicates
    # fall away here too and need no shuffle of their own.
    return keep_first(typed, ["loc", "ts"], ["offset_h", *kept]).drop("offset_h")


def fill_hours(rows: DataFrame, limit: int = 11) -> DataFrame:
    """Hourly series per ``loc``: each row is carried forward up to ``limit`` hours.

    A row only needs to know its successor within ``limit`` hours. So rows are cut into
    blocks of ``limit + 1`` hours, each block also sees the next block's times, and the
    look-ahead runs inside (loc, block): no place ends up in one task whole. The last
    row of a place, where its series ends, is its own successor.
    """
    block_hours = limit + 1
    values = [c for c in rows.columns if c not in ("loc", "ts")]
    block = F.floor(clock.hour_index("ts") / block_hours).cast("int")
    own = rows.withColumns({"_block": block, "_own": F.lit(True)})
    marks = rows.select("loc", "ts", (block - 1).alias("_block"))
    ends = rows.groupBy("loc").agg(F.max("ts").alias("ts")).withColumn("_block", block)
    marks = marks.unionByName(ends).withColumn("_own", F.lit(False))
    both = own.unionByName(marks, allowMissingColumns=True)
    window = Window.partitionBy("loc", "_block").orderBy("ts", F.desc("_own"))
    lined = both.withColumn("_next", F.lead("ts").over(window)).where("_own")

    low = clock.hour_index_up("ts")
    reach = clock.hour_index(f"(ts + {clock.span(limit)})")
    # Hours strictly before the successor.
    before_next = clock.hour_index_up("_next") - 1
    is_last = F.col("_next") == F.col("ts")
    high = F.when(is_last, clock.hour_index("ts")).otherwise(F.least(reach, before_next))
    return lined.select("loc", F.explode(safe_sequence(low, high)).alias("hour_index"), *values)


def weather_forecast(raw: DataFrame, zone: str, shift_hours: int = 1,
                     fill_limit: int = 11) -> DataFrame:
    """One row per place, local date and hour, gaps filled forward."""
    rows = latest_predictions(raw, shift_hours)
    if "clouds" in rows.columns:
        rows = rows.withColumn("cloud_cover", F.col("clouds") / 12.5)
    if "sight_m" in rows.columns:
        rows = rows.withColumn("sight", F.col("sight_m") / 333)
    filled = fill_hours(rows, fill_limit)
    values = [c for c in filled.columns if c not in ("loc", "hour_index")]
    placed = filled.withColumn("_local", clock.local_from_index("hour_index", zone))
    # Two hours share a local date and hour only where the clocks change less than a day away.
    day_before, day_after = (clock.local_from_index(f"(hour_index {d} 24)", zone) for d in "-+")
    changing = F.unix_timestamp(day_after) - F.unix_timestamp(day_before) != 48 * 3600
    keyed = placed.withColumn("_changing", changing).selectExpr(
        "loc", "to_date(_local) AS date", "hour(_local) AS hour", *values, "_changing")
    # The hour that repeats in autumn gives two rows; their mean keeps the key unique. Other
    # hours are not grouped: filled, they are many times the rows read, and a task would hold them.
    steady = keyed.where("NOT _changing").selectExpr(
        "loc", "date", "hour", *[f"CAST({v} AS double) AS {v}" for v in values])
    return steady.unionByName(keyed.where("_changing").groupBy("loc", "date", "hour").agg(*[F.expr(f"avg({v}) AS {v}") for v in values]))
