"""Score of planned events near a station, per hour or per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.config import ForecastConfig
from stationflow.functions import clock
from stationflow.operators.shared import safe_sequence, text_array, unique


def _first_visitors() -> list[Column]:
    """Per group: number of events, and visitors of the first event that has them."""
    return [F.expr(text) for text in (
        "count(*) AS n",
        "min_by(visitors, ord) FILTER (WHERE visitors IS NOT NULL) AS visitors",
        "min(ord) FILTER (WHERE visitors IS NOT NULL) AS ord",
    )]


def _merge_first() -> list[Column]:
    return [F.expr(t) for t in ("sum(n) AS n", "min_by(visitors, ord) AS visitors", "min(ord) AS ord")]


def event_slots(events: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """(slot, venue, n, visitors, ord): events that touch a slot, one row per venue.

    A slot is an hour index, or a day number when event times are off. All events of a
    venue share their distance to a station, so within a venue only the first one with
    visitors can decide the score; the rest is a count. Events are therefore reduced to
    one row per venue and set of hours *before* they are laid out in hours, which also
    takes the weight out of busy hours and venues.
    """
    base = events.select("venue", "date", "start_ts", "end_ts", "visitors", "ord")
    if not cfg.use_event_time:
        days = base.where("date IS NOT NULL").withColumn("slot", F.unix_date("date"))
        return days.groupBy("slot", "venue").agg(*_first_visitors())
    before = clock.span(cfg.hours_before, cfg.minutes_before)
    after = clock.span(cfg.hours_after, cfg.minutes_after)
    spans = base.select(
        "venue", "visitors", "ord",
        clock.hour_index_up(f"(start_ts - {before})").alias("a1"),
        clock.hour_index("start_ts").alias("b1"),
        clock.hour_index_up("end_ts").alias("a2"),
        clock.hour_index(f"(end_ts + {after})").alias("b2"),
    ).where("b1 IS NOT NULL OR b2 IS NOT NULL")
    reduced = spans.groupBy("venue", "a1", "b1", "a2", "b2").agg(*_first_visitors())
    windows = [safe_sequence(F.col("a1"), F.col("b1")), safe_sequence(F.col("a2"), F.col("b2"))]
    if cfg.cover_show:
        windows.append(safe_sequence(F.col("a1"), F.col("b2")))
    slots = reduced.select(
        "venue", "n", "visitors", "ord",
        F.explode(F.array_distinct(F.concat(*windows))).alias("slot"))
    return slots.groupBy("slot", "venue").agg(*_merge_first())


def event_scores(events: DataFrame, distances: DataFrame, cfg: ForecastConfig,
                 stations: Sequence[str]) -> DataFrame:
    """(station, slot, planned_event, events) for slots with at least one event.

    A venue without a distance counts as infinitely far, so it never hides a known one. The
    join with ``distances`` is left to adaptive execution.
    """
    slots = event_slots(events, cfg).withColumn(
        "station", F.explode(text_array(stations)))
    if cfg.use_distance:
        known = distances.select("venue", "station", "distance_km")
        slots = slots.join(unique(known, "venue", "station"), ["venue", "station"], "left")
        km = F.coalesce("distance_km", F.lit(float("inf")))
    else:
        km = F.lit(0.0)
    slots = slots.withColumn("km", km)
    totals = slots.groupBy("station", "slot").agg(*[F.expr(text) for text in (
        "sum(n) AS events",
        "min(km) AS near",
        "min(km) FILTER (WHERE ord IS NOT NULL) AS near_visited",
        "min_by(visitors, struct(km, ord)) FILTER (WHERE ord IS NOT NULL) AS visitors",
    )])
    if cfg.use_attendance:
        score = "IF(near_visited IS NULL, 0.5D / (1 + near), visitors / (1 + near_visited))"
    else:
        score = "1D / (1 + near)"
    return totals.selectExpr("station", "slot", f"{score} AS planned_event", "events")


def planned_event(hours: DataFrame, events: DataFrame, distances: DataFrame,
                  cfg: ForecastConfig) -> DataFrame:
    """Adds ``planned_event`` to rows with ``station``, ``date`` and ``hour``.

    ``events`` needs ``venue, date, start_ts, end_ts, visitors, ord``; ``visitors`` is the
    normalised attendance. Rows without an event score 0.
    """
    scores = event_scores(events, distances, cfg, cfg.stations).drop("events")
    slot = F.unix_date("date")
    if cfg.use_event_time:
        slot = slot * 24 + F.col("hour")
    joined = hours.withColumn("slot", slot).join(scores, ["station", "slot"], "left")
    return joined.withColumn("planned_event", F.coalesce("planned_event", F.lit(0.0))).drop("slot")
