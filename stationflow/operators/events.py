"""Venue events: cleaning, one table from three sources, distances."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.config import ForecastConfig
from stationflow.functions import clock
from stationflow.functions.geo import STATION_POINTS, VENUES, geodesic_km
from stationflow.operators.shared import fixed_table, keep_first, text_map, union_all

# The footer row of the event sheet and the place that is left out.
SHEET_FOOTER = "Niet bijzonder evenementen zijn hierboven niet meegenomen."
PLACE_OTHER = "Overig"

# Social account -> venue.
ACCOUNT_VENUES = {
    "ziggodome": "Ziggo Dome",
    "paradisoadam": "Paradiso",
    "afaslive": "Afas Live",
    "johancruijffarena": "Arena",
    "melkwegamsterdam": "Melkweg",
    "theatercarre": "Royal Theater Carré",
    "beursvanberlageofficial": "Beurs van Berlage",
    "concertgebouw": "Concertgebouw",
    "olympischstadion": "Olympisch Stadion",
}
# Spellings that are brought to one name.
VENUE_SPELLINGS = {
    "Koninklijk Theater Carre": "Royal Theater Carré",
    "Ziggo dome": "Ziggo Dome",
    "Ziggo Dome (2x)": "Ziggo Dome",
}
# Matches that no source lists, (venue, date).
MANUAL_EVENTS = (
    ("Arena", date(2020, 1, 19)), ("Arena", date(2020, 2, 2)),
    ("Arena", date(2020, 2, 16)), ("Arena", date(2020, 1, 3)),
    ("Arena", date(2021, 6, 13)), ("Arena", date(2021, 6, 17)),
    ("Arena", date(2021, 6, 21)), ("Arena", date(2021, 6, 26)),
)
EPOCH_PREFIX = "1899-12-30 "
EVENT_COLUMNS = ("source_rank", "ord", "venue", "event_name", "date", "start_show", "start_ts",
                 "end_ts", "visitors")


def _mapped(column: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(text_map(values), column)


def events_clean(sheet: DataFrame, with_time: bool = True) -> DataFrame:
    """Sheet rows that stand for an event.

    Expects the raw columns ``Datum`` (text), ``Locatie``, ``Naam evenement``,
    ``Start show``, ``Einde show`` and ``Aantal bezoekers``.
    """
    raw = ["Datum", "Locatie", "Naam evenement", "Start show", "Einde show", "Aantal bezoekers"]
    rows = sheet.dropna("all", subset=raw).where(
        F.coalesce(F.col("Datum") != SHEET_FOOTER, F.lit(True))
        & F.col("Locatie").isNotNull() & (F.col("Locatie") != PLACE_OTHER))
    return rows.dropna(subset=["Start show"]) if with_time else rows


def short_time(text: Column) -> Column:
    """``HH:mm`` of a time text that may carry the spreadsheet epoch."""
    return F.substring(F.replace(text, F.lit(EPOCH_PREFIX), F.lit("")), 1, 5)


def event_times(rows: DataFrame, roll_midnight: bool = False) -> DataFrame:
    """Adds date, ``HH:mm`` start and start/end timestamps to cleaned sheet rows.

    A text that is no time of day gives a null timestamp. ``roll_midnight`` moves an end
    before the start to the next day.
    """
    timed = rows.withColumns({
        "date": clock.parse_date_text("CAST(Datum AS string)"),
        "start_show": short_time(F.col("Start show")),
        "_end_show": short_time(F.col("Einde show")),
    }).withColumns({
        "start_ts": clock.join_date_time("date", "start_show"),
        "end_ts": clock.join_date_time("date", "_end_show"),
    }).drop("_end_show")
    if roll_midnight:
        timed = timed.withColumn(
            "end_ts", F.expr(f"IF(end_ts < start_ts, end_ts + {clock.span(24)}, end_ts)"))
    return timed


def from_sheet(sheet: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Event columns from the sheet. ``ord`` gives the row order within the source."""
    rows = events_clean(sheet, cfg.use_event_time)
    rows = event_times(rows, cfg.roll_midnight)
    if not cfg.use_event_time:
        nothing = F.lit(None).cast(clock.NTZ)
        rows = rows.withColumns({"start_ts": nothing, "end_ts": nothing})
    return rows.select(
        F.lit(0).alias("source_rank"), "ord", F.col("Locatie").alias("venue"),
        F.col("Naam evenement").alias("event_name"), "date", "start_show", "start_ts", "end_ts",
        F.col("Aantal bezoekers").cast("double").alias("visitors"))


def _dated(rows: DataFrame, rank: int, ts: Column, venue: Column, name: Column) -> DataFrame:
    return rows.select(
        F.lit(rank).alias("source_rank"), "ord", venue.alias("venue"), name.alias("event_name"),
        ts.alias("start_ts")).withColumns({
            "date": F.to_date("start_ts"),
            "start_show": clock.clock_text("start_ts"),
            "end_ts": F.lit(None).cast(clock.NTZ),
            "visitors": F.lit(None).cast("double")})


def from_posts(posts: DataFrame) -> DataFrame:
    """Event columns from parsed posts (``ord``, ``venue`` = account, ``event_date``).

    An unknown account keeps its name, see :func:`unknown_venues`.
    """
    ts = F.col("event_date").cast("string").try_cast(clock.NTZ)
    venue = F.coalesce(_mapped(F.col("venue"), ACCOUNT_VENUES), F.col("venue"))
    return _dated(posts, 1, ts, venue, F.lit(None).cast("string"))


def from_tickets(tickets: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Event columns from ticketed events (``ord``, ``name``, ``venue``, ``datetime`` UTC text)."""
    text = f"try_cast(regexp_replace(datetime, 'Z$', '') AS {clock.NTZ})"
    ts = clock.utc_to_local(text, cfg.zone) if cfg.ticket_zone_mode == "local" else F.expr(text)
    return _dated(tickets, 2, ts, F.col("venue"), F.col("name"))


def manual_events(spark) -> DataFrame:
    rows = [(3, i, venue, day) for i, (venue, day) in enumerate(MANUAL_EVENTS)]
    listed = fixed_table(spark, rows, ["source_rank", "ord", "venue", "date"])
    return listed.withColumn("source_rank", F.col("source_rank").cast("int"))


def one_spelling(venue: Column) -> Column:
    trimmed = F.trim(venue)
    return F.coalesce(_mapped(trimmed, VENUE_SPELLINGS), trimmed)


def events_unified(sheet: DataFrame, posts: DataFrame | None, tickets: DataFrame | None,
                   cfg: ForecastConfig) -> DataFrame:
    """One event table: sources united, venues in one spelling, duplicates dropped.

    Of equal (venue, date, start) the first by source, then by row, is kept.
    """
    frames = [from_sheet(sheet, cfg)]
    if cfg.include_social_events and posts is not None:
        frames.append(from_posts(posts))
    if cfg.include_ticketed_events and tickets is not None:
        frames.append(from_tickets(tickets, cfg))
    listed = union_all(frames).withColumn("venue", one_spelling(F.col("venue")))
    recent = listed.where(F.year("date") >= cfg.first_event_year)
    everything = union_all([recent, manual_events(sheet.sparkSession)])
    return keep_first(everything.select(*EVENT_COLUMNS), ["venue", "date", "start_show"],
                      ["source_rank", "ord"])


def events_normalized(events: DataFrame) -> DataFrame:
    """Adds visitors as a share of the largest attendance."""
    top = events.agg(F.max("visitors")).scalar()
    return events.withColumn("visitors_normalized", F.try_divide("visitors", top))


def venue_distances(spark, stations: Sequence[str] = tuple(STATION_POINTS),
                    points: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(venue, station, distance_km) for all known venues; a fixed, small table.

    ``points`` adds coordinates of stations that are not among the published ones.
    """
    places = STATION_POINTS | (points or {})
    unknown = [s for s in stations if s not in places]
    if unknown:
        raise ValueError(f"no coordinates for stations {unknown}")
    pairs = [(v, s, *VENUES[v], *places[s]) for v in VENUES for s in stations]
    points = fixed_table(spark, pairs, ["venue", "station", "vlat", "vlon", "slat", "slon"])
    km = geodesic_km("vlat", "vlon", "slat", "slon")
    return points.select("venue", "station", km.alias("distance_km"))


def unknown_venues() -> dict[str, Column]:
    """Aggregates of events: how many are at venues without coordinates, which keep a null
    distance, and the venues' names."""
    unknown = ~F.col("venue").isin(*VENUES)
    return {"events": F.count_if(unknown), "venues": F.sort_array(F.collect_set(F.when(unknown, F.col("venue"))))}
