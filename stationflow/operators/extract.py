"""Events out of collected documents: social posts, ticket pages and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clock
from stationflow.functions.text import CLOCK, caption_moment, caption_parts, first_link, link_count
from stationflow.operators.shared import flag, text_map

# Nested schemas of the collected documents.
POSTS_SCHEMA = """
struct<GraphImages: array<struct<
  edge_media_preview_like: struct<count: bigint>,
  edge_media_to_comment: struct<count: bigint>,
  taken_at_timestamp: bigint,
  edge_media_to_caption: struct<edges: array<struct<node: struct<text: string>>>>>>>
"""
TICKETS_SCHEMA = """
struct<
  page: struct<totalPages: bigint>,
  _embedded: struct<events: array<struct<
    name: string,
    dates: struct<start: struct<dateTime: string>>,
    _embedded: struct<venues: array<struct<name: string, address: struct<line1: string>>>>>>>>
"""
# Street addresses that decide the venue.
ADDRESS_VENUES = {"Lijnbaansgracht 238": "Lovelee", "Lijnbaansgracht 234 A": "Melkweg"}
# Link to the dated measures file.
MEASURES_LINK = (r"https://www\.ecdc\.europa\.eu/sites/default/files/documents/"
                 r"response_graphs_data_\d{4}-\d{2}-\d{2}.csv")


def parse_documents(texts: DataFrame, schema: str, column: str = "document") -> DataFrame:
    """JSON text column replaced by the fields of ``schema``."""
    parsed = texts.withColumn("_doc", F.from_json(column, schema.strip()))
    others = [c for c in texts.columns if c != column]
    return parsed.select(*others, "_doc.*")


def posts_to_events(posts: DataFrame, zone: str, clock_pattern: str = CLOCK) -> DataFrame:
    """One row per post whose caption names a date and a time.

    ``posts`` holds ``venue`` (the account) and the nested ``GraphImages``. The year comes
    from the local upload time.
    """
    # A plain explode makes the optimizer test the array's size below it, which parses
    # JSON text twice; the outer form does not.
    post = posts.select("venue", F.explode_outer("GraphImages").alias("p"))
    rows = post.where(F.size("p.edge_media_to_caption.edges") > 0).select(
        "venue",
        F.col("p.edge_media_preview_like.count").alias("likes"),
        F.col("p.edge_media_to_comment.count").alias("comments"),
        clock.local_from_epoch("p.taken_at_timestamp", zone).alias("date_uploaded"),
        F.col("p.edge_media_to_caption.edges")[0]["node"]["text"].alias("caption"),
    )
    # The found dates, none or one, are exploded: a filter on them would be pushed below
    # the patterns and run these a second time.
    parts = rows.withColumns(caption_parts("caption", clock_pattern)).withColumn(
        "_found", caption_moment("year(date_uploaded)"))
    dated = parts.withColumn("event_date", F.explode(F.expr("IF(_found IS NULL, array(), array(_found))")))
    return dated.drop("_day_month", "_clock", "_found")


def ticket_venue(event: Column) -> Column:
    """Venue of a ticketed event; two street addresses override its name."""
    venue = event["_embedded"]["venues"][0]
    return F.coalesce(F.try_element_at(text_map(ADDRESS_VENUES), venue["address"]["line1"]), venue["name"])


def ticket_pages_to_events(pages: DataFrame) -> DataFrame:
    """Distinct (name, venue, datetime) of events that have a venue.

    The same page may have been collected several times.
    """
    event = pages.select(F.explode("_embedded.events").alias("e"))
    held = event.where(F.size("e._embedded.venues") > 0)
    return held.select(
        F.col("e.name").alias("name"),
        ticket_venue(F.col("e")).alias("venue"),
        F.col("e.dates.start.dateTime").alias("datetime"),
    ).dropDuplicates()


# Where a ticketed event holds what is taken from it, most usual place first.
TICKET_PATHS = {
    "name": ("$.name",),
    "venue": ("$._embedded.venues[0].name", "$._embedded.venues.name"),
    "address": ("$._embedded.venues[0].address.line1", "$._embedded.venues.address.line1"),
    "datetime": ("$.dates.start.dateTime",),
}
TICKET_FIELDS = ("name", "dates", "_embedded")


def drifting_ticket_pages(documents: DataFrame, column: str = "document") -> DataFrame:
    """name, venue, datetime, unknown, misfits for each event of pages whose shape drifts.

    The pages are read as VARIANT, without a fixed schema: a value is found at any of its places
    and under any type that can be written as text. ``unknown`` lists fields that nothing is
    taken from, ``misfits`` the values that are there but are no text (an object, a list), so
    neither gets lost unseen. A document that is no JSON, null or empty gives one row with the
    misfit ``document``, a page without events none. Repeated pages and events each give their
    rows.
    """
    page = documents.select(F.try_parse_json(F.coalesce(F.col(column), F.lit(""))).alias("page"))
    events = F.when(F.col("page").isNull(), F.array(F.lit(None).cast("variant"))).otherwise(
        F.try_variant_get("page", "$._embedded.events", "array<variant>"))
    event = page.select(F.col("page").isNull().alias("broken"), F.explode(events).alias("e"))

    held = {n: F.coalesce(*[F.try_variant_get("e", path, "variant") for path in paths]) for n, paths in TICKET_PATHS.items()}
    typed = event.select("broken", "e", *[v.alias(f"_{n}") for n, v in held.items()])
    nested = {n: F.coalesce(F.schema_of_variant(f"_{n}").rlike("^(OBJECT|ARRAY)<"), F.lit(False)) for n in held}
    typed = typed.withColumns({n: F.when(~nested[n], F.try_variant_get(f"_{n}", "$", "string")) for n in held})
    keys = F.map_keys(F.try_variant_get("e", "$", "map<string, variant>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, TICKET_FIELDS))))
    misfits = F.array_compact(F.array(F.when(F.col("broken"), "document"), *[F.when(nested[n], n) for n in held]))
    venue = F.coalesce(F.try_element_at(text_map(ADDRESS_VENUES), F.col("address")), F.col("venue"))
    return typed.select("name", venue.alias("venue"), "datetime", F.coalesce(unknown, F.array().cast("array<string>")).alias("unknown"),
                        misfits.alias("misfits"))


def link_extract(pages: DataFrame, pattern: str = MEASURES_LINK, column: str = "html") -> DataFrame:
    """Adds the first link that fits, the number of links and whether there is one."""
    return pages.withColumns({
        "first_link": first_link(F.col(column), pattern),
        "n_links": link_count(F.col(column), pattern).cast("bigint"),
    }).withColumn("has_link", flag(F.col("n_links") > 0))
