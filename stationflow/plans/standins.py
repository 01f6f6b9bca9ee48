"""Transit tables derived from the generic test tables.

The test tables hold no trips, weather or venue events. Each function below reads one
of them as the raw source an operator expects. Every source gets all rows of its table;
remainders of ids only choose labels or plant faults (missing values, odd spellings). The
two sides of a trip pair share the rows between them by event type.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.config import PUBLISHED_KEYS, STATIONS, ForecastConfig
from stationflow.functions import clock
from stationflow.functions.geo import VENUES
from stationflow.functions.text import MONTHS
from stationflow.operators import calendar, events, features, flows, indicators, weather
from stationflow.operators.serving import config_document
from stationflow.operators.shared import text_array
from stationflow.session import materialise

IN_TYPES = ("view", "click")
OUT_TYPES = ("signup", "purchase", "error")
MEASURE_NAMES = {f"Measure{i}": f"measure_{i}" for i in range(5)}
AHEAD = 7  # days by which forecasts and planned events lie after the events they are made of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    return F.element_at(text_array(values), (index + 1).cast("int"))


def station_of(user: Column) -> Column:
    return pick(STATIONS, F.pmod(user, F.lit(3)))


def venue_of(user: Column) -> Column:
    return pick(list(VENUES), F.pmod(user, F.lit(15)))


def _mod(column: str, n: int) -> Column:
    return F.pmod(F.col(column), F.lit(n))


def cents(value: str = "value") -> Column:
    return F.round(F.col(value) * 100).cast("bigint")


# --- trips -----------------------------------------------------------------------------

def raw_trips(ev: DataFrame, side: str, whole: bool = False) -> DataFrame:
    """Trip rows of one side in the layout of the raw files; all rows with ``whole``."""
    names = flows.RAW_ORIGIN if side == "in" else flows.RAW_DESTINATION
    to_raw = {v: k for k, v in names.items()}
    hour = F.expr("lpad(hour(ts), 2, '0')")
    if not whole:
        ev = ev.where(F.col("event_type").isin(*(IN_TYPES if side == "in" else OUT_TYPES)))
    return ev.select(
        F.to_date("ts").cast("string").alias(to_raw["date"]),
        F.concat(hour, F.lit(":00 - "), hour, F.lit(":59")).alias(to_raw["hour_band"]),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias(to_raw["stop_code"]),
        station_of(F.col("user_id")).alias(to_raw["station"]),
        cents().alias(to_raw["trips"]),
    )


def hourly(ev: DataFrame) -> DataFrame:
    return flows.hourly_flows(
        flows.normalise_trips(raw_trips(ev, "in"), "in"),
        flows.normalise_trips(raw_trips(ev, "out"), "out"))


def flow_rows(ev: DataFrame) -> DataFrame:
    return calendar.calendar_features(hourly(ev), STATIONS)


# --- weather ---------------------------------------------------------------------------

def raw_observations(ev: DataFrame) -> DataFrame:
    readings = {
        "DD": "event_id % 360", "FH": "user_id % 50", "FF": "event_id % 120", "FX": "event_id % 200",
        "T": "round(value * 10)", "T10N": "IF(event_id % 5 <> 0, round(value * 10) - 5, NULL)",
        "TD": "round(value * 10) - 30", "SQ": "event_id % 11", "Q": "event_id % 300", "DR": "event_id % 10",
        "RH": "event_id % 40", "P": "10000 + event_id % 300", "VV": "event_id % 80", "N": "event_id % 9",
        "U": "50 + event_id % 50", "WW": "event_id % 100", "IX": "event_id % 7", "M": "event_id % 2",
        "R": "event_id % 3", "S": "user_id % 2", "O": "user_id % 3", "Y": "(event_id + user_id) % 2",
    }
    return ev.selectExpr(
        "concat(to_date(ts), 'T00:00:00.000Z') AS date", "hour(ts) + 1 AS hour",
        "IF(user_id % 2 = 0, '240', '260') AS station_code", "event_id AS revision",
        *[f"CAST({text} AS double) AS {code}" for code, text in readings.items()])


def last_day(ev: DataFrame) -> Column:
    """Date of the newest row, as a scalar subquery."""
    return ev.agg(F.to_date(F.max("ts")).alias("d")).scalar()


def raw_predictions(ev: DataFrame, one_place: bool = False, ahead: int = 0) -> DataFrame:
    """Forecast records; places are users, or all rows belong to one place."""
    values = {
        "windr": "event_id % 360", "rv": "event_id % 100", "luchtd": "1000 + event_id % 30", "temp": "value",
        "windb": "event_id % 12", "winds": "event_id % 25", "gust": "event_id % 40", "vis": "event_id % 9000",
        "neersl": "IF(event_id % 50 = 0, '-', CAST(event_id % 7 AS string))", "gr": "event_id % 800",
        "tw": "event_id % 101",
    }
    return ev.selectExpr(
        "'city' AS loc" if one_place else "concat('L', user_id) AS loc",
        f"(unix_date(to_date(ts)) + {ahead}) * 86400L + hour(ts) * 3600 + IF(event_id % 2 = 0, 0, 1800) AS tijd",
        "CAST(event_id % 5 AS string) AS offset",
        *[f"CAST({text} AS string) AS {code}" for code, text in values.items()])


# --- date-keyed sources ----------------------------------------------------------------

def raw_measures(ev: DataFrame) -> DataFrame:
    """Weekly measures: measure k runs from weekday k for k % 3 more days, open in the last weeks."""
    k = _mod("user_id", 5).cast("int")
    monday = F.date_sub(F.to_date("ts"), F.weekday("ts"))
    start = F.date_add(monday, k)
    return ev.select(
        F.when(_mod("event_id", 4) == 0, "Belgium").otherwise("Netherlands").alias("Country"),
        F.concat(F.lit("Measure"), k.cast("string")).alias("Response_measure"),
        start.alias("date_start"),
        F.when(F.date_diff(last_day(ev), monday) > 7, F.date_add(start, k % 3)).alias("date_end"))


def raw_cases(ev: DataFrame) -> DataFrame:
    geo = F.when(_mod("user_id", 2) == 0, "NL").otherwise("BE")
    return ev.groupBy(F.to_date("ts").alias("d"), geo.alias("geoId")).agg(
        F.count("*").cast("double").alias("cases"),
        F.count_if(F.col("value") > 100).cast("double").alias("deaths"),
    ).select(F.date_format("d", "dd/MM/yyyy").alias("dateRep"), "geoId", "cases", "deaths")


def stringency_documents(ev: DataFrame) -> DataFrame:
    """One JSON document per date, keyed date -> country -> record."""
    country = F.when(_mod("user_id", 2) == 0, "NLD").otherwise("BEL")
    daily = ev.groupBy(F.to_date("ts").alias("d"), country.alias("country")).agg(
        F.pmod(F.sum(cents()), F.lit(100)).cast("double").alias("stringency"))
    record = F.struct(F.col("d").cast("string").alias("date_value"), "stringency")
    # On the 13th the country has no record.
    record = F.when(F.dayofmonth("d") != 13, record)
    # Two countries at most meet in a date.
    per_date = daily.groupBy("d").agg(F.map_from_entries(
        F.collect_list(F.struct("country", record.alias("record")))).alias("m"))
    return per_date.select(F.to_json(F.create_map(F.col("d").cast("string"), F.col("m"))).alias("document"))


def school_years(ev: DataFrame) -> DataFrame:
    """Nested vacation documents, one per ISO week."""
    monday = F.date_sub(F.to_date("ts"), F.weekday("ts"))
    region = pick(["noord", "midden", "zuid", "heel Nederland"], _mod("user_id", 4))
    spans = ev.groupBy(monday.alias("w"), region.alias("region")).agg(
        F.min(F.to_date("ts")).alias("a"), F.count("*").alias("n"))

    def moment(day: Column) -> Column:
        return F.concat(day.cast("string"), F.lit("T23:00:00.000Z"))

    entry = F.struct(
        "region", moment(F.col("a")).alias("startdate"),
        moment(F.date_add("a", F.pmod("n", F.lit(3)).cast("int"))).alias("enddate"))
    # Four regions at most meet in a week.
    return spans.groupBy("w").agg(F.collect_list(entry).alias("regions")).select(F.array(F.struct(
        F.lit(" 2023-2024 ").alias("schoolyear"),
        F.array(F.struct(F.lit("Week ").alias("type"), "regions")).alias("vacations"))).alias("content"))


def as_of(ev: DataFrame) -> Column:
    """Where open measures end."""
    return F.date_add(last_day(ev), 15)


def years_of(df: DataFrame, column: str, ahead: int = 0) -> DataFrame:
    """Years of the dates, and of the dates so many days later."""
    days = F.explode(F.array(F.to_date(column), F.date_add(F.to_date(column), ahead)))
    return df.select(days.alias("d")).select(F.year("d").alias("year")).distinct()


# --- venue events ----------------------------------------------------------------------

def venue_events(ev: DataFrame, ahead: int = 0) -> DataFrame:
    """Scored events, some without end or attendance."""
    later = ev.withColumn("ts", F.expr(f"ts + {clock.span(24 * ahead)}")) if ahead else ev
    started = later.withColumn("_hour", clock.hour_floor("ts")).withColumn(
        "start_ts", F.expr("IF(user_id % 2 = 0, _hour, _hour + make_dt_interval(0, 0, minute(ts)))"))
    return started.select(
        F.expr("event_id AS ord"), venue_of(F.col("user_id")).alias("venue"), F.expr("to_date(ts) AS date"),
        "start_ts", F.expr(f"IF(user_id % 5 <> 0, start_ts + {clock.span(2)}, NULL) AS end_ts"),
        F.expr("IF(user_id % 4 <> 0, value, NULL) AS visitors"))


def rounded_distances(spark: SparkSession) -> DataFrame:
    return events.venue_distances(spark).withColumn("distance_km", F.round("distance_km", 4))


def raw_sheet(ev: DataFrame) -> DataFrame:
    """The event sheet with its usual faults."""
    gone = _mod("event_id", 31) == 0
    day = F.when(_mod("event_id", 37) == 0, F.date_sub(F.to_date("ts"), 2200)).otherwise(F.to_date("ts"))
    datum = F.when(_mod("event_id", 23) == 0, events.SHEET_FOOTER).otherwise(
        F.concat(day.cast("string"), F.lit(" 00:00:00")))
    venue = venue_of(F.col("user_id"))
    venue = F.when((venue == "Ziggo Dome") & (_mod("event_id", 2) == 0), "Ziggo dome").when(
        venue == "Ziggo Dome", "Ziggo Dome (2x)").otherwise(venue)
    venue = F.when(_mod("event_id", 4) == 0, F.concat(F.lit(" "), venue, F.lit("  "))).otherwise(venue)
    venue = F.when(_mod("event_id", 17) == 0, F.lit(None)).when(
        _mod("event_id", 19) == 0, events.PLACE_OTHER).otherwise(venue)
    prefix = F.when(_mod("event_id", 2) == 0, events.EPOCH_PREFIX).otherwise("")
    start = F.when(_mod("event_id", 29) != 0,
                   F.concat(prefix, F.expr("lpad(hour(ts), 2, '0')"), F.lit(":00:00")))
    end = F.when(_mod("event_id", 5) == 0, "onbekend").otherwise(
        F.concat(prefix, F.expr("lpad((hour(ts) + 2) % 24, 2, '0')"), F.lit(":00:00")))
    name = F.concat(F.lit("Event "), F.col("event_id").cast("string"))

    def unless_gone(c: Column) -> Column:
        return F.when(~gone, c)

    return ev.select(
        F.col("event_id").alias("ord"), unless_gone(datum).alias("Datum"),
        unless_gone(venue).alias("Locatie"), unless_gone(name).alias("Naam evenement"),
        unless_gone(start).alias("Start show"), unless_gone(end).alias("Einde show"),
        unless_gone(F.when(_mod("user_id", 4) != 0, F.col("value"))).alias("Aantal bezoekers"))


def raw_social(ev: DataFrame) -> DataFrame:
    """Collected posts; some are copies of sheet events."""
    accounts = [*events.ACCOUNT_VENUES, "newaccount"]
    return ev.select(
        F.col("event_id").alias("ord"), pick(accounts, _mod("user_id", 10)).alias("venue"),
        F.concat(F.to_date("ts").cast("string"), F.lit(" "), F.expr("lpad(hour(ts), 2, '0')"), F.lit(":00:00"))
        .alias("event_date"))


def raw_tickets(ev: DataFrame) -> DataFrame:
    """Ticketed events with UTC times."""
    venue = venue_of(F.col("user_id"))
    venue = F.when(venue == "Royal Theater Carré", "Koninklijk Theater Carre").otherwise(venue)
    return ev.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("Show "), F.col("event_id").cast("string")).alias("name"),
        venue.alias("venue"),
        F.concat(F.to_date("ts").cast("string"), F.lit("T"), F.expr("lpad(hour(ts), 2, '0')"), F.lit(":00:00Z"))
        .alias("datetime"))


def unified(ev: DataFrame, cfg: ForecastConfig) -> DataFrame:
    return events.events_unified(raw_sheet(ev), raw_social(ev), raw_tickets(ev), cfg)


# --- collected documents ---------------------------------------------------------------

def caption(ev_id: str = "event_id") -> Column:
    """Captions: long and short month names, no date, impossible dates."""
    long_names = [m for m in MONTHS if len(m) > 3 or m == "mei"]
    month = pick(long_names, _mod(ev_id, 12))
    short = F.substring(F.when(month == "maart", "mrt").otherwise(month), 1, 3)
    short = F.when(short.isin("jun", "jul"), month).otherwise(F.upper(short))
    day = F.lpad((1 + _mod(ev_id, 28)).cast("string"), 2, "0")
    hour, minute = F.expr("lpad(hour(ts), 2, '0')"), F.expr("lpad(minute(ts), 2, '0')")
    return (F.when(_mod(ev_id, 4) == 0, F.concat(F.lit("Show op "), day, F.lit(" "), month, F.lit(" om "),
                                                 hour, F.lit(":"), minute, F.lit(" uur, of 31 dec 23:59")))
            .when(_mod(ev_id, 4) == 1, F.concat(day, F.lit("\n"), short, F.lit(". Deuren "), hour, F.lit("."), minute))
            .when(_mod(ev_id, 4) == 2, F.concat(F.lit("Vanaf "), hour, F.lit(":"), minute, F.lit(" open")))
            .otherwise(F.concat(F.lit("31 feb om "), hour, F.lit(":"), minute)))


def post_documents(ev: DataFrame, per_account: bool = False) -> DataFrame:
    """JSON documents of at most 100 posts of a user each, or of 1,000 events of an account."""
    accounts = [*events.ACCOUNT_VENUES, "newaccount"]
    epoch = (F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600
             + F.minute("ts") * 60 + F.second("ts"))
    edge = F.struct(F.struct(caption().alias("text")).alias("node"))
    none = F.array().cast("array<struct<node: struct<text: string>>>")
    post = F.struct(
        F.struct(_mod("event_id", 1000).alias("count")).alias("edge_media_preview_like"),
        F.struct(_mod("event_id", 50).alias("count")).alias("edge_media_to_comment"),
        epoch.alias("taken_at_timestamp"),
        F.struct(F.when(_mod("event_id", 11) == 0, none).otherwise(F.array(edge)).alias("edges"))
        .alias("edge_media_to_caption"))
    chunk = F.floor(F.col("event_id") / (1000 if per_account else 100))
    user = _mod("user_id", 10) if per_account else F.col("user_id")
    docs = ev.groupBy(user.alias("user_id"), chunk.alias("chunk")).agg(F.collect_list(post).alias("GraphImages"))
    return docs.select(pick(accounts, _mod("user_id", 10)).alias("venue"),
                       F.to_json(F.struct("GraphImages")).alias("document"))


def ticket_documents(ev: DataFrame) -> DataFrame:
    """JSON pages of at most 200 events, every page collected three times."""
    line1 = F.when(_mod("event_id", 7) == 0, "Lijnbaansgracht 238").when(
        _mod("event_id", 7) == 1, "Lijnbaansgracht 234 A").otherwise("Street 1")
    venue = F.struct(venue_of(F.col("user_id")).alias("name"), F.struct(line1.alias("line1")).alias("address"))
    none = F.array().cast("array<struct<name: string, address: struct<line1: string>>>")
    held = F.when(_mod("event_id", 13) == 0, none).otherwise(F.array(venue))
    start = F.concat(F.to_date("ts").cast("string"), F.lit("T"), F.expr("lpad(hour(ts), 2, '0')"), F.lit(":00:00Z"))
    entry = F.struct(
        F.concat(F.lit("Show "), _mod("event_id", 50).cast("string")).alias("name"),
        F.struct(F.struct(start.alias("dateTime")).alias("start")).alias("dates"),
        F.struct(held.alias("venues")).alias("_embedded"))
    pages = ev.groupBy(F.floor(F.col("event_id") / 200).alias("p")).agg(F.collect_list(entry).alias("events"))
    document = F.to_json(F.struct(
        F.struct(F.lit(3).cast("bigint").alias("totalPages")).alias("page"),
        F.struct("events").alias("_embedded")))
    return pages.select(document.alias("document"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("col")


def drifting_documents(ev: DataFrame) -> DataFrame:
    """JSON pages of at most 200 events in six shapes; every ninth page is cut short."""
    shape = _mod("event_id", 6)
    start = F.concat(F.to_date("ts").cast("string"), F.lit("T"), F.expr("lpad(hour(ts), 2, '0')"), F.lit(":00:00Z"))
    name, venue = F.concat(F.lit("Show "), _mod("event_id", 50).cast("string")), F.struct(venue_of(F.col("user_id")).alias("name"))
    usual = {"name": name, "dates": F.struct(F.struct(start.alias("dateTime")).alias("start")),
             "_embedded": F.struct(F.array(venue).alias("venues"))}
    shapes = [
        usual, {"price": F.col("value"), **usual, "currency": F.lit("EUR")}, {**usual, "name": F.col("event_id")},
        {**usual, "dates": F.struct(F.struct(F.struct(start.alias("utc")).alias("dateTime")).alias("start"))},
        {**usual, "_embedded": F.struct(venue.alias("venues"))}, {**usual, "_embedded": F.struct(F.lit("none").alias("note"))}]
    texts = [F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])) for fields in shapes]
    entry = F.coalesce(*[F.when(shape == i, t) for i, t in enumerate(texts)])
    pages = ev.groupBy(F.floor(F.col("event_id") / 200).alias("p")).agg(F.array_join(F.collect_list(entry), ",").alias("events"))
    end = F.when(_mod("p", 9) == 0, "").otherwise("]}}")
    return pages.select(F.concat(F.lit('{"_embedded":{"events":['), "events", end).alias("document"))


def config_documents(ev: DataFrame) -> DataFrame:
    """One settings document per user, switches taken from the user's activity."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = ev.groupBy("user_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    settings, switches = [], iter([*kinds, "n", *kinds[:3]])
    for _, kind in PUBLISHED_KEYS.values():
        if kind is bool:
            settings.append(F.pmod(F.col(next(switches)), F.lit(2)) == 1)
        else:
            settings.append(F.pmod("n", F.lit(7)).cast("int"))
    return counts.select("user_id", config_document(*settings).alias("document"))


# --- compositions ----------------------------------------------------------------------

def dimensions(ev: DataFrame, cfg: ForecastConfig, future: bool = False) -> features.Dimensions:
    """All side tables of the enrichment; with ``future`` the weather is the forecast."""
    spark = ev.sparkSession
    if future:
        predicted = weather.weather_forecast(raw_predictions(ev, True, AHEAD), cfg.zone,
                                             cfg.forecast_shift_hours, cfg.forecast_fill_hours)
        observed = predicted.drop("loc")
    else:
        observed = weather.weather_history(raw_observations(ev), cfg.weather_station, cfg.zone)
    records = indicators.stringency_records(stringency_documents(ev), cfg.country_code)
    return features.Dimensions(
        weather=observed,
        stringency=indicators.stringency_series(records, cfg.stringency_horizon_days),
        measures=indicators.measures_daily(raw_measures(ev), cfg.country, MEASURE_NAMES, as_of(ev)),
        cases=indicators.cases_deaths(raw_cases(ev), cfg.geo_id, cfg.case_date_format),
        holidays=indicators.holiday_calendar(years_of(ev, "ts", AHEAD if future else 0)),
        vacations=indicators.vacation_calendar(school_years(ev), cfg.vacation_shift_days),
        events=events.events_normalized(venue_events(ev, AHEAD if future else 0)).withColumn("visitors", F.col("visitors_normalized")),
        distances=rounded_distances(spark),
    )


def written(dims: features.Dimensions) -> features.Dimensions:
    """The side tables that several parts of a plan read, written once."""
    names = ("weather", "stringency", "measures", "cases", "vacations", "holidays")
    return replace(dims, **{n: materialise(getattr(dims, n), n) for n in names})


def enriched(ev: DataFrame, cfg: ForecastConfig) -> DataFrame:
    return features.enrich(flow_rows(ev), dimensions(ev, cfg), cfg)


