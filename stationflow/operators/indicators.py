"""Date-keyed side tables: measures, stringency, cases, vacations and holidays."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.functions import clock
from stationflow.operators.shared import fixed_table, unique

STRINGENCY_DOCUMENT = "map<string,map<string,struct<date_value:string,stringency:double>>>"

# Vacation ranges before the first school year that is published
# (first day, number of days).
EARLY_VACATIONS = (
    (date(2019, 1, 1), 6),
    (date(2019, 2, 16), 9),
    (date(2019, 4, 27), 9),
    (date(2019, 7, 13), 44),
)
# Regions whose school vacations apply.
VACATION_REGIONS = ("noord", "heel Nederland")


def measure_names(raw: DataFrame, country: str) -> list[str]:
    """Names of the country's measures: a published list of kinds, a few dozen."""
    rows = raw.where((F.col("Country") == country) & F.col("Response_measure").isNotNull())
    return sorted(r[0] for r in rows.select("Response_measure").distinct().collect())


def measure_columns(raw: DataFrame, country: str) -> dict[str, str]:
    """Every measure of the country as a column of its own name."""
    return {name: name for name in measure_names(raw, country)}


def unlisted(country: str, measures: dict[str, str]) -> Column:
    """Aggregate: the country's measures that have no column, of a published list of kinds."""
    known = F.col("Response_measure").isin(*measures) if measures else F.lit(False)
    return F.sort_array(F.collect_set(F.when((F.col("Country") == country) & ~known, F.col("Response_measure"))))


def measures_daily(raw: DataFrame, country: str, measures: dict[str, str], as_of: Column | date) -> DataFrame:
    """One row per date with any active measure, one 0/1 column per measure.

    ``measures`` maps measure names to column names, so the schema is known beforehand;
    :func:`measure_columns` makes it from the data, :func:`unlisted` finds what it lacks.
    Intervals are not expanded: starts count +1 and ends -1 per (measure, date), the
    running sum over dates tells where a measure is on, and only those stretches are
    laid out in days. The shuffle carries at most two rows per measure and date.
    """
    if not measures:
        return raw.select(F.col("date_start").alias("date")).where(F.lit(False))
    end = F.coalesce("date_end", as_of if isinstance(as_of, Column) else F.lit(as_of))
    spans = raw.where(
        (F.col("Country") == country) & F.col("date_start").isNotNull()
        & F.col("Response_measure").isin(*measures) & (F.col("date_start") <= end))
    steps = spans.select(
        F.col("Response_measure").alias("measure"),
        F.explode(F.array(
            F.struct(F.col("date_start").alias("date"), F.lit(1).alias("step")),
            F.struct(F.date_add(end, 1).alias("date"), F.lit(-1).alias("step")),
        )).alias("s"),
    ).select("measure", "s.date", "s.step")
    # A measure holds at most one row per calendar date here.
    daily = steps.groupBy("measure", "date").agg(F.sum("step").alias("step"))
    window = Window.partitionBy("measure").orderBy("date")
    stretches = daily.select(
        "measure", "date",
        F.sum("step").over(window).alias("open"),
        F.lead("date").over(window).alias("until"),
    ).where("open > 0")
    days = stretches.select(
        "measure", F.explode(F.sequence("date", F.date_sub("until", 1))).alias("date"))
    return days.groupBy("date").agg(*[
        F.max(F.when(F.col("measure") == name, 1).otherwise(0)).alias(column)
        for name, column in measures.items()])


def cases_deaths(raw: DataFrame, geo_id: str, date_format: str) -> DataFrame:
    """Reported cases and deaths of one area, one row per date.

    A date that was reported twice keeps its larger figures, so joins never fan out.
    """
    typed = raw.where(F.col("geoId") == geo_id).select(
        F.to_date("dateRep", date_format).alias("date"),
        F.col("cases").cast("double").alias("cases"),
        F.col("deaths").cast("double").alias("deaths"),
    )
    return typed.groupBy("date").agg(F.max("cases").alias("cases"), F.max("deaths").alias("deaths"))


def stringency_records(documents: DataFrame, country_code: str) -> DataFrame:
    """(date, stringency) of one country from JSON text keyed date -> country -> record.

    Documents may overlap; a date comes out once, with its larger value.
    """
    parsed = documents.select(F.explode(F.from_json("document", STRINGENCY_DOCUMENT)))
    record = parsed.select(F.try_element_at("value", F.lit(country_code)).alias("r"))
    return record.where("r IS NOT NULL").groupBy(
        clock.parse_date_text("r.date_value").alias("date")).agg(
        F.max("r.stringency").alias("stringency"))


def stringency_series(records: DataFrame, horizon_days: int = 13) -> DataFrame:
    """The daily series, its last value carried ``horizon_days`` days on."""
    latest = records.agg(F.max_by(F.struct("date", "stringency"), "date").alias("l"))
    ahead = latest.where("l IS NOT NULL").select(
        F.explode(F.sequence(F.date_add("l.date", 1), F.date_add("l.date", horizon_days))).alias("date"),
        F.col("l.stringency").alias("stringency"))
    return records.select("date", "stringency").unionByName(ahead)


def vacation_ranges(school_years: DataFrame) -> DataFrame:
    """(school_year, vacation, region, startdate, enddate) from the nested documents."""
    content = school_years.select(F.col("content")[0].alias("c"))
    named = content.select(
        F.trim("c.schoolyear").alias("school_year"), F.explode_outer("c.vacations").alias("v"))
    return named.select(
        "school_year", F.trim("v.type").alias("vacation"), F.explode_outer("v.regions").alias("r"),
    ).select(
        "school_year", "vacation", F.col("r.region").alias("region"),
        clock.parse_date_text("r.startdate").alias("startdate"),
        clock.parse_date_text("r.enddate").alias("enddate"))


def vacation_calendar(school_years: DataFrame, shift_days: int = 1,
                      regions: Sequence[str] = VACATION_REGIONS) -> DataFrame:
    """Distinct vacation dates, the early ranges included."""
    ranges = vacation_ranges(school_years).where(
        F.col("region").isin(*regions) & (F.col("startdate") <= F.col("enddate")))
    # Ranges repeat per document and overlap: make them distinct before laying out days.
    published = ranges.select(
        F.date_add("startdate", shift_days).alias("a"), F.date_add("enddate", shift_days).alias("b"))
    spark = school_years.sparkSession
    early = fixed_table(spark, EARLY_VACATIONS, ["a", "n"]).select(
        "a", F.date_add("a", F.col("n").cast("int") - 1).alias("b"))
    spans = published.unionByName(early).distinct()
    return spans.select(F.explode(F.sequence("a", "b")).alias("date")).distinct()


def easter_sunday(years: DataFrame) -> DataFrame:
    """Adds Gregorian Easter by the anonymous computus (Meeus/Jones/Butcher)."""
    steps = (
        {"_golden": "year % 19", "_century": "year div 100", "_rest": "year % 100"},
        {"_shift": "(_century + 8) div 25"},
        {"_epact": "(19 * _golden + _century - _century div 4 - (_century - _shift + 1) div 3 + 15) % 30"},
        {"_sunday": "(32 + 2 * (_century % 4) + 2 * (_rest div 4) - _epact - _rest % 4) % 7"},
        {"_late": "(_golden + 11 * _epact + 22 * _sunday) div 451"},
        {"_code": "CAST(_epact + _sunday - 7 * _late + 114 AS int)"},
        {"easter": "make_date(year, CAST(_code div 31 AS int), _code % 31 + 1)"},
    )
    for step in steps:
        years = years.withColumns({name: F.expr(text) for name, text in step.items()})
    return years.drop(*[name for step in steps[:-1] for name in step])


def holiday_calendar(years: DataFrame) -> DataFrame:
    """(date, holiday) of the Dutch public holidays in each ``year``."""
    based = years.selectExpr("CAST(year AS int) AS year").where("year IS NOT NULL").distinct()
    # The monarch's day moved from 30 to 27 April in 2014 and gives way to a Sunday.
    based = easter_sunday(based).withColumn("_royal", F.expr("make_date(year, 4, IF(year >= 2014, 27, 30))"))
    days = {
        "New year": "make_date(year, 1, 1)",
        "Good Friday": "date_sub(easter, 2)",
        "Easter Sunday": "easter",
        "Easter Monday": "date_add(easter, 1)",
        "King\\'s day": "IF(weekday(_royal) = 6, date_sub(_royal, 1), _royal)",
        "Liberation Day": "make_date(year, 5, 5)",
        "Ascension Thursday": "date_add(easter, 39)",
        "Whit Sunday": "date_add(easter, 49)",
        "Whit Monday": "date_add(easter, 50)",
        "Christmas Day": "make_date(year, 12, 25)",
        "Boxing Day": "make_date(year, 12, 26)",
    }
    listed = ", ".join(f"struct({day} AS date, '{name}' AS holiday)" for name, day in days.items())
    return based.select(F.expr(f"inline(array({listed}))"))


def latest_values(df: DataFrame, columns: Sequence[str], order: str = "date") -> Column:
    """Struct of ``columns`` in the latest row, as a scalar subquery."""
    return df.agg(F.max_by(F.struct(*columns), order)).scalar()


def fill_from_latest(df: DataFrame, source: DataFrame, columns: Sequence[str], key: str = "date") -> DataFrame:
    """Left join of ``source``, one row per date, on ``key``; gaps take the latest row's values."""
    latest = latest_values(source, columns, key)
    joined = df.join(unique(source.select(key, *columns), key), key, "left")
    return joined.withColumns({c: F.coalesce(c, latest.getField(c)) for c in columns})


