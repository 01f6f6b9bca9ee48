"""Scans of landed files. Every reader takes a folder or glob and a fixed schema."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stationflow.operators.extract import POSTS_SCHEMA, TICKETS_SCHEMA
from stationflow.sources import schemas
from stationflow.sources.lines import files_below, scan_gzip_lines


def _named(rows: DataFrame, schema: str, *more: Column) -> DataFrame:
    """The schema's columns by name, cast to its types; what does not fit becomes null. And more columns."""
    fields = StructType.fromDDL(schema).fields
    lost = [f.name for f in fields if f.name.lower() not in {c.lower() for c in rows.columns}]
    if lost:
        raise ValueError(f"columns {lost} are not in the header {rows.columns}")
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields], *more)


def _csv(spark: SparkSession, path, schema: str, **options) -> DataFrame:
    """Columns by header name, whatever their order and whatever else the files hold.

    The files of one path share a header; one with another header fails the read instead
    of swapping values.
    """
    return _named(spark.read.options(header=True, enforceSchema=False, **options).csv(path), schema)


def _lower(cells: str) -> Column:
    return F.transform(cells, lambda c: F.coalesce(F.lower(c), F.lit("")))


def _indexed_csv(spark: SparkSession, path: str, schema: str, most_columns: int = 64, **options) -> DataFrame:
    """Like ``_csv`` for files that each have a header of their own, all in one scan.

    A file's header is the row that holds all names of the schema; it says for this file where
    each column lies. A file without one fails the read. The row index is named ``ord``, or
    unnamed and leading. It starts anew in each file, so ``ord`` counts files (by path) first.
    Columns beyond ``most_columns`` are not seen.
    """
    fields = StructType.fromDDL(schema).fields
    names = [f.name for f in fields if f.name != "ord"]
    cells = [f"c{i}" for i in range(most_columns)]
    read = spark.read.options(header=False, **options).schema(", ".join(f"{c} string" for c in cells)).csv(path)
    rows = read.select(F.array(*cells).alias("cells"), F.col("_metadata.file_path").alias("file"))
    named = F.lit(True)
    for name in names:
        named = named & F.array_contains(_lower("cells"), name.lower())
    heads = rows.where(named).groupBy("file").agg(F.min("cells").alias("head"))
    heads = heads.withColumn("number", F.row_number().over(Window.orderBy("file")) - 1)  # a row a file
    rows = rows.join(heads, "file", "left")
    missing = F.raise_error(F.concat(F.lit(f"no header with {', '.join(names)} in "), "file"))
    rows = rows.withColumn("head", F.coalesce("head", missing.cast("array<string>"))).where("cells <> head")

    def at(name: str) -> Column:
        return F.array_position(_lower("head"), name.lower())

    index = F.get("cells", F.greatest(at("ord"), F.lit(1)).cast("int") - 1).try_cast("bigint")
    values = {n: F.get("cells", at(n).cast("int") - 1) for n in names} | {"ord": F.col("number") * (1 << 32) + index}
    return rows.select(*[values[f.name].try_cast(f.dataType).alias(f.name) for f in fields])


def day_folders(root: str, from_date: date | None = None, to_date: date | None = None) -> list[str]:
    """Globs of the folders ``root/<year>/<month>/<day>``: all, or only those of a span of dates,
    so that other days are not even listed. Whole months and years inside it take one glob."""
    if from_date is None and to_date is None:
        return [f"{root}/*/*/*"]
    if from_date is None or to_date is None:
        raise ValueError("give both ends of the span of dates")
    day, out = from_date, []
    while day <= to_date:
        year_end, month_end = date(day.year, 12, 31), (day.replace(day=28) + timedelta(4)).replace(day=1) - timedelta(1)
        if day == date(day.year, 1, 1) and year_end <= to_date:
            glob, day = f"{day:%Y}/*/*", year_end
        elif day.day == 1 and month_end <= to_date:
            glob, day = f"{day:%Y/%m}/*", month_end
        else:
            glob = f"{day:%Y/%m/%d}"
        out.append(f"{root}/{glob}")
        day += timedelta(1)
    return out


def scan_trips_csv(spark: SparkSession, root: str, prefix: str, side: str,
                   from_date: date | None = None, to_date: date | None = None) -> DataFrame:
    """Semicolon CSVs under ``root/<year>/<month>/<day>/``, chosen by file name prefix.

    With dates given, only the folders of that span are listed and read; each of its days,
    months or years needs a folder.
    """
    schema = schemas.ORIGIN_TRIPS if side == "in" else schemas.DESTINATION_TRIPS
    return _csv(spark, [f"{d}/{prefix}*.csv" for d in day_folders(root, from_date, to_date)], schema, sep=";")


def scan_trips_folders(spark: SparkSession, folders: list[str], prefix: str, side: str) -> DataFrame:
    """The trip CSVs of given folders, with the path of each row's file in ``_file``."""
    schema = schemas.ORIGIN_TRIPS if side == "in" else schemas.DESTINATION_TRIPS
    read = spark.read.options(header=True, enforceSchema=False, sep=";", pathGlobFilter=f"{prefix}*.csv").csv(folders)
    return _named(read, schema, F.col("_metadata.file_path").alias("_file"))


def scan_trips_json(spark: SparkSession, root: str, side: str,
                    from_date: date | None = None, to_date: date | None = None) -> DataFrame:
    """Gzipped JSON lines under ``root/<year>/<month>/<day>/``."""
    schema = schemas.ORIGIN_TRIPS if side == "in" else schemas.DESTINATION_TRIPS
    return spark.read.schema(schema).json([f"{d}/*.json.gz" for d in day_folders(root, from_date, to_date)])


def scan_trips_union(spark: SparkSession, csv_root: str, json_root: str, prefix: str, side: str) -> DataFrame:
    """Both layouts, united by column name."""
    return scan_trips_csv(spark, csv_root, prefix, side).unionByName(
        scan_trips_json(spark, json_root, side), allowMissingColumns=True)


def scan_weather(spark: SparkSession, path: str, schema: str, any_extension: bool = False,
                 with_revision: bool = False) -> DataFrame:
    """Gzipped JSON lines of weather records.

    Spark unzips files named ``*.gz``. With ``any_extension`` gzipped files of other names
    are read too, as streams of any length, one task a file. ``with_revision`` adds the file's
    path as ``revision``: of two readings the later file holds the valid one.
    """
    named = spark.read.schema(schema).options(pathGlobFilter="*.gz", recursiveFileLookup=True).json(path)
    if with_revision:
        named = named.withColumn("revision", F.col("_metadata.file_path"))
    if not any_extension:
        return named
    lines = scan_gzip_lines(spark, files_below(spark, path, without=".gz"))
    parsed = lines.select("path", F.from_json("value", schema).alias("r"))
    path_column = [F.col("path").alias("revision")] if with_revision else []
    return named.unionByName(parsed.select("r.*", *path_column))


def scan_venue_events(spark: SparkSession, path: str) -> DataFrame:
    """The event sheet, landed as CSV with its row number in ``ord``. Blanks stay as they are."""
    return _csv(spark, path, schemas.EVENT_SHEET, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def scan_social_events(spark: SparkSession, path: str) -> DataFrame:
    """Collected posts with their index, account and event date."""
    return _indexed_csv(spark, path, schemas.SOCIAL_EVENTS, multiLine=True, escape='"')


def scan_ticketed_events(spark: SparkSession, path: str) -> DataFrame:
    return _indexed_csv(spark, path, schemas.TICKETED_EVENTS, multiLine=True, escape='"')


def scan_measures(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.MEASURES, nullValue="NA")


def scan_cases(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CASES)


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as text in ``document``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def scan_school_years(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCHOOL_YEARS).json(path, multiLine=True)


def _reader_schema(spark: SparkSession, ddl: str):
    return spark.sql(f"SELECT CAST(NULL AS {ddl.strip()}) AS d").schema["d"].dataType


def scan_posts(spark: SparkSession, path: str) -> DataFrame:
    """Post files, one per account; the file name gives the account."""
    rows = spark.read.schema(_reader_schema(spark, POSTS_SCHEMA)).json(path, multiLine=True)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)
    return rows.select(name.alias("venue"), "GraphImages")


def scan_ticket_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_reader_schema(spark, TICKETS_SCHEMA)).json(path, multiLine=True)


@dataclass(frozen=True)
class Sources:
    """Raw tables of a forecast run."""

    ins: DataFrame
    outs: DataFrame
    weather: DataFrame
    predictions: DataFrame
    sheet: DataFrame
    posts: DataFrame
    tickets: DataFrame
    measures: DataFrame
    cases: DataFrame
    stringency: DataFrame
    school_years: DataFrame


def read_sources(spark: SparkSession, root: str, prefix_in: str = "", prefix_out: str = "") -> Sources:
    """All sources from their folders under ``root``."""
    return Sources(
        ins=scan_trips_union(spark, f"{root}/trips", f"{root}/trips-origin-json", prefix_in, "in"),
        outs=scan_trips_union(spark, f"{root}/trips", f"{root}/trips-destination-json", prefix_out, "out"),
        weather=scan_weather(spark, f"{root}/weather/observations", schemas.OBSERVED_WEATHER, True, True),
        predictions=scan_weather(spark, f"{root}/weather/predictions", schemas.PREDICTED_WEATHER),
        sheet=scan_venue_events(spark, f"{root}/events/sheet"),
        posts=scan_social_events(spark, f"{root}/events/social"),
        tickets=scan_ticketed_events(spark, f"{root}/events/ticketed"),
        measures=scan_measures(spark, f"{root}/measures"),
        cases=scan_cases(spark, f"{root}/cases"),
        stringency=scan_documents(spark, f"{root}/stringency"),
        school_years=scan_school_years(spark, f"{root}/school-years"),
    )
