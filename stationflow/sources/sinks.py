"""Sinks: forecasts, model log, configuration and collected events."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stationflow.config import ForecastConfig
from stationflow.operators.serving import config_rows, model_log, model_log_rows
from stationflow.sources.versions import Folder, current_version, read_table, replace_table

# Published names of forecast columns.
PUBLISHED_NAMES = {
    "check_ins_week_ago": "check-ins_week_ago",
    "check_outs_week_ago": "check-outs_week_ago",
    "check_ins_predicted": "check-ins_predicted",
    "check_outs_predicted": "check-outs_predicted",
    "date": "datetime",
}


def save_forecasts(forecasts: DataFrame, path: str, run_ts: datetime) -> None:
    """Saves a run, laid out by station and run date; a run of the same date is replaced."""
    stamped = forecasts.withColumn("run_ts", F.lit(run_ts).cast("timestamp_ntz"))
    stamped.withColumn("run_date", F.to_date("run_ts")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("station", "run_date").parquet(path)


def read_forecasts(spark: SparkSession, path: str, newest: bool = True) -> DataFrame:
    """Saved forecasts; with ``newest`` only each station's last run.

    The last run is found from the folder names; other runs' files are not read.
    """
    saved = spark.read.parquet(path)
    if newest:
        last = saved.select("station", "run_date").groupBy("station").agg(F.max("run_date").alias("run_date"))
        saved = saved.join(last, ["station", "run_date"])
    return saved.withColumn("run_date", F.col("run_date").cast("date"))


def publish_forecasts(forecasts: DataFrame, path: str, run_date: date) -> None:
    """The forecast under its published column names: one CSV file a station and date, in hours' order.

    Rows are dealt out by ranges of stations and written sorted to a folder aside; each station's
    file then takes its place under ``path``, so a rerun of the date replaces it.
    """
    spark, aside = forecasts.sparkSession, f".writing-{uuid.uuid4().hex}"
    rows = forecasts.repartitionByRange("station").sortWithinPartitions("station", "date", "hour")
    folder = Folder(spark, path)
    rows.withColumnsRenamed(PUBLISHED_NAMES).write.option("maxRecordsPerFile", 0).partitionBy("station").csv(
        f"{folder.path}/{aside}", header=True)
    for station in Folder(spark, f"{folder.path}/{aside}").names():  # at most one a station of the configuration
        if station.startswith("station="):
            # The name may hold escaped signs; it stays as Spark wrote it.
            file, = [n for n in Folder(spark, f"{folder.path}/{aside}/{station}").names() if n.startswith("part-")]
            folder.system.mkdirs(folder.at(station))
            folder.move(f"{aside}/{station}/{file}", f"{station}/{_published_name(run_date)}")
    folder.remove(aside)


def _published_name(run_date: date) -> str:
    return f"prediction_next_week_{run_date:%b-%d-%Y}.csv"


def read_published(spark: SparkSession, path: str, run_date: date) -> DataFrame:
    """All stations' published files of a date."""
    return spark.read.options(header=True, inferSchema=False, basePath=path).csv(
        f"{path.rstrip('/')}/station=*/{_published_name(run_date)}")


def _log_schema(spark: SparkSession) -> StructType:
    metrics = spark.createDataFrame([], "station string, n bigint, r2 double, mae double, rmse double")
    return model_log_rows(metrics, ForecastConfig(), []).withColumn("logged_at", F.lit(None).cast("timestamp_ntz")).schema


def save_model_log(rows: DataFrame, path: str, run_ts: datetime, keep: str = "first") -> None:
    """Unites the log with new rows and replaces it as a whole.

    Of equal keys the old row stays; ``keep="latest"`` lets the new one replace it. The first run
    starts the log.
    """
    spark = rows.sparkSession
    version = current_version(spark, path)
    old = read_model_log(spark, path)
    stamped = rows.withColumn("logged_at", F.lit(run_ts).cast("timestamp_ntz"))
    replace_table(model_log(old, stamped.to(old.schema), keep), path, version)


def read_model_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, one row a key; a log that nobody has written yet is empty."""
    return read_table(spark, path, _log_schema(spark))


def save_config(spark: SparkSession, cfg: ForecastConfig, path: str) -> None:
    config_rows(spark, cfg).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "document")


def append_events(events: DataFrame, path: str, collected_at: datetime, source: str = "source") -> None:
    """Adds collected events to what earlier runs collected, each source file once.

    The ledger lists the files that are in. Events of other files are written as a batch and become
    visible when the ledger names their files with that batch, so neither a page that is
    collected again nor a run that ended halfway leaves a copy.
    """
    spark, batch = events.sparkSession, f"{collected_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    new = events.join(_ledger(spark, path).select(F.col("source").alias(source)), source, "left_anti")
    new.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/events")
    if f"batch={batch}" in Folder(spark, f"{path}/events").names():
        written = spark.read.schema(events.schema).parquet(f"{path}/events/batch={batch}")
        entries = written.select(F.col(source).alias("source")).distinct().withColumn("batch", F.lit(batch))
        entries.write.mode("append").parquet(f"{path}/ledger")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """source, batch: of batches that brought the same file at the same time the first counts."""
    if "ledger" not in Folder(spark, path).names():
        return spark.createDataFrame([], "source string, batch string")
    entries = spark.read.schema("source string, batch string").parquet(f"{path}/ledger")
    return entries.groupBy("source").agg(F.min("batch").alias("batch"))


def read_events(spark: SparkSession, path: str, schema: StructType, source: str = "source") -> DataFrame:
    """All collected events; none before the first collection."""
    if "events" not in Folder(spark, path).names():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema, StructField("batch", StringType())])).parquet(f"{path}/events")
    return rows.join(_ledger(spark, path).withColumnRenamed("source", source), [source, "batch"], "left_semi").select(*schema.names)
