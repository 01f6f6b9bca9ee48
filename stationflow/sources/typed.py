"""A typed layer of trips, kept by day, so that a run parses only what has changed.

Raw trips lie as text under ``<year>/<month>/<day>``. The layer holds them as typed rows,
partitioned by year, month and day. An update looks at the times of the raw folders' files and
reads the days that are newer than what the layer holds; each of these days is written
over its own partition and no other is touched. Readers bound by dates see only the partitions
inside.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.operators import flows
from stationflow.sources.readers import scan_trips_folders
from stationflow.sources.versions import Folder

DAY_PARTS = ("year", "month", "day")
_DAY = re.compile(r"(?:^|/)(?:[A-Za-z]+=)?(\d{4})/(?:[A-Za-z]+=)?(\d{1,2})/(?:[A-Za-z]+=)?(\d{1,2})$")


def day_times(spark: SparkSession, root: str) -> dict[str, tuple[date, int]]:
    """For each folder of a day its date and the time of its newest file.

    The listing has an entry a day, like the folder index that Spark keeps of a partitioned table.
    """
    folder = Folder(spark, root)
    out = {}
    for path in folder.folders(3):
        if (found := _DAY.search(path)) and (newest := folder.newest(path)) is not None:
            out[path] = date(*map(int, found.groups())), newest
    return out


def changed_days(spark: SparkSession, root: str, layer: str) -> list[str]:
    """Raw folders of days that the layer lacks, or holds from before their newest file."""
    held = dict(day_times(spark, layer).values())
    return sorted(path for path, (day, newest) in day_times(spark, root).items() if held.get(day, -1) <= newest)


def update_trips(spark: SparkSession, root: str, layer: str, prefix: str, side: str) -> list[str]:
    """Brings the layer up to date and says which raw folders were read.

    Rows lie under the date of their raw folder, whatever their own ``date`` says.
    """
    days = changed_days(spark, root, layer)
    if days:
        raw = scan_trips_folders(spark, [f"{root.rstrip('/')}/{d}" for d in days], prefix, side)
        parts = F.split(F.regexp_extract("_file", r"([^/]+/[^/]+/[^/]+)/[^/]+$", 1), "/")
        rows = raw.withColumns({p: F.regexp_extract(parts[i], r"(\d+)$", 1).cast("int") for i, p in enumerate(DAY_PARTS)})
        rows = flows.normalise_trips(rows.drop("_file"), side, DAY_PARTS)
        rows.repartition(*DAY_PARTS).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*DAY_PARTS).parquet(layer)
    return days


def read_trips(spark: SparkSession, layer: str, from_date: date | Column | None = None,
               to_date: date | Column | None = None) -> DataFrame:
    """Typed trips; with dates only the partitions of that span."""
    rows = spark.read.parquet(layer)
    day = F.make_date("year", "month", "day")
    for bound, inside in ((from_date, day.__ge__), (to_date, day.__le__)):
        if bound is not None:
            rows = rows.where(inside(bound if isinstance(bound, Column) else F.lit(bound)))
    return rows.drop(*DAY_PARTS)
