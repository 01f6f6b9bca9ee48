"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "stationflow", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on. Cluster sizes stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets the Python workers of a local session find this package wherever it was started.

    On a cluster the package is installed or shipped like any other (``--py-files``).
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


_RUN: ContextVar[str | None] = ContextVar("run_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A local session that sets none uses a folder beside its warehouse; on a cluster the
    setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """Tables written inside go to one folder, which is removed at the end."""
    folder = fresh_path(spark, name)
    before = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{(_RUN.get() or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise_counted(df: DataFrame, name: str, counts: dict[str, Column],
                        partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """Like :func:`materialise`, with aggregates of the rows that are written.

    They are taken while the rows pass by, so they cost no job of their own.
    """
    seen = Observation()
    df = materialise(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name, partition_by)
    return df, seen.get


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and makes several
    consumers share one computation.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
