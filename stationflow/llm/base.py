"""Small helpers that the corpus operators share.

Conventions of every operator in this package: it reads only the columns it names, so
further columns (whatever they are called) neither disturb it nor come back; null texts
count as empty; an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.session import importable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(name: str) -> Column:
    """The column of just that name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(docs: DataFrame) -> list[Column]:
    return [named(c) for c in docs.columns]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns in which null equals null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def each_text(texts: pa.Array, at_once: int = 64) -> Iterator[str | None]:
    """The texts of an Arrow column, few of them as Python objects at a time."""
    for i in range(0, len(texts), at_once):
        yield from texts.slice(i, at_once).to_pylist()
