"""Small helpers used by several operators."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank filter lets Spark cut each map task to one row per key before the
    shuffle, so a key with very many copies stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as it is; a key that occurs twice fails the query that reads it.

    Side tables pass through here before a join, so that no join can fan rows out. The join
    itself is left to the optimizer and adaptive execution, which see the true sizes.
    """
    columns = [c for c in df.columns if c not in keys]
    twice = F.raise_error(F.concat(F.lit(f"more than one row for one {', '.join(keys)}: "), F.to_json(F.struct(*keys))))
    rows = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.first(F.struct(*columns) if columns else F.lit(1)).alias("_row"))
    # The check is part of the key, so no projection can drop it.
    first = F.when(F.col("_n") > 1, twice.cast(df.schema[keys[0]].dataType)).otherwise(F.col(keys[0])).alias(keys[0])
    return rows.select(first, *keys[1:], *[F.col("_row").getField(c).alias(c) for c in columns])


def safe_sequence(low: Column, high: Column) -> Column:
    """Integer range low..high, empty when a bound is null or low > high."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_map(values: dict[str, str]) -> Column:
    """Constant map of texts."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in values.items()) + ")")


def text_array(values: Sequence[str]) -> Column:
    """Constant array of texts."""
    return F.expr("array(" + ", ".join(map(quoted, values)) + ")")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def fixed_table(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small constant table, known to the optimizer with its exact size."""
    columns = list(zip(*rows, strict=True))
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, columns), strict=True))))
