"""Time-based splits, forecast metrics and the quality gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_last_date(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    # Complete rows only; the side that is joined has one row per station.
    complete = rows.dropna("any", subset=list(columns))
    last = complete.groupBy("station").agg(F.max("date").alias("_last"))
    return complete.join(last, "station")


def split_labels(rows: DataFrame, columns: Sequence[str] = ("check_ins", "check_outs")) -> DataFrame:
    """Last 7 dates per station are ``test``, the 7 before ``validation``, the rest ``train``."""
    dated = _with_last_date(rows, columns)
    age = F.datediff("_last", "date")
    return dated.withColumn(
        "split", F.when(age < 7, "test").when(age < 14, "validation").otherwise("train")).drop("_last")


def split_labels_2way(rows: DataFrame, columns: Sequence[str] = ("check_ins", "check_outs")) -> DataFrame:
    """Last 7 dates per station are ``test``, the rest ``train``."""
    dated = _with_last_date(rows, columns)
    return dated.withColumn(
        "split", F.when(F.datediff("_last", "date") < 7, "test").otherwise("train")).drop("_last")


def forecast_metrics(rows: DataFrame, keys: Sequence[str] = ("station",),
                     targets: Sequence[str] = ("check_ins", "check_outs")) -> DataFrame:
    """R2, MAE and RMSE over both outputs, one pass per key.

    R2 and MAE are means over the outputs; RMSE is the root of the mean of both MSEs.
    """
    parts, r2, mae, mse = [], [], [], []
    for t in targets:
        actual, error = F.col(t).cast("double"), F.col(t) - F.col(f"{t}_predicted")
        parts += [
            F.sum(error * error).alias(f"{t}_sse"),
            F.avg(F.abs(error)).alias(f"{t}_mae"),
            (F.var_pop(actual) * F.count(actual)).alias(f"{t}_sst"),
        ]
        sse, sst = F.col(f"{t}_sse"), F.col(f"{t}_sst")
        r2.append(F.when(sst > 0, 1 - F.try_divide(sse, sst)).when(sse == 0, 1.0).otherwise(0.0))
        mae.append(F.col(f"{t}_mae"))
        mse.append(sse / F.col("n"))
    totals = rows.dropna(subset=[*targets, *[f"{t}_predicted" for t in targets]]).groupBy(*keys).agg(
        F.count("*").alias("n"), *parts)

    def mean(columns):
        return sum(columns[1:], columns[0]) / len(columns)

    return totals.select(*keys, "n", mean(r2).alias("r2"), mean(mae).alias("mae"),
                         F.sqrt(mean(mse)).alias("rmse"))


def quality_gate(metrics: DataFrame, least_r2: float = 0.7) -> DataFrame:
    """Models whose R2 is below the line."""
    return metrics.where(F.col("r2") < least_r2)


def below_line(least_r2: float = 0.7) -> Column:
    """Aggregate of metrics: station and R2 of the models that the gate holds."""
    return F.collect_list(F.when(F.col("r2") < least_r2, F.struct("station", "r2")))
