"""Random forests per station: filling one-sided gaps, training, forecasting.

One fit grows the trees of all stations side by side, see ``trees``. Training splits nodes on
check-ins and check-outs at once, so a station has one forest with two outputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.config import ForecastConfig
from stationflow.operators import trees
from stationflow.operators.shared import union_all
from stationflow.session import materialise

TARGETS = ("check_ins", "check_outs")
IMPUTE_FEATURES = ("hour", "year", "weekday", "month", "holiday")


def _x(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def _complete(features: Sequence[str]) -> Column:
    """All features are known."""
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    return known


def impute(rows: DataFrame, cfg: ForecastConfig, complete_over: Sequence[str] | None = None) -> DataFrame:
    """Fills a count whose other direction is known; both-missing rows stay.

    Forests learn from rows complete over ``complete_over`` (default: all columns). Known
    counts are never changed. Only stations and directions with a gap get a forest. Gaps of rows
    that lack a feature stay. ``rows`` is read several times: give a materialised table.
    """
    shared = [*IMPUTE_FEATURES, *(["stringency"] if cfg.use_stringency else [])]
    other = dict(zip(TARGETS, reversed(TARGETS), strict=True))
    if cfg.use_stringency:
        rows = rows.fillna({"stringency": 0.0})
    complete = rows.dropna("any", subset=list(complete_over or rows.columns))
    gap = {t: F.col(t).isNull() & F.col(o).isNotNull() for t, o in other.items()}
    model = {t: F.concat(F.lit(f"{t} "), F.col("station")) for t in TARGETS}
    any_gap = gap[TARGETS[0]] | gap[TARGETS[1]]
    named = F.when(gap[TARGETS[0]], model[TARGETS[0]]).otherwise(model[TARGETS[1]])
    x = F.when(gap[TARGETS[0]], _x([*shared, other[TARGETS[0]]])).otherwise(_x([*shared, other[TARGETS[1]]]))
    gaps = materialise(rows.where(any_gap).withColumns({
        "__id": F.monotonically_increasing_id(), "__model": named, "__x": x}), "gaps")
    learn = union_all([complete.select(
        model[t].alias("model"), F.xxhash64(*complete.columns).alias("key"), _x([*shared, o]).alias("x"),
        F.col(t).cast("double").alias("y0")) for t, o in other.items()])
    learn = learn.join(gaps.select(F.col("__model").alias("model")).distinct(), "model", "left_semi")
    settings = {f"{t} {s}": cfg.forest_of(s) for s in cfg.stations for t in TARGETS}
    forest = trees.grow(learn, len(shared) + 1, 1, settings, cfg.max_bins, cfg.seed)
    asked = gaps.where(_complete(shared)).select(F.col("__model").alias("model"), F.col("__id").alias("id"), F.col("__x").alias("x"))
    filled = gaps.join(trees.predict(forest, asked).withColumnRenamed("id", "__id"), "__id", "left")
    # The cast cuts fractions off.
    filled = filled.withColumns({t: F.when(gap[t], F.col("p0").cast("bigint")).otherwise(F.col(t)) for t in TARGETS})
    return rows.where(~any_gap).unionByName(filled.select(*rows.columns))


def train(rows: DataFrame, features: Sequence[str], cfg: ForecastConfig) -> trees.Forest:
    """A forest per station on complete rows, split on both targets at once; see ``incomplete``
    for the others. Stations without rows get none."""
    complete = rows.dropna("any", subset=[*features, *TARGETS])
    learn = complete.select(
        F.col("station").alias("model"), F.xxhash64(*complete.columns).alias("key"), _x(features).alias("x"),
        *[F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(TARGETS)])
    return trees.grow(learn, len(features), len(TARGETS), {s: cfg.forest_of(s) for s in cfg.stations}, cfg.max_bins, cfg.seed)


def predict(forest: trees.Forest, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds both predictions; rows that lack a feature or whose station has no forest are left
    out, see ``incomplete``."""
    if not forest.models:
        raise ValueError("no station has trained models")
    complete = materialise(rows.dropna("any", subset=list(features)).withColumn("__id", F.monotonically_increasing_id()), "asked")
    asked = complete.select(F.col("station").alias("model"), F.col("__id").alias("id"), _x(features).alias("x"))
    found = trees.predict(forest, asked).select(
        F.col("id").alias("__id"), *[F.col(f"p{i}").alias(f"{t}_predicted") for i, t in enumerate(TARGETS)])
    return complete.join(found, "__id").drop("__id")


def incomplete(features: Sequence[str], stations: Sequence[str]) -> dict[str, Column]:
    """Aggregates: for each station the rows that a forecast must leave out."""
    return {s: F.count_if(~_complete(features) & (F.col("station") == s)) for s in stations}
