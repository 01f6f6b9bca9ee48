"""As-of lookup: for each moment the last value known by then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.functions import clock


def as_of(moments: DataFrame, known: DataFrame, by: Sequence[str], ts: str = "ts", found: str = "found_ts",
          within_hours: int | None = None, block_hours: int = 24) -> DataFrame:
    """``moments`` with the values of the latest row of ``known`` at or before them, same ``by``.

    Times may lie anywhere, on no grid. Both sides are united and cut into blocks of time; inside a
    block a window carries the last known row forward, and one row a block tells the following
    blocks with which it ends. So a key with a third of all rows is spread over its blocks, and
    nothing is laid out in hours. ``found`` is the time of the row that was found; all is null
    where there is none, or none within ``within_hours``. Of several known rows of one time the
    one with the greatest values counts. Nulls in ``by`` are equal, moments without a time find
    nothing, known rows without one are never found. Every moment comes back once.
    """
    values = [c for c in known.columns if c not in (*by, ts)]
    block = F.floor(clock.hour_index(ts) / block_hours)
    row = F.struct(F.col(ts).alias("_at"), *values)
    right = known.where(F.col(ts).isNotNull()).select(*by, ts, row.alias("_row"))
    both = moments.withColumn("_asks", F.lit(1)).unionByName(
        right.withColumn("_asks", F.lit(0)), allowMissingColumns=True).withColumn("_block", block)
    # A row known at a moment's own time comes before it.
    seen = Window.partitionBy(*by, "_block").orderBy(ts, "_asks", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = both.withColumn("_row", F.last("_row", ignorenulls=True).over(seen)).where("_asks = 1")
    ends = both.groupBy(*by, "_block").agg(F.max("_row").alias("_end"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    keys = {f"_key{i}": name for i, name in enumerate((*by, "_block"))}
    carried = ends.select(*[F.col(name).alias(key) for key, name in keys.items()],
                          F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    same = F.lit(True)
    for key, name in keys.items():
        same = same & F.col(name).eqNullSafe(F.col(key))
    out = asked.join(carried, same).withColumn("_row", F.coalesce("_row", "_carried"))
    if within_hours is not None:
        out = out.withColumn("_row", F.when(F.expr(f"{ts} <= _row._at + {clock.span(within_hours)}"), F.col("_row")))
    return out.select(*moments.columns, F.col("_row._at").alias(found), *[F.col(f"_row.{c}") for c in values])
