"""Reports on flows: missing counts, busy hours, crowding, peaks before events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.config import CROWDING_LINE
from stationflow.functions import clock
from stationflow.operators.shared import flag


def missing_profile(flows: DataFrame) -> DataFrame:
    """Rows per station by which count is missing."""
    ins, outs = F.col("check_ins").isNull(), F.col("check_outs").isNull()
    return flows.groupBy("station").agg(
        F.count("*").alias("n_rows"),
        F.count_if(ins & ~outs).alias("only_ins_missing"),
        F.count_if(~ins & outs).alias("only_outs_missing"),
        F.count_if(ins & outs).alias("both_missing"),
        F.count_if(~ins & ~outs).alias("complete"),
    )


def busy_threshold(flows: DataFrame, per_mille: float = 1.0) -> DataFrame:
    """Lowest check-out count among the busiest ``per_mille`` of a station's rows.

    The group size is rounded half to even; a group of none gives no row. Exact, yet no
    station is sorted as a whole: counts are tallied per value, coarse classes of equal
    logarithm find the class that holds the wanted rank, and only that class is ranked.
    """
    values = flows.where("check_outs IS NOT NULL").groupBy("station", "check_outs").agg(
        F.count("*").alias("n"))
    # Monotone in the count; at most a few thousand classes per station.
    grade = F.floor(F.log2(F.greatest("check_outs", F.lit(0)) + 1.0) * 64).cast("int")
    graded = values.withColumn("grade", F.when(F.col("check_outs") < 0, -1).otherwise(grade))
    classes = graded.groupBy("station", "grade").agg(F.sum("n").alias("n"))
    station = Window.partitionBy("station")
    above = station.orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = classes.select(
        "station", "grade", "n",
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"),
        F.bround(F.sum("n").over(station) / 1000 * per_mille).cast("bigint").alias("wanted"),
    )
    holding = ranked.where("above < wanted AND wanted <= above + n").select(
        "station", "grade", "above", "wanted")
    within = graded.join(holding, ["station", "grade"])
    running = Window.partitionBy("station").orderBy(F.desc("check_outs"))
    reached = within.withColumn("rank", F.col("above") + F.sum("n").over(running))
    return reached.where("rank >= wanted").groupBy("station").agg(
        F.max("check_outs").alias("threshold"), F.first("wanted").alias("top_rows"))


def crowding_flag(rows: DataFrame, total: Column, thresholds: DataFrame | None = None) -> DataFrame:
    """Adds ``total`` and a 0/1 flag for reaching the station's threshold.

    ``thresholds`` (station, threshold) holds one row per station; without it the
    published crowding lines apply.
    """
    if thresholds is None:
        line = F.create_map(*[F.lit(x) for kv in CROWDING_LINE.items() for x in kv])
        out = rows.withColumn("threshold", F.try_element_at(line, F.col("station")).cast("bigint"))
    else:
        out = rows.join(thresholds.select("station", "threshold"), "station", "left")
    return out.withColumn("total", total).withColumn(
        "crowded", flag(F.col("total") >= F.col("threshold")))


def peak_counters(flows: DataFrame, hours_back: int = 4) -> DataFrame:
    """(station, slot, counter): strict running maxima of check-outs looking back.

    Each row is handed to the ``hours_back`` hours that look at it, then one aggregate
    per (station, hour) lines the values up; only hours with a row of their own remain.
    The first hour of a station is left out.
    """
    base = flows.select("station", "check_outs", clock.hour_index("ts").alias("own"))
    spread = base.select("station", "check_outs", "own",
                         F.explode(F.sequence(F.lit(0), F.lit(hours_back - 1))).alias("back"))
    looked = spread.groupBy("station", (F.col("own") + F.col("back")).alias("slot")).agg(
        F.count_if(F.col("back") == 0).alias("present"),
        *[F.max(F.when(F.col("back") == i, F.col("check_outs"))).alias(f"v{i}") for i in range(hours_back)])
    top, counter = F.lit(0).cast("bigint"), F.lit(-1)
    for i in range(hours_back):
        value = F.coalesce(F.col(f"v{i}"), F.lit(0))
        counter = counter + flag(value > top)
        top = F.greatest(top, value)
    first = base.groupBy("station").agg(F.min("own").alias("_first"))
    return looked.where("present > 0").join(first, "station").where("slot > _first").select(
        "station", "slot", counter.alias("counter"))


def peak_lead(flows: DataFrame, events: DataFrame, hours_back: int = 4) -> DataFrame:
    """Mean counter per station over events with visitors that start on a known hour."""
    starts = events.where((F.col("visitors") > 0) & (clock.hour_floor("start_ts") == F.col("start_ts")))
    # Events only weigh the hours: count them before they meet the flows.
    weights = starts.groupBy(clock.hour_index("start_ts").alias("slot")).agg(F.count("*").alias("n"))
    joined = peak_counters(flows, hours_back).join(weights, "slot")
    return joined.groupBy("station").agg(
        F.sum("n").alias("events"),
        (F.sum(F.col("counter") * F.col("n")) / F.sum("n")).alias("mean_counter"))
