"""Hourly check-in and check-out counts per station or stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.functions import clock

# Column names of the raw trip files.
RAW_ORIGIN = {
    "Datum": "date",
    "UurgroepOmschrijving (van vertrek)": "hour_band",
    "VertrekHalteCode": "stop_code",
    "VertrekHalteNaam": "station",
    "AantalReizen": "trips",
}
RAW_DESTINATION = {
    "Datum": "date",
    "UurgroepOmschrijving (van aankomst)": "hour_band",
    "AankomstHalteCode": "stop_code",
    "AankomstHalteNaam": "station",
    "AantalReizen": "trips",
}


def normalise_trips(raw: DataFrame, side: str, kept: Sequence[str] = ()) -> DataFrame:
    """Raw trip rows of one side (``"in"`` or ``"out"``) with common names and types; ``kept`` names
    further columns that stay."""
    names = RAW_ORIGIN if side == "in" else RAW_DESTINATION
    out = raw.withColumnsRenamed(names)
    return out.withColumns({
        "date": clock.parse_date_text("CAST(date AS string)"),
        "trips": F.col("trips").cast("bigint"),
    }).select("date", "hour_band", "stop_code", "station", "trips", *kept)


def dedup_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates removed over all columns."""
    return df.dropDuplicates()


def _flows(ins: DataFrame, outs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides in one pass: tag, dedup, then one conditional sum per key.

    Grouping the tagged union gives what a full outer join of two sums gives, null
    keys matched, with one shuffle fewer per side and no sort-merge join.
    """
    tagged = ins.withColumn("_in", F.lit(True)).unionByName(outs.withColumn("_in", F.lit(False)))
    return tagged.dropDuplicates().groupBy(*keys).agg(
        F.sum(F.when(F.col("_in"), F.col("trips"))).alias("check_ins"),
        F.sum(F.when(~F.col("_in"), F.col("trips"))).alias("check_outs"),
    )


def hourly_flows(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """Check-ins and check-outs per (date, hour band, station); a missing side is null."""
    keys = ("date", "hour_band", "station")
    return _flows(ins, outs, keys).dropna(subset=list(keys)).where(
        "check_ins IS NOT NULL OR check_outs IS NOT NULL")


def stop_flows(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """As :func:`hourly_flows`, also per stop code. Null keys match null keys."""
    return _flows(ins, outs, ("date", "hour_band", "stop_code", "station"))


def stop_types(flows: DataFrame, stops: DataFrame) -> DataFrame:
    """Adds the stop type; stops without one are dropped."""
    types = stops.select(F.col("arrival_stop_code").alias("stop_code"), "type")
    return flows.join(types, "stop_code", "inner")
