"""Text extraction: Dutch date-times in captions and links in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions.clock import NTZ

# Dutch month names and short forms, with their month number.
MONTHS = {
    "januari": 1, "februari": 2, "maart": 3, "april": 4, "mei": 5, "juni": 6,
    "juli": 7, "augustus": 8, "september": 9, "oktober": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mrt": 3, "apr": 4, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dec": 12,
}
# Only these short forms are looked for; "jun" and "jul" appear inside the full names.
_SOUGHT = [m for m in MONTHS if m not in ("jun", "jul")]
DAY_MONTH = r"(?i)([0-9][0-9])\s+(" + "|".join(_SOUGHT) + ")"
CLOCK = r"([01][0-9]|2[0-3])[:.]([0-5][0-9])"
CLOCK_BEFORE_20 = r"([01][0-9])[:.]([0-5][0-9])"


def caption_parts(text: str, clock_pattern: str = CLOCK) -> dict[str, Column]:
    """First day-month and first time of day in ``text``; empty when there is none."""
    return {
        "_day_month": F.regexp_extract(text, DAY_MONTH, 0),
        "_clock": F.regexp_extract(text, clock_pattern, 0),
    }


def caption_moment(year: str) -> Column:
    """Timestamp of the parts in ``year``.

    Null when either part is missing or when the date does not exist.
    """
    numbers = ", ".join(f"'{name}', '{number}'" for name, number in MONTHS.items())
    return F.expr(f"""
        CASE WHEN _day_month <> '' AND _clock <> '' THEN try_cast(concat(
            {year}, '-', try_element_at(map({numbers}), lower(regexp_extract(_day_month, '[a-zA-Z]+', 0))), '-',
            substring(_day_month, 1, 2), ' ', translate(_clock, '.', ':')) AS {NTZ}) END""")


def with_caption_datetime(df: DataFrame, text: str, year: str, name: str = "event_date",
                          clock_pattern: str = CLOCK) -> DataFrame:
    """Adds the date and time that a caption names, read in ``year`` (SQL text).

    The parts are columns of their own, so each pattern runs once per row.
    """
    parts = df.withColumns(caption_parts(text, clock_pattern))
    return parts.withColumn(name, caption_moment(year)).drop("_day_month", "_clock")


def first_link(html: Column, pattern: str) -> Column:
    """First match of ``pattern``; null without a match."""
    return F.nullif(F.regexp_extract(html, pattern, 0), F.lit(""))


def link_count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern))
