"""Wall-clock arithmetic on TIMESTAMP_NTZ, independent of the session zone.

Arguments are SQL text: a column name or an expression. One expression crosses from
Python to the JVM as one piece, which keeps plan building quick.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def span(hours: int = 0, minutes: int = 0) -> str:
    """SQL interval."""
    return f"make_dt_interval(0, {hours}, {minutes})"


def _at_hour(date: str, hour: str) -> str:
    return f"(CAST({date} AS {NTZ}) + make_dt_interval(0, {hour}))"


def _floor(ts: str) -> str:
    return _at_hour(f"to_date({ts})", f"hour({ts})")


def _index(ts: str) -> str:
    return f"(unix_date(to_date({ts})) * 24 + hour({ts}))"


def _local(ts: str, zone: str) -> str:
    return f"convert_timezone('UTC', '{zone}', {ts})"


def _date(text: str) -> str:
    # The cast is the cheap way; the pattern is only tried on what it leaves.
    return (f"coalesce(try_cast(substring({text}, 1, 10) AS date), "
            f"try_to_date(substring({text}, 1, 8), 'yyyyMMdd'))")


def hour_floor(ts: str) -> Column:
    return F.expr(_floor(ts))


def hour_index(ts: str) -> Column:
    """Whole hours since 1970-01-01 00:00 on the same wall clock."""
    return F.expr(_index(ts))


def hour_index_up(ts: str) -> Column:
    """Index of the first full hour at or after ``ts``."""
    return F.expr(f"{_index(ts)} + IF({_floor(ts)} = {ts}, 0, 1)")


def local_from_index(index: str, zone: str) -> Column:
    """Local timestamp of a UTC hour index."""
    utc = _at_hour(f"date_from_unix_date(CAST(floor({index} / 24) AS int))", f"pmod({index}, 24)")
    return F.expr(_local(utc, zone))


def local_from_epoch(seconds: str, zone: str) -> Column:
    """Local timestamp of epoch seconds."""
    return F.expr(_local(_epoch(seconds), zone))


def _epoch(seconds: str) -> str:
    return f"(TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({seconds} AS decimal(18, 6))))"


def utc_from_epoch(seconds: str, shift_hours: int = 0) -> Column:
    return F.expr(f"{_epoch(seconds)} + {span(shift_hours)}")


def utc_to_local(ts: str, zone: str) -> Column:
    return F.expr(_local(ts, zone))


def utc_at_hour(date_text: str, hour: str) -> Column:
    """Timestamp of a date in text form and an hour number."""
    return F.expr(_at_hour(_date(date_text), f"CAST({hour} AS int)"))


def parse_date_text(text: str) -> Column:
    """Date part of ``yyyy-MM-dd...`` or ``yyyyMMdd...`` text, else null."""
    return F.expr(_date(text))


def clock_text(ts: str) -> Column:
    """``HH:mm`` of a timestamp."""
    return F.expr(f"substring(CAST({ts} AS string), 12, 5)")


def join_date_time(date: str, clock: str) -> Column:
    """Date plus ``HH:mm`` text; null when the text is not a time of day."""
    return F.expr(f"""
        CASE WHEN {clock} RLIKE '^([01][0-9]|2[0-3]):[0-5][0-9]$' THEN CAST({date} AS {NTZ})
          + make_dt_interval(0, try_cast(substring({clock}, 1, 2) AS int), try_cast(substring({clock}, 4, 2) AS int))
        END""")
