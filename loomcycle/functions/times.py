"""Times as microseconds since the epoch, in UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def micros_of(value: Column, kind: str) -> Column:
    """From seconds (numeric), ISO text, or a timestamp, by the column's type name; naive texts are UTC. Texts that aren't times give null."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.round(value.cast("double") * 1_000_000).cast("long")
    if kind == "string":
        number = value.try_cast("double")
        return F.coalesce(F.unix_micros(F.try_to_timestamp(value)), F.round(number * 1_000_000).cast("long"))
    if kind.startswith(("timestamp", "date")):
        return F.unix_micros(value.cast("timestamp"))
    raise TypeError(f"no time in a column of {kind}")


def edge_time(dtypes: dict[str, str]) -> Column:
    """The column `datetime` wins over `timestamp`; one of them is needed."""
    found = [micros_of(F.col(c), dtypes[c]) for c in ("datetime", "timestamp") if c in dtypes]
    if not found:
        raise ValueError("edges need a datetime or timestamp column")
    return F.coalesce(*found)


def omega_micros(omega: int | float | dt.timedelta) -> int:
    """A window: numbers are seconds."""
    seconds = omega.total_seconds() if isinstance(omega, dt.timedelta) else float(omega)
    if seconds <= 0:
        raise ValueError("a window is positive")
    return round(seconds * 1_000_000)


def period(micros: Column, kind: str) -> Column:
    """Text of a time's month (2024-03), quarter (2024-Q1) or second (ISO 8601)."""
    ts = F.timestamp_micros(micros)
    if kind == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    return F.date_format(ts, {"month": "yyyy-MM", "iso": "yyyy-MM-dd'T'HH:mm:ss"}[kind])
