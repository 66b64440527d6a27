"""Dates of folders and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_time(mtime: Column, ctime: Column, mode: str) -> Column:
    return {"mtime": mtime, "ctime": ctime, "hybrid": F.greatest(mtime, ctime)}[mode]


def in_window(ts: Column, start: str | None, end: str | None) -> Column:
    """Whole days, the last one included."""
    out = F.lit(True)
    if start:
        out = out & (ts >= F.lit(start).cast("date").cast("timestamp"))
    if end:
        out = out & (ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return out


def two_months_back(day: Column) -> Column:
    """The first day of the month two months ago."""
    return F.trunc(F.add_months(day, -2), "MM")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)
