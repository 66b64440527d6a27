"""Similarities as labels, and labels as similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(similarity: Column) -> Column:
    """Percent with one decimal, halves to even."""
    return F.format_string("%.1f%%", F.bround(similarity.cast("double") * 100, 1))


def percent(text: Column) -> Column:
    """The number before a label's percent sign; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9.]+)\s*%", 1), F.lit("")).cast("double")
