"""Presentation values of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Font sizes of the word cloud.
SMALLEST_FONT, FONT_SPREAD, ONLY_FONT = 36, 44, 40


def blank(c: Column) -> Column:
    """NULL becomes an empty string."""
    return F.coalesce(c, F.lit(""))


def millions(c: Column) -> Column:
    """Amount in millions with one decimal."""
    return F.round(c / F.lit(1_000_000), 1)


def count_label(c: Column) -> Column:
    """Count with thousands separators (P25)."""
    return F.format_number(F.coalesce(c, F.lit(0)), 0)


def salary_label(c: Column) -> Column:
    """``12.3 M``, or ``N/A`` where there is no mean (P25)."""
    text = F.concat(F.format_string("%.1f", millions(c)), F.lit(" M"))
    return F.when(c.isNull() | (c == 0), F.lit("N/A")).otherwise(text)


def years_label(c: Column) -> Column:
    """``2.5 Years``, or ``0 Years`` where there is no mean (P25)."""
    text = F.concat(F.format_string("%.1f", F.round(c, 1)), F.lit(" Years"))
    return F.when(c.isNull(), F.lit("0 Years")).otherwise(text)


def word_label(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.initcap(c)


def font_size(count: Column, smallest: Column, largest: Column) -> Column:
    """Scale a count to a font size."""
    spread = (count - smallest) / F.nullif(largest - smallest, F.lit(0))
    return F.coalesce(F.lit(SMALLEST_FONT) + spread * FONT_SPREAD, F.lit(float(ONLY_FONT)))
