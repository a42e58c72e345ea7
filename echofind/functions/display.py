"""Rules the result views follow: percent, confidence band, status class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds in percent and their labels.
BANDS = ((90, "Very high"), (75, "High"), (55, "Moderate"))
LOWEST_BAND = "Low"


def similarity_of(similarity: Column, distance: Column) -> Column:
    """The similarity, or 1 - distance where it is missing or zero, else 0."""
    given = F.when(similarity != 0, similarity)
    return F.coalesce(given, 1 - distance, F.lit(0.0))


def percent(fraction: Column) -> Column:
    """A similarity fraction in percent, clamped to 0..100; NaN and NULL give 0."""
    number = F.coalesce(F.nanvl(fraction, F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(number * 100, F.lit(0.0)), F.lit(100.0))


def confidence_band(pct: Column) -> Column:
    chain = reduce(
        lambda c, band: c.when(pct >= band[0], F.lit(band[1])),
        BANDS[1:],
        F.when(pct >= BANDS[0][0], F.lit(BANDS[0][1])),
    )
    return chain.otherwise(F.lit(LOWEST_BAND))


def status_class(status: Column) -> Column:
    """open, resolved or neutral. ``UNRESOLVED`` counts as open here."""
    s = F.lower(status)
    return (
        F.when(s.contains("unresolved") | s.contains("open") | s.contains("new"), F.lit("open"))
        .when(s.contains("closed") | s.contains("resolved"), F.lit("resolved"))
        .otherwise(F.lit("neutral"))
    )
