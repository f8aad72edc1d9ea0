"""Numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(c: Column, places: int) -> Column:
    """A double times 10^places, to the nearest whole number (halves away from zero), and back.

    ``F.round`` rounds the shortest decimal that reads as the double, so 0.00115 becomes 0.0012 at four
    places; the double times 10,000 is just under 11.5, and C and SQL engines that multiply give 0.0011.
    """
    m = float(10**places)
    y = F.abs(c) * m
    whole = F.floor(y)
    return F.signum(c) * (whole + (y - whole >= 0.5).cast("int")) / F.lit(m)
