"""Rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits at which two ways of adding the same numbers still agree.
SETTLED_DIGITS = 9


def half_even(value: Column, digits: int) -> Column:
    """To ``digits`` decimals, halves to even, in binary arithmetic as array libraries do.

    ``bround`` rounds the printed decimal instead, which differs for 1.015.
    """
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def settled(value: Column) -> Column:
    """Drop the last bits of a mean, which depend on the order of summation.

    Needed before a mean is rounded to few digits or compared with another one.
    """
    return F.round(value, SETTLED_DIGITS)
