"""The four rounding rules of the data model. They differ, so each has a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Nearest integer, ties to the even one: plane coordinates."""
    return F.rint(x).cast("long")


def half_away(x: Column) -> Column:
    """Nearest integer, ties away from zero: configured units."""
    return F.when(x < 0, -F.floor(0.5 - x)).otherwise(F.floor(x + 0.5)).cast("long")


def half_up(x: Column) -> Column:
    """floor(x + 0.5): walking times."""
    return F.floor(x + 0.5).cast("long")


def ratio(n: Column, d: Column) -> Column:
    """Integer n / d rounded half up for n >= 0, d > 0, without floating point: ride and arc weights."""
    return F.floor((2 * n + d - F.pmod(2 * n + d, 2 * d)) / (2 * d)).cast("long")


def cents(x: Column) -> Column:
    """A price as whole cents."""
    return F.round(x * 100).cast("long")
