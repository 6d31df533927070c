"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def instant(moment: datetime | Column) -> Column:
    """A point in time as a column; a datetime without a zone is UTC."""
    if isinstance(moment, Column):
        return moment
    return F.lit(moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc))


def round_half_even(x: Column, digits: int = 6) -> Column:
    """Round the exact binary value of a double, ties to even.

    ``bround`` rounds the printed decimal instead, which turns values just beside a tie into
    ties. Here the factor is split so that ``x * 10^digits`` is the exact sum of two doubles and
    the side of the tie is known. Meant for scores, that is, for values of moderate size.
    """
    scale = float(10**digits)

    def split(v: Column) -> Column:
        wide = v * F.lit(134217729.0)  # 2^27 + 1: the upper half of the digits
        upper = wide - (wide - v)
        return F.struct(upper.alias("upper"), (v - upper).alias("lower"))

    def product(s: Column) -> Column:
        p, q = s["upper"] * F.lit(scale), s["lower"] * F.lit(scale)
        return F.struct(p.alias("p"), q.alias("q"), F.floor(p + q).alias("n"))

    def nearest(s: Column) -> Column:
        beyond, rest = s["p"] - s["n"] - F.lit(0.5), -s["q"]
        up = (beyond > rest) | ((beyond == rest) & (s["n"] % 2 != 0))
        return (s["n"] + F.when(up, 1).otherwise(0)) / F.lit(scale)

    return let(let(let(x, split), product), nearest)
