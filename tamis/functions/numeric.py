"""Numbers as int64: the ranges that block metadata keeps, and rounded values. Numbers beyond int64 stop at its ends."""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, ROUND_FLOOR, ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, MOST = -(2**63), 2**63 - 1
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONS = (T.FloatType, T.DoubleType)


def clamp(x: int) -> int:
    return max(LEAST, min(MOST, x))


def int_range(x) -> tuple[int, int] | None:
    """(floor, ceiling) of a number as int64s; None for anything else and for NaN."""
    if isinstance(x, bool) or not isinstance(x, int | float | Decimal):
        return None
    if isinstance(x, int):
        return clamp(x), clamp(x)
    if x != x:
        return None
    if x in (math.inf, -math.inf):
        return (MOST, MOST) if x > 0 else (LEAST, LEAST)
    exact = Decimal(x)
    return clamp(int(exact.to_integral_value(ROUND_FLOOR))), clamp(int(exact.to_integral_value(ROUND_CEILING)))


def rounded(x) -> int | None:
    """The nearest int64, halves away from zero."""
    ends = int_range(x)
    if ends is None:
        return None
    return ends[0] if isinstance(x, int) or x in (math.inf, -math.inf) else clamp(int(Decimal(x).to_integral_value(ROUND_HALF_UP)))


def range_columns(x: Column, kind: T.DataType) -> tuple[Column, Column] | None:
    """int_range() for a column; null for nulls and NaN. None if values of this type have no range."""
    if isinstance(kind, WHOLE):
        whole = x.cast("long")
        return whole, whole
    if isinstance(kind, FRACTIONS):
        d = x.cast("double")
        ends = [F.when(d.isNotNull() & ~F.isnan(d), F.when(d >= F.lit(2.0**63), F.lit(MOST)).when(d <= F.lit(-(2.0**63)), F.lit(LEAST)).otherwise(f(d).cast("long"))) for f in (_floor, _ceiling)]
        return ends[0], ends[1]
    if isinstance(kind, T.DecimalType):
        ends = [F.when(f(x) > F.lit(MOST), F.lit(MOST)).when(f(x) < F.lit(LEAST), F.lit(LEAST)).otherwise(f(x).try_cast("long")) for f in (F.floor, F.ceil)]
        return ends[0], ends[1]
    return None


def _floor(d: Column) -> Column:
    return F.floor(F.when(F.abs(d) < F.lit(2.0**63), d).otherwise(F.lit(0.0)))


def _ceiling(d: Column) -> Column:
    return F.ceil(F.when(F.abs(d) < F.lit(2.0**63), d).otherwise(F.lit(0.0)))


def rounded_column(x: Column, kind: T.DataType) -> Column | None:
    """rounded() for a column."""
    if isinstance(kind, FRACTIONS):
        d = x.cast("double")
        small = F.when(F.abs(d) < F.lit(2.0**52), d).otherwise(F.lit(0.0))
        half_away = F.when(small >= 0, F.floor(small)).otherwise(F.ceil(small))
        step = F.when(F.abs(small - half_away) >= 0.5, F.signum(small)).otherwise(F.lit(0.0)).cast("long")
        low, _ = range_columns(x, kind)
        return F.when(d.isNull() | F.isnan(d), F.lit(None).cast("long")).when(F.abs(d) < F.lit(2.0**52), half_away.cast("long") + step).otherwise(low)
    ends = range_columns(x, kind)
    if ends is None or isinstance(kind, WHOLE):
        return ends and ends[0]
    whole = F.round(x, 0)
    return F.when(whole > F.lit(MOST), F.lit(MOST)).when(whole < F.lit(LEAST), F.lit(LEAST)).otherwise(whole.try_cast("long"))
