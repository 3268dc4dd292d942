"""Numeric column expressions under one rule: missing is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def coerce_numeric(c: Column) -> Column:
    """Text or number to double; what cannot be read is NULL."""
    return finite(c.try_cast("double"))


def clip_low(c: Column, low: float) -> Column:
    """Raise to `low` but keep NULL (greatest() alone would swallow it)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(low))))


def cap(c: Column, low: float | None, high: float | None) -> Column:
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def within_or_null(c: Column, low: float, high: float | None) -> Column:
    """Values outside [low, high] become NULL; `high=None` leaves the top open."""
    ok = c >= F.lit(float(low))
    if high is not None:
        ok = ok & (c <= F.lit(float(high)))
    return F.when(ok, c)


def mask_nodata(c: Column, nodata: float | None = None, huge: float = 1e19) -> Column:
    """Nodata marker, absurdly large and non-finite values become NULL."""
    x = finite(c.cast("double"))
    bad = F.abs(x) > F.lit(huge)
    if nodata is not None:
        bad = bad | (x == F.lit(float(nodata)))
    return F.when(~bad, x)


def decode_scale_offset(raw: Column, scale: float, offset: float, floor0: bool = False) -> Column:
    mm = raw.cast("double") * F.lit(float(scale)) + F.lit(float(offset))
    return clip_low(mm, 0.0) if floor0 else mm


def safe_ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))
