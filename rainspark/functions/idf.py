"""Closed-form expressions of the intensity-duration-frequency model."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

GUMBEL_SCALE = 1.282
GUMBEL_SHIFT = 0.450047


def reduced_variate(t: float) -> float:
    return -math.log(math.log(t / (t - 1.0)))


def gumbel_quantile(mean: Column, std: Column, t: float) -> Column:
    """24 h depth of return period `t` years; NULL when the spread is missing or 0."""
    factor = reduced_variate(t) / GUMBEL_SCALE - GUMBEL_SHIFT
    return F.when(std > 0, mean + std * F.lit(factor))


def sherman_intensity(K: Column, a: Column, b: Column, c: Column, minutes: Column, t: Column) -> Column:
    """I = K * T^a / (b + minutes)^c in mm/h."""
    return K * F.pow(t.cast("double"), a) / F.pow(b + minutes.cast("double"), c)
