"""Folds and array expressions for ordered, short vectors.

Every array here is bounded by the domain: exceedance days of one station-year, the years of one
cell, the durations of one ratio vector, the knots of one mapping model.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

EULER_GAMMA = 0.5772156649015329


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` loops over an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decluster(events: Column, gap_days: int) -> Column:
    """Keep an event when it is `gap_days` or more after the last kept one.

    `events` is an array of structs whose first field is a date, sorted by it.
    """
    empty = F.filter(events, lambda e: F.lit(False))

    def step(kept: Column, e: Column) -> Column:
        last = F.element_at(kept, -1)["date"]
        far = (F.size(kept) == 0) | (F.datediff(e["date"], last) >= gap_days)
        return F.when(far, F.concat(kept, F.array(e))).otherwise(kept)

    # element_at(-1) on the empty array would raise in ANSI mode, so seed with the first event
    return F.when(F.size(events) == 0, empty).otherwise(
        F.aggregate(F.slice(events, F.lit(2), F.size(events)), F.slice(events, 1, 1), step)
    )


def felt_terms(x: Column, terms: int) -> Column:
    """How many of the terms (-1)^(j-1) exp(x j^2), x at most 0, can change their sum; `terms` at most.

    They alternate and fall, so all partial sums lie between exp(x) - exp(4x) and exp(x). A term with
    -x (j^2 - 1) > 45 is below half the last bit of these, for up to 100 terms.
    """
    last = F.sqrt(F.lit(1.0) + F.lit(45.0) / F.nullif(-x, F.lit(0.0)))
    return F.ceil(F.least(F.lit(float(terms)), last)).cast("int")


def ks_p_value(d: Column, n: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov p-value with the small-sample argument, clamped to [0, 1]."""
    en = F.sqrt(n.cast("double"))
    lam = (en + F.lit(0.12) + F.lit(0.11) / en) * d

    def series(x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), felt_terms(x, terms)),
            F.lit(0.0),
            lambda s, j: s + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(x * j * j),
        )

    total = let(F.lit(-2.0) * lam * lam, series)
    return F.when(d.isNotNull(), F.least(F.greatest(F.lit(2.0) * total, F.lit(0.0)), F.lit(1.0)))


def gumbel_ks_distance(sorted_values: Column, mean: Column, std: Column, n: Column) -> Column:
    """Largest gap between (i-0.5)/n and the moment-fitted Gumbel CDF; NULL when std is 0."""
    beta = std * F.lit(math.sqrt(6.0) / math.pi)
    mu = mean - F.lit(EULER_GAMMA) * beta

    def gap(x: Column, i: Column) -> Column:
        cdf = F.exp(-F.exp(-(x - mu) / beta))
        return F.abs((i + F.lit(0.5)) / n - cdf)

    return F.when(std > 0, F.array_max(F.transform(sorted_values, gap)))


def cumulative_max(values: Column, high: float | None = 1.0) -> Column:
    """Running maximum capped at `high`; a vector with any NULL is left as it is."""
    def step(acc: Column, x: Column) -> Column:
        top = F.greatest(F.element_at(acc, -1), x)
        return F.concat(acc, F.array(top))

    run = F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.slice(values, 1, 1), step)
    if high is not None:
        run = F.transform(run, lambda x: F.least(x, F.lit(float(high))))
    complete = F.forall(values, lambda x: x.isNotNull())
    return F.when(complete, run).otherwise(values)


def repair_monotone(values: Column, tol: float = 1e-6, high: float = 1.0) -> Column:
    """Non-decreasing ratios: struct(out, violations, magnitude, lifts).

    Clamp to [0, high], last value 1, then lift every value that is more than `tol` below the
    last one seen. NULL is skipped and stays NULL.
    """
    n = F.size(values)
    clamped = F.transform(
        values,
        lambda x, i: F.when(i == n - 1, F.lit(1.0)).when(
            x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(float(high)))
        ),
    )
    start = F.struct(
        F.lit(float("-inf")).alias("last"),
        F.lit(0).alias("violations"),
        F.lit(0.0).alias("magnitude"),
        F.filter(clamped, lambda x: F.lit(False)).alias("lifts"),
        F.filter(clamped, lambda x: F.lit(False)).alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        low = x.isNotNull() & (s["last"] > x + F.lit(tol))
        y = F.when(low, s["last"]).otherwise(x)
        return F.struct(
            F.coalesce(y, s["last"]).alias("last"),
            (s["violations"] + F.when(low, 1).otherwise(0)).alias("violations"),
            (s["magnitude"] + F.when(low, s["last"] - x).otherwise(F.lit(0.0))).alias("magnitude"),
            F.when(low, F.concat(s["lifts"], F.array(s["last"] - x))).otherwise(s["lifts"]).alias("lifts"),
            F.concat(s["out"], F.array(y)).alias("out"),
        )

    return F.aggregate(
        clamped, start, step,
        lambda s: F.struct(s["out"], s["violations"], s["magnitude"], s["lifts"]),
    )


def pchip_slopes(p: Column, g: Column) -> Column:
    """Knot slopes of the monotone cubic through (p_i, g_i), two knots or more.

    Equal knots have no slope between them: those slopes are NULL, and so is what depends on them.
    """
    n = F.size(p)
    h = F.transform(F.slice(p, F.lit(2), n), lambda x, i: F.nullif(x - F.get(p, i), F.lit(0.0)))
    m = F.transform(F.slice(g, F.lit(2), n), lambda y, i: (y - F.get(g, i)) / F.get(h, i))

    def edge(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
        d = ((F.lit(2.0) * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        flipped = F.signum(d) != F.signum(m0)
        overshoot = (F.signum(m0) != F.signum(m1)) & (F.abs(d) > F.lit(3.0) * F.abs(m0))
        return F.when(flipped, F.lit(0.0)).when(overshoot, F.lit(3.0) * m0).otherwise(d)

    def slope(_: Column, i: Column) -> Column:
        m0, m1 = F.get(m, i - 1), F.get(m, i)
        h0, h1 = F.get(h, i - 1), F.get(h, i)
        w0, w1 = F.lit(2.0) * h1 + h0, h1 + F.lit(2.0) * h0
        inner = F.when((m0 * m1) <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / m0 + w1 / m1))
        first = edge(F.get(h, F.lit(0)), F.get(h, F.lit(1)), F.get(m, F.lit(0)), F.get(m, F.lit(1)))
        last = edge(F.get(h, n - 2), F.get(h, n - 3), F.get(m, n - 2), F.get(m, n - 3))
        return F.when(n == 2, F.get(m, F.lit(0))).when(i == 0, first).when(i == n - 1, last).otherwise(inner)

    return F.transform(p, slope)


def hermite_with_linear_tails(x: Column, p: Column, g: Column, d: Column) -> Column:
    """Cubic Hermite value at `x`; straight lines of the end segments outside the knots."""
    n = F.size(p)
    i = F.greatest(F.least(F.size(F.filter(p, lambda v: v <= x)) - 1, n - 2), F.lit(0))
    p0, p1, g0, g1 = F.get(p, i), F.get(p, i + 1), F.get(g, i), F.get(g, i + 1)
    h = p1 - p0
    t = (x - p0) / F.nullif(h, F.lit(0.0))
    inside = (
        (F.lit(2.0) * t * t * t - F.lit(3.0) * t * t + F.lit(1.0)) * g0
        + (t * t * t - F.lit(2.0) * t * t + t) * h * F.get(d, i)
        + (F.lit(-2.0) * t * t * t + F.lit(3.0) * t * t) * g1
        + (t * t * t - t * t) * h * F.get(d, i + 1)
    )
    line = (g1 - g0) / F.greatest(h, F.lit(1e-12))
    above = F.get(g, n - 1) + line * (x - F.get(p, n - 1))
    below = F.get(g, F.lit(0)) + line * (x - F.get(p, F.lit(0)))
    return F.when(x > F.get(p, n - 1), above).when(x < F.get(p, F.lit(0)), below).otherwise(inside)
