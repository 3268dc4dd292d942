import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainspark.functions import numeric, series
from rainspark.operators import extremes


def test_decluster_against_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for code in range(40):
        days = sorted(rng.sample(range(120), rng.randint(1, 60)))
        rows += [(str(code), 2000, dt.date(2000, 1, 1) + dt.timedelta(days=d), 2.0 + d) for d in days]
        kept = []
        for d in days:
            if not kept or d - kept[-1] >= 3:
                kept.append(d)
        want[str(code)] = kept
    df = spark.createDataFrame(rows, "code string, year int, date date, pr_g double")
    got: dict = {}
    for r in extremes.declustered(df).orderBy("date").collect():
        got.setdefault(r.code, []).append((r.date - dt.date(2000, 1, 1)).days)
    assert got == want
    # fewer events than asked for drops the year, and 1 mm or less drops the event
    assert extremes.declustered(df, min_per_year=1000).count() == 0
    assert extremes.declustered(df, min_mm=1000.0).count() == 0


def test_threshold_is_strict_and_needs_thirty_days(spark):
    start = dt.date(2000, 1, 1)
    rows = [("flat", start + dt.timedelta(days=i), 5.0) for i in range(60)]
    rows += [("short", start + dt.timedelta(days=i), float(i)) for i in range(29)]
    rows += [("ok", start + dt.timedelta(days=i), float(i)) for i in range(30)]
    rows += [("ok", start + dt.timedelta(days=100), 900.0)]
    df = spark.createDataFrame(rows, "code string, date date, pr_g double")
    assert [(r.code, r.pr_g) for r in extremes.exceedances(df).collect()] == [("ok", 29.0)]
    assert [r.pr_g for r in extremes.exceedances(df, max_mm=None).collect()] == [900.0]


def repair(values, tol=1e-6):
    out = [None if v is None else min(max(v, 0.0), 1.0) for v in values]
    out[-1] = 1.0
    last, count, size = float("-inf"), 0, 0.0
    for i, v in enumerate(out):
        if v is None:
            continue
        if last > v + tol:
            count, size, out[i] = count + 1, size + last - v, last
        last = out[i]
    return out, count, size


def test_monotone_repair_against_a_loop(spark):
    rng = random.Random(5)
    vectors = [
        [None if rng.random() < 0.1 else rng.uniform(-0.2, 1.3) for _ in range(12)] for _ in range(200)
    ] + [[0.5, 0.5 - 1e-7, 0.5 - 1e-6, 0.9], [None] * 4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id int, v array<double>")
    for r in df.withColumn("r", series.repair_monotone(F.col("v"))).collect():
        out, count, size = repair(vectors[r.id])
        assert r.r.out == out and r.r.violations == count and r.r.magnitude == pytest.approx(size)
        seen = [x for x in r.r.out if x is not None]
        assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:])) and seen[-1] == 1.0


def test_cumulative_max_leaves_gaps_alone(spark):
    rows = [([0.1, 0.05, 0.4, 1.0],), ([0.1, None, 0.05, 1.0],), ([0.5, 1.4, 0.2],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(series.cumulative_max(F.col("v"))).collect()]
    assert got == [[0.1, 0.1, 0.4, 1.0], [0.1, None, 0.05, 1.0], [0.5, 1.0, 1.0]]


def test_ks_p_value_matches_the_full_series(spark):
    rows = [(d, n) for d in (0.0, 1e-4, 0.01, 0.05, 0.1, 0.2, 0.35, 0.6, 1.0) for n in (5, 12, 31)]
    df = spark.createDataFrame(rows, "d double, n bigint").withColumn("p", series.ks_p_value(F.col("d"), F.col("n")))
    for r in df.collect():
        lam = (r.n ** 0.5 + 0.12 + 0.11 / r.n ** 0.5) * r.d
        total = sum((-1) ** (j - 1) * np.exp(-2.0 * j * j * lam * lam) for j in range(1, 101))
        assert r.p == pytest.approx(max(min(2 * total, 1), 0), abs=1e-12)
        assert 0.0 <= r.p <= 1.0


def test_null_rules(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(None,), (nan,), (inf,), (-9999.0,), (3e19,), (2.5,)], "v double")
    assert [r[0] for r in df.select(numeric.mask_nodata(F.col("v"), -9999.0)).collect()] == [None] * 5 + [2.5]
    df = spark.createDataFrame([(None,), (-1.0,), (7.0,)], "v double")
    assert [r[0] for r in df.select(numeric.clip_low(F.col("v"), 0.0)).collect()] == [None, 0.0, 7.0]
    assert [r[0] for r in df.select(numeric.cap(F.col("v"), 0.25, 5.0)).collect()] == [None, 0.25, 5.0]
    text = spark.createDataFrame([("1.5",), ("x",), ("",), ("NaN",)], "v string")
    assert [r[0] for r in text.select(numeric.coerce_numeric(F.col("v"))).collect()] == [1.5, None, None, None]


def pchip(x, p, g):
    """Monotone cubic by the published formulas, one value at a time."""
    h, m = np.diff(p), np.diff(g) / np.diff(p)
    d = np.zeros(len(p))
    for i in range(1, len(p) - 1):
        if m[i - 1] * m[i] > 0:
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            d[i] = (w0 + w1) / (w0 / m[i - 1] + w1 / m[i])
    for i, (a, b) in {0: (0, 1), len(p) - 1: (-1, -2)}.items():
        e = ((2 * h[a] + h[b]) * m[a] - h[a] * m[b]) / (h[a] + h[b])
        if np.sign(e) != np.sign(m[a]):
            e = 0.0
        elif np.sign(m[a]) != np.sign(m[b]) and abs(e) > 3 * abs(m[a]):
            e = 3 * m[a]
        d[i] = e
    if x > p[-1]:
        return g[-1] + m[-1] * (x - p[-1])
    if x < p[0]:
        return g[0] + m[0] * (x - p[0])
    i = min(np.searchsorted(p, x, side="right") - 1, len(p) - 2)
    t = (x - p[i]) / h[i]
    return (
        (1 + 2 * t) * (1 - t) ** 2 * g[i] + t * (1 - t) ** 2 * h[i] * d[i]
        + t * t * (3 - 2 * t) * g[i + 1] + t * t * (t - 1) * h[i] * d[i + 1]
    )


def test_pchip_with_linear_tails(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        p = np.cumsum(rng.uniform(0.5, 5, 6))
        g = np.cumsum(rng.uniform(-1 if i % 2 else 0, 6, 6))
        rows += [(float(x), p.tolist(), g.tolist()) for x in (*rng.uniform(p[0] - 3, p[-1] + 3, 5), p[2], p[-1], p[0])]
    df = spark.createDataFrame(rows, "x double, p array<double>, g array<double>")
    df = df.withColumn("d", series.pchip_slopes(F.col("p"), F.col("g")))
    y = series.hermite_with_linear_tails(F.col("x"), F.col("p"), F.col("g"), F.col("d"))
    for r in df.withColumn("y", y).collect():
        assert r.y == pytest.approx(pchip(r.x, np.array(r.p), np.array(r.g)), abs=1e-9)


def test_terms_left_out_change_no_sum(spark):
    """The few terms that are felt give the sum of all hundred to the last bit."""
    def total(x, last):
        return F.aggregate(F.sequence(F.lit(1), last), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(x * j * j))

    x = F.col("x")
    rows = [(-(10 ** (i / 100)),) for i in range(-1200, 250)] + [(-0.0,), (-0.0045,), (-0.0046,)]
    few = series.felt_terms(x, 100)
    got = spark.createDataFrame(rows, "x double").select("x", few.alias("n"), total(x, few).alias("few"), total(x, F.lit(100)).alias("full")).collect()
    assert [r.x for r in got if r.few != r.full] == []
    assert {r.n for r in got if -0.001 < r.x} == {100} and max(r.n for r in got if r.x < -0.5) <= 10
