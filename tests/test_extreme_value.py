import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainspark.grid import DURATIONS_MIN, RETURN_PERIODS
from rainspark.operators import disaggregation, gumbel, mapping, serving, sherman
from rainspark.plans import idf_fit


def test_statistics_need_five_years(spark):
    rows = [("a", y, 10.0 * y) for y in range(1, 6)] + [("b", y, 10.0 * y) for y in range(1, 5)] + [("flat", y, 3.0) for y in range(6)]
    df = spark.createDataFrame(rows, "k string, year int, mm double").unionByName(spark.createDataFrame([("b", 9, None)], "k string, year int, mm double"))
    got = {r.k: r for r in gumbel.gumbel_ks(df, ["k"]).collect()}
    a = got["a"]
    assert (a.AMD_mean, a.Nyears) == (30.0, 5) and a.AMD_std == pytest.approx(math.sqrt(250))
    beta = a.AMD_std * math.sqrt(6) / math.pi
    mu = a.AMD_mean - 0.5772156649015329 * beta
    gaps = [abs((i - 0.5) / 5 - math.exp(-math.exp(-(10.0 * i - mu) / beta))) for i in range(1, 6)]
    assert a.KS_D == pytest.approx(max(gaps)) and 0 <= a.KS_p <= 1
    assert (got["b"].AMD_mean, got["b"].Nyears, got["b"].KS_p, got["b"].KS_reject) == (None, 4, None, 0)
    assert got["flat"].KS_D is None
    stats = gumbel.cell_stats(df, ["k"])
    assert {r.k: r.Nyears for r in stats.collect()} == {"a": 5, "b": 4, "flat": 6}
    q = [r.Q for r in gumbel.gumbel_quantiles(stats, ["k"]).orderBy("T").collect()]
    assert len(q) == len(RETURN_PERIODS) and q == sorted(q)


def dense_search(ratio):
    """Best log-space fit of one vector by a fine scan over b."""
    d = np.array(DURATIONS_MIN, float)
    z = np.log10(np.array(ratio) / (d / 60))
    best = (np.inf,)
    for b in np.r_[0, np.geomspace(0.01, 7200, 60000)]:
        x = np.log10(b + d)
        c = np.clip(-np.cov(x, z, bias=True)[0, 1] / x.var(), sherman.EPS, sherman.C_MAX)
        sse = np.sum((z - z.mean() + c * (x - x.mean())) ** 2)
        best = min(best, (sse, b, c))
    return best


def test_duration_fit_against_a_dense_search(spark):
    fixed = disaggregation.cetesb_ratios()
    curve = [min(1.0, (d / 1440) * ((20.0 + 1440) / (20.0 + d)) ** 0.8) for d in DURATIONS_MIN]
    steep = [1.0] * 12
    df = spark.createDataFrame([(0, fixed), (1, curve), (2, steep), (3, [None] * 10 + [0.5, 1.0]), (4, [0.3, None] + fixed[2:])], "id int, ratio array<double>")
    got = {r.id: r.dur for r in sherman.fit_durations(df).collect()}
    assert (got[0].b, got[0].c) == (pytest.approx(11.96, abs=0.01), pytest.approx(0.7587, abs=1e-4))
    assert (got[1].b, got[1].c) == (pytest.approx(20.0, rel=1e-3), pytest.approx(0.8, rel=1e-4))
    for i, v in ((0, fixed), (1, curve), (2, steep)):
        sse, b, c = dense_search(v)
        assert got[i].b == pytest.approx(b, rel=2e-3, abs=2e-3) and got[i].c == pytest.approx(c, rel=1e-3)
    assert got[3] is None and got[4].n == 11
    literal = spark.range(1).select(sherman.fitted_constant(fixed).alias("d")).first().d
    assert literal.asDict() == pytest.approx(got[0].asDict())


def test_separated_fit_equals_joint_least_squares(spark):
    mean, std = 90.0, 25.0
    stats = spark.createDataFrame([(mean, std), (60.0, 30.0), (50.0, 0.0), (None, 3.0), (1.0, 40.0)], "AMD_mean double, AMD_std double")
    rows = sherman.fit_sherman(stats.withColumn("dur", sherman.fitted_constant(disaggregation.cetesb_ratios()))).collect()
    first = next(r for r in rows if r.AMD_mean == mean)
    d, t = np.array(DURATIONS_MIN, float), np.array(RETURN_PERIODS, float)
    q = mean + std * (-np.log(np.log(t / (t - 1))) / 1.282 - 0.450047)
    i = q[:, None] * (np.array(disaggregation.cetesb_ratios()) / (d / 60))
    tt, dd = np.meshgrid(t, d, indexing="ij")
    a = np.c_[np.ones(84), np.log10(tt).ravel(), -np.log10(first.b + dd).ravel()]
    beta = np.linalg.lstsq(a, np.log10(i).ravel(), rcond=None)[0]
    assert (first.K, first.a, first.c) == (pytest.approx(10 ** beta[0]), pytest.approx(beta[1]), pytest.approx(beta[2]))
    fitted = first.K * tt ** first.a / (first.b + dd) ** first.c
    assert first.MSE == pytest.approx(np.mean((i - fitted) ** 2)) and first.RMSE == pytest.approx(first.MSE ** 0.5)
    assert first.R2 == pytest.approx(1 - np.sum((i - fitted) ** 2) / np.sum((i - i.mean()) ** 2))
    assert (first.K, first.a, first.b, first.c) == (pytest.approx(854, abs=1), pytest.approx(0.1663, abs=1e-4), pytest.approx(11.96, abs=0.01), pytest.approx(0.7587, abs=1e-4))
    # no spread, no mean, or a quantile that is not positive
    assert [r.K for r in rows if r.AMD_mean in (50.0, None, 1.0)] == [None] * 3


def test_station_ratios_rules(spark):
    cols = list(disaggregation.STATION_COLUMNS)
    base = disaggregation.cetesb_ratios()
    rows = [("ok", "OK-fit", *base), ("bad", "failed", *base), ("gap", "ok", *[None, *base[1:]]), ("neg", "fit ok", *[-0.1, *base[1:]]), ("dip", "ok", *[*base[:4], 0.01, *base[5:]])]
    df = spark.createDataFrame(rows, "code string, note string, " + ", ".join(f"{c} double" for c in cols))
    got = {r.code: r.ratio for r in disaggregation.usable_stations(df).collect()}
    assert set(got) == {"ok", "neg", "dip"}
    assert got["ok"] == base and got["neg"] == [None, *base[1:]] and got["dip"][4] == base[3]


def test_outside_the_domain_all_bands_are_null(spark):
    cells = [("p", "RAW", "X", 0, c, *[float(c + 1)] * 7, 0.1, 0.5, 0, mean, 1.0, 9) for c, mean in ((0, 10.0), (1, None), (2, 20.0))]
    names = ["product", "bias", "disagg", "row", "col", "K", "a", "b", "c", "R2", "RMSE", "MSE", "KS_D", "KS_p", "KS_reject", "AMD_mean", "AMD_std", "Nyears"]
    df = spark.createDataFrame(pd.DataFrame(cells, columns=names).astype({"AMD_mean": float})).withColumn("AMD_mean", F.nanvl("AMD_mean", F.lit(None)))
    holed = df.withColumn("K", F.when(F.col("col") != 2, F.col("K")))
    got = {r.col: r for r in idf_fit.fill_failed(holed).collect()}
    assert got[0].K == 1.0 and got[0].src_dist == 0.0
    assert all(got[1][b] is None for b in idf_fit.FITTED)
    assert (got[2].K, got[2].b, got[2].src_col, got[2].AMD_mean) == (1.0, 1.0, 0, 20.0)


def test_intensities_fall_with_duration_and_grow_with_period(spark):
    params = spark.createDataFrame([(1, 854.0, 0.166, 11.96, 0.7587), (2, None, 0.1, 1.0, 0.7)], "id int, K double, a double, b double, c double")
    rows = serving.idf_curve(params, ["id"]).orderBy("duration_min").collect()
    assert {r.id for r in rows} == {1} and len(rows) == 9
    for x, y in zip(rows, rows[1:]):
        assert y.rp_2 < x.rp_2
    assert all(r.rp_2 < r.rp_10 < r.rp_100 for r in rows)
    assert serving.idf_rows(params, ["id"]).count() == 54
    assert rows[0].rp_10 == pytest.approx(854 * 10 ** 0.166 / (11.96 + 5) ** 0.7587)


def ecdf(xs, v):
    xs = np.sort(xs)
    if v <= xs[0] or v >= xs[-1]:
        return float(v >= xs[-1]) if xs[0] < v or xs[0] == xs[-1] and v > xs[0] else 0.0
    i = np.searchsorted(xs, v, side="right") - 1
    return (i + (v - xs[i]) / (xs[i + 1] - xs[i])) / (len(xs) - 1)


def test_ecdf_position_against_a_loop(spark):
    rng = np.random.default_rng(8)
    sample = {"a": np.round(rng.uniform(0, 20, 200), 0), "b": rng.uniform(0, 5, 30)}
    s = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, vs in sample.items() for v in vs], columns=["code", "v"]))
    queries = [(k, float(v), i) for k in sample for i, v in enumerate(np.r_[rng.uniform(-1, 22, 60), 3.0, 7.0, 7.0, sample[k].min(), sample[k].max()])]
    q = spark.createDataFrame(queries + [("c", 1.0, 0)], "code string, v double, i int")
    rows = mapping.ecdf_position(s, q).collect()
    assert len(rows) == len(queries) + 1
    for r in rows:
        assert r.u is None if r.code == "c" else r.u == pytest.approx(ecdf(sample[r.code], r.v))


def test_annual_maxima_are_placed_as_any_value(spark):
    rng = np.random.default_rng(3)
    days = pd.DataFrame({"code": rng.choice(["a", "b"], 900), "date": rng.choice(pd.date_range("2000-01-01", "2006-12-31"), 900), "pr_p": np.round(rng.uniform(0, 30, 900)), "pr_g": 1.0})
    days.loc[len(days)] = ["c", pd.Timestamp("2001-05-05"), np.nan, 2.0]
    df = spark.createDataFrame(days).withColumn("date", F.to_date("date")).withColumn("pr_p", F.nanvl("pr_p", F.lit(None)))
    rows = mapping.placed_annual_max(df).collect()
    assert len(rows) == 15
    for r in rows:
        if r.code == "c":
            assert (r.prod_ams, r.u, r.gauge_ams) == (None, None, 2.0)
        else:
            assert r.u == pytest.approx(ecdf(days[days.code == r.code].pr_p.to_numpy(), r.prod_ams))


def test_flow_duration_ranks(spark):
    df = spark.createDataFrame([("s", f"2000-01-0{i}", q) for i, q in enumerate((5.0, 9.0, 5.0, None), 1)], "code string, date string, q double")
    got = [(r.date[-1], r.rank, r.exceedance) for r in mapping.flow_duration(df).orderBy("rank").collect()]
    assert got == [("2", 1, 0.25), ("1", 2, 0.5), ("3", 3, 0.75)]
