"""Coverage and maxima in one reading against the two separate steps."""

import datetime as dt
import random

from rainspark.operators import calendar


def series(spark):
    rng = random.Random(3)
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
    rows = [(f"s{c}", day(k), rng.choice([None, float(rng.randint(0, 50))])) for c in range(8) for k in rng.sample(range(1500), 120 * c)]
    rows += [("s9", day(k), None) for k in range(900)]
    return spark.createDataFrame(rows, "code string, date date, pr_g double")


def test_equals_coverage_then_maxima(spark):
    daily = series(spark)
    window = "2000-03-01", "2003-10-31", 0.7
    want = {tuple(r) for r in calendar.annual_max(calendar.covered_only(daily, *window)).collect()}
    days = {r.code: r.n_days for r in calendar.coverage(daily, *window).collect()}
    got = calendar.covered_annual_max(daily, *window).collect()
    assert 0 < len({r.code for r in got}) < 8
    assert {(r.code, r.year, r.max_mm, r.date_of_max) for r in got} == want
    assert all(r.n_days == days[r.code] for r in got)


def test_only_listed_stations_are_read_on(spark):
    daily = series(spark)
    listed = spark.createDataFrame([("s7", 2), ("s6", 1), ("s6", 3), ("s1", 0)], "code string, place int")
    got = calendar.covered_annual_max(daily, "2000-01-01", "2004-12-31", 0.7, listed)
    assert {r.code for r in got.collect()} == {"s6", "s7"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [code") < plan.index("LeftSemi")  # the join lies below the aggregate
    first = calendar.first_with_coverage(listed, daily, "2000-01-01", "2004-12-31", 0.7, ["place"]).collect()
    assert [(r.code, r.place) for r in first] == [("s6", 1)]


def test_no_rows(spark):
    assert calendar.covered_annual_max(series(spark).limit(0), "2000-01-01", "2001-12-31", 0.5).count() == 0
