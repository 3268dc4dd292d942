import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainspark.operators import neighbours
from rainspark.operators.neighbours import nearest_k


def brute(q, p, k):
    """Nearest by (d2, code) for every query, one at a time."""
    out = {}
    for i, x, y, g in q[["id", "x", "y", "g"]].itertuples(index=False):
        own = p[p.g == g]
        d2 = (x - own.x) ** 2 + (y - own.y) ** 2
        out[i] = sorted(zip(d2, own.code))[:k]
    return out


def crowd(rng, n, g):
    """Even places, a third in one tiny spot, a third at one single place."""
    x = np.r_[rng.uniform(0, 40, n), rng.normal(11, 1e-3, n), np.full(n, 20.0)]
    y = np.r_[rng.uniform(0, 40, n), rng.normal(7, 1e-3, n), np.full(n, 20.0)]
    return pd.DataFrame({"x": x, "y": y, "code": [f"{g}{i:05d}" for i in rng.permutation(3 * n)], "g": g})


@pytest.mark.parametrize("k", [1, 8])
def test_equals_brute_force_on_skewed_groups(spark, k):
    rng = np.random.default_rng(k)
    p = pd.concat([crowd(rng, 150, "a"), crowd(rng, 5, "b")])
    n = 400
    q = pd.DataFrame({"id": range(n), "x": rng.uniform(-9, 49, n), "y": rng.uniform(-9, 49, n), "g": rng.choice(["a", "b", "none"], n)})
    q.loc[:120, ["x", "y"]] = rng.normal([11, 7], 2e-3, (121, 2))     # a third of the queries too
    q.loc[121:130, ["x", "y"]] = [20.0, 20.0]
    got = nearest_k(spark.createDataFrame(q), spark.createDataFrame(p), k, tie=["code"], group=["g"])
    want = brute(q, p, k)
    rows = got.collect()
    assert len(rows) == n
    for r in rows:
        assert [(m.d2, m.code) for m in r.neighbours] == want[r.id]


def test_grid_ties_go_to_the_lower_row_and_column(spark):
    good = spark.createDataFrame([(r, c) for r in range(20) for c in range(20) if (r, c) != (10, 10)], "row int, col int")
    bad = spark.createDataFrame([(10, 10)], "row int, col int")
    n = nearest_k(bad, good, 1, tie=["row", "col"], x="col", y="row").first().neighbours[0]
    assert (n.row, n.col, n.d2) == (9, 10, 1.0)


def test_no_points_and_missing_places(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "id int, x double, y double")
    none = spark.createDataFrame([], "x double, y double, code string")
    assert [r.neighbours for r in nearest_k(q, none, 3, tie=["code"]).collect()] == [[], []]
    one = spark.createDataFrame([(1.0, 1.0, "a"), (None, 1.0, "b")], "x double, y double, code string")
    got = {r.id: [m.code for m in r.neighbours] for r in nearest_k(q, one, 3, tie=["code"]).collect()}
    assert got == {1: ["a"], 2: []}


def test_no_cross_join_in_the_plan(spark):
    rng = np.random.default_rng(0)
    p = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(0, 9, 500), "y": rng.uniform(0, 9, 500), "code": range(500)}))
    plan = nearest_k(p.withColumnRenamed("code", "id"), p, 2, tie=["code"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert neighbours.LEAF < 500


def test_crowd_far_smaller_than_the_frame(spark):
    """All places but one lie within a millionth of a millionth of the frame."""
    rng = np.random.default_rng(9)
    x, y = 500 + rng.integers(0, 60, 700) * 1e-9, 500 + rng.integers(0, 60, 700) * 1e-9
    p = pd.DataFrame({"x": [*x, 1000.0], "y": [*y, 0.0], "code": [f"{i:04d}" for i in range(701)], "g": "a"})
    q = pd.DataFrame({"id": range(300), "x": [*x[:200], *rng.uniform(0, 1000, 100)], "y": [*y[:200], *rng.uniform(0, 1000, 100)], "g": "a"})
    rows = nearest_k(spark.createDataFrame(q), spark.createDataFrame(p), 3, tie=["code"], group=["g"]).collect()
    want = brute(q, p, 3)
    assert len(rows) == len(q) and all([(m.d2, m.code) for m in r.neighbours] == want[r.id] for r in rows)


def test_query_rows_move_once(spark):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(0, 9, 500), "y": rng.uniform(0, 9, 500), "code": range(500)}))
    q = p.withColumnRenamed("code", "id").selectExpr("*", "repeat('payload', 20) AS payload")
    plan = nearest_k(q, p, 2, tie=["code"])._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange RoundRobin" in line]
    assert len(moved) == 2 and sum("_share" in line for line in moved) == 2  # the rows, and the candidates


def test_queries_of_one_place_are_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARE", 10)
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"x": rng.uniform(0, 9, 200), "y": rng.uniform(0, 9, 200), "code": [f"{i:03d}" for i in range(200)], "g": "a"})
    q = pd.DataFrame({"id": range(600), "x": [4.5] * 500 + list(rng.uniform(0, 9, 100)), "y": [4.5] * 500 + list(rng.uniform(0, 9, 100)), "g": "a"})
    found = nearest_k(spark.createDataFrame(q), spark.createDataFrame(p), 2, tie=["code"], group=["g"])
    want = brute(q, p, 2)
    assert all([(m.d2, m.code) for m in r.neighbours] == want[r.id] for r in found.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 300


@pytest.mark.parametrize("k", [1, 5])
def test_queries_far_outside_the_points(spark, k, monkeypatch):
    """A long strip beside the points ranks few candidates per row, and the result is that of all pairs."""
    rng = np.random.default_rng(3)
    place = rng.integers(0, 40 * 40, 4000)
    p = pd.DataFrame({"x": place % 40 + 0.25, "y": place // 40 + 0.5, "code": [f"s{i:05d}" for i in range(4000)], "g": "a"})
    n = 3000
    q = pd.DataFrame({"id": range(n), "x": rng.uniform(0, 40, n), "y": -rng.uniform(0, 3000, n), "g": "a"})
    q.loc[:20, ["x", "y"]] = rng.uniform(-1e9, 1e9, (21, 2))
    q.loc[21:40, ["x", "y"]] = rng.integers(0, 40, (20, 2)) + 0.25
    kept = []
    materialise = neighbours.materialise

    def watched(df, name):
        out = materialise(df, name)
        if name == "near":
            kept.append(out)
        return out

    monkeypatch.setattr(neighbours, "materialise", watched)
    rows = nearest_k(spark.createDataFrame(q), spark.createDataFrame(p), k, tie=["code"]).collect()
    want = brute(q, p, k)
    assert len(rows) == n
    for r in rows:
        assert [(m.d2, m.code) for m in r.neighbours] == want[r.id]
    assert kept[0].agg(F.avg(F.size("_near"))).first()[0] < 400
