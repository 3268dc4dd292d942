"""Plans at scale: what must not be shuffled, collected or multiplied."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import tables
from rainspark import session
from rainspark.operators import bias, calendar, extremes, raster
from rainspark.plans import idf_fit
from rainspark.sources import daily

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_table_needs_no_shuffle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rain LOCATION '{tmp_path}'")
    daily.write_bucketed(tables.gauge_daily(spark, SF_DIR), "rain.gauge", 4)
    stored = spark.table("rain.gauge")
    want = extremes.extremes(tables.gauge_daily(spark, SF_DIR))
    got = extremes.extremes(stored)
    assert "Exchange" not in plan(got) and "Exchange" not in plan(calendar.annual_max(stored))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    spark.sql("DROP TABLE rain.gauge")


def test_threshold_and_declustering_share_one_shuffle(spark):
    stored = session.materialise(tables.gauge_daily(spark, SF_DIR), "gauge")
    text = plan(extremes.extremes(stored))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_filters_and_columns_reach_the_scan(spark):
    stored = session.materialise(tables.gauge_daily(spark, SF_DIR).withColumn("extra", F.lit("x")), "gauge")
    text = plan(calendar.annual_max(daily.year_slice(stored, 1997, 1998)))
    assert "GreaterThanOrEqual(date,1997-01-01)" in text and "extra" not in text


@pytest.mark.parametrize("name", ["event_pairs", "zeta_mean", "apply_bias", "sherman_fit", "gumbel_ks", "place_labels", "tail_mapping"])
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["grid_annual_max", "mean_annual_total", "cell_stats", "gumbel_quantiles"])
def test_lines_of_a_cell_move_once(spark, name):
    """Also before they are multiplied by products and bias options, in tasks that are not merged by their bytes."""
    text = plan(entry.queries()[name](spark, SF_DIR))
    moves = re.findall(r"Exchange hashpartitioning.*", text)
    assert len(moves) == 1 and "REPARTITION_BY_NUM" in moves[0]


class FakeSession:
    """Settings and master of a session, nothing else."""

    def __init__(self, settings: dict, master: str):
        self.conf, self.sparkContext = self, self
        self.settings, self.master = settings, master

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_regrid_computes_its_corners_once_per_target(spark):
    """No filter on the list of corners is pushed down to the rows that the targets come from."""
    coarse = raster.cell_centres(tables.fine_amax(spark, SF_DIR), tables.FINE)
    targets = coarse.select(tables.TARGET.row_of(F.col("lat")).alias("row"), tables.TARGET.col_of(F.col("lon")).alias("col")).distinct()
    text = plan(raster.regrid(tables.zeta_cells(spark, SF_DIR), tables.FINE, targets, tables.TARGET, "zeta", ["product"]))
    assert "Generate" in text and "lambdafunction" not in text and "size(" not in text


def test_fixed_ratios_are_sent_to_the_quantiles(spark):
    """Two rows of ratios go to the cells; as a join on their key two tasks would do all the work."""
    text = plan(entry.QUERIES["design_intensities"](spark, SF_DIR))
    assert "BuildRight" in text and "BuildLeft" not in text and "SortMergeJoin" not in text


def test_dates_of_a_wide_table_are_read_once(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("code,1/1/2000,note,1/2/2000,1/3/2000\na,1,x,2,3\nb,4\nc,5,y,,6,7,8\n")
    back = daily.read_wide_daily(spark, str(tmp_path / "wide.csv"), ["code"])
    assert "lambdafunction" not in plan(back) and "to_date" not in plan(back)
    got = [(r.code, r.date.day, r.pr_g) for r in back.orderBy("code", "date").collect()]
    assert got == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 4.0), ("b", 2, None), ("b", 3, None), ("c", 1, 5.0), ("c", 2, None), ("c", 3, 6.0)]


def test_shared_folder_is_the_clusters():
    named = FakeSession({"spark.checkpoint.dir": "hdfs://x/shared/"}, "yarn")
    assert session.shared_folder(named) == "hdfs://x/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(FakeSession({}, "yarn"))
    assert session.shared_folder(FakeSession({}, "local[8]")).split("/")[-1].startswith("rainspark-")


def test_one_station_with_most_pairs(spark):
    """A station with two thirds of all pairs has the same factor as anywhere else."""
    pairs = spark.range(30000).select(
        F.lit("P").alias("product"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 300).cast("string"))).alias("station_id"),
        (F.col("id") % 7 + 10.0).alias("pr_p"), ((F.col("id") % 7 + 10.0) * (1.0 + (F.col("id") % 5) / 10.0)).alias("pr_g"),
    ).withColumn("ratio", F.col("pr_g") / F.col("pr_p"))
    got = {r.station_id: r for r in bias.zeta(pairs).collect()}
    rows = [r for r in pairs.filter("station_id = 'hot'").collect()]
    assert got["hot"].n_pairs == len(rows) == 20000
    assert got["hot"].zeta == pytest.approx(sum(r.ratio for r in rows) / len(rows))
    assert bias.zeta(pairs, min_samples=20001).count() == 0
    with pytest.raises(ValueError, match="unknown zeta method"):
        bias.zeta(pairs, "mode")


def test_sums_over_periods_are_taken_before_the_modes(spark):
    """The rows of a cell take its logarithms and powers once, before they are joined with the vectors of the modes."""
    fits = session.materialise(idf_fit.duration_fits(tables.fine_cells(spark, SF_DIR)), "fits")
    fitted = idf_fit.fit_parameters(tables.corrected_amax(spark, SF_DIR), fits)
    text = fitted._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join") < min(m.start() for m in re.finditer("LOG10", text))
