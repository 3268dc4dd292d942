"""The serving queries over the complete parameter table."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["idf_rows"])
def test_all_modes_are_served(spark, name):
    rows = entry.queries()[f"{name}_all_modes"](spark, entry.SMOKE_DIR).groupBy("disagg").count().collect()
    one = entry.queries()[name](spark, entry.SMOKE_DIR).count()
    assert {r["disagg"] for r in rows} == {"CETESB", "STATION", "RASTER"} and all(r["count"] >= one for r in rows)
