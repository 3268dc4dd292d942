"""Annual maxima, coverage and counts of station series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from rainspark.sources.daily import crop_period

DAYS_PER_YEAR = 365


def annual_max(daily: DataFrame, keys: Sequence[str] = ("code",), value: str = "pr_g") -> DataFrame:
    """Largest value of each calendar year and the first date it fell on."""
    ranked = F.struct(-F.col(value), F.col("date"))
    return (
        daily.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.year("date").alias("year"))
        .agg(F.max(value).alias("max_mm"), F.min_by("date", ranked).alias("date_of_max"))
    )


def coverage(daily: DataFrame, start: str, end: str, min_years: float) -> DataFrame:
    """Stations with enough valid days in the window: (code, n_days)."""
    return (
        crop_period(daily, start, end)
        .groupBy("code").agg(F.count("pr_g").alias("n_days"))
        .filter(F.col("n_days") >= int(min_years * DAYS_PER_YEAR))
    )


def covered_only(daily: DataFrame, start: str, end: str, min_years: float) -> DataFrame:
    """Cropped series of the stations that pass `coverage`."""
    keep = coverage(daily, start, end, min_years).select("code")
    return crop_period(daily, start, end).join(keep, "code", "left_semi")


def covered_annual_max(
    daily: DataFrame, start: str, end: str, min_years: float, stations: DataFrame | None = None
) -> DataFrame:
    """(code, year, max_mm, date_of_max, n_days): maxima of the stations that pass `coverage`, in the window.

    Maxima and valid days are taken together in one reading of the series; what is summed over a
    station's years are its few station-years. With `stations`, the series of others are dropped
    before anything is counted.
    """
    window = crop_period(daily, start, end)
    if stations is not None:
        window = _of_stations(window, stations)
    ranked = F.when(F.col("pr_g").isNotNull(), F.struct(-F.col("pr_g"), F.col("date")))
    years = window.groupBy("code", F.year("date").alias("year")).agg(
        F.max("pr_g").alias("max_mm"), F.min_by("date", ranked).alias("date_of_max"), F.count("pr_g").alias("n")
    )
    total = F.sum("n").over(W.partitionBy("code"))
    return (
        years.withColumn("n_days", total)
        .filter((F.col("n_days") >= int(min_years * DAYS_PER_YEAR)) & F.col("max_mm").isNotNull()).drop("n")
    )


def _of_stations(daily: DataFrame, stations: DataFrame) -> DataFrame:
    return daily.join(stations.select("code").distinct(), "code", "left_semi")


def first_with_coverage(
    stations: DataFrame, daily: DataFrame, start: str, end: str, min_years: float,
    order: Sequence[str],
) -> DataFrame:
    """The first listed station that qualifies (one row, or none). Only listed stations are counted."""
    good = coverage(_of_stations(daily, stations), start, end, min_years)
    return stations.join(good, "code").orderBy(*order).limit(1)


def annual_max_grid(annual: DataFrame, first: int, last: int) -> DataFrame:
    """(code, year, max_mm) for every year of the list; absent years are NULL.

    One array of at most last-first+1 maxima per station, opened over the fixed year list.
    """
    per_station = annual.groupBy("code").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "max_mm"))).alias("m")
    )
    return per_station.select(
        "code", "m", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    ).select("code", "year", F.try_element_at("m", F.col("year")).alias("max_mm"))


def export_wide_annual(annual: DataFrame, meta: DataFrame, first: int, last: int) -> DataFrame:
    """Metadata and one column per year, for the stations that have maxima."""
    wide = annual.groupBy("code").pivot("year", list(range(first, last + 1))).agg(F.first("max_mm"))
    return meta.join(wide, "code")


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, unknown values together, largest first."""
    label = F.coalesce(F.col(column), F.lit("Unknown")).alias(column)
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
