"""Annual maxima to the 13-band parameter table of every product, bias option and mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rainspark.grid import PARAMETER_BANDS
from rainspark.operators import disaggregation, gumbel, raster, sherman

KEYS = ["product", "bias", "row", "col"]
COMBO = ["product", "bias", "disagg"]
FITTED = ["K", "a", "b", "c", "R2", "RMSE", "MSE"]


def duration_fits(
    cells: DataFrame, stations: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """(disagg, row, col, dur) for every mode whose input is given.

    `cells`: row, col, lat, lon. Each mode is fitted where its vectors are fewest: the fixed
    vector once, the station vectors before they spread over cells, the raster vectors per cell.
    """
    fixed = sherman.fitted_constant(disaggregation.cetesb_ratios())
    out = cells.select(F.lit("CETESB").alias("disagg"), "row", "col", fixed.alias("dur"))
    if stations is not None:
        usable = sherman.fit_durations(disaggregation.usable_stations(stations))
        near = disaggregation.station_ratios(usable, cells, ["dur"])
        out = out.unionByName(near.select(F.lit("STATION").alias("disagg"), "row", "col", "dur"))
    if vectors is not None:
        filled = sherman.fit_durations(disaggregation.raster_ratios(vectors))
        out = out.unionByName(filled.select(F.lit("RASTER").alias("disagg"), "row", "col", "dur"))
    return out


def fit_parameters(amax: DataFrame, fits: DataFrame) -> DataFrame:
    """(product, bias, disagg, row, col, 13 bands, at_bound), unfilled.

    Statistics, the goodness-of-fit test and the sums over the return periods are taken once per product and bias
    option, whatever the number of modes.
    """
    stats = sherman.period_sums(gumbel.gumbel_ks(amax, KEYS))
    return sherman.fit_sums(stats.join(fits, ["row", "col"])).select(
        *COMBO, "row", "col", *PARAMETER_BANDS, "at_bound"
    )


def fill_failed(params: DataFrame) -> DataFrame:
    """Cells inside the domain (mean > 0) without a fit take that of the nearest fitted cell.

    All fitted bands are NULL outside the domain.
    """
    inside = F.coalesce(F.col("AMD_mean") > 0, F.lit(False))
    fitted = F.col("K").isNotNull() & F.col("R2").isNotNull()
    # cells outside the domain end up empty, so they are not worth a search
    flagged = params.withColumn("_in", inside).withColumn("_ok", inside & fitted)
    filled = raster.fill_nearest(flagged, "_ok", FITTED, COMBO, needed="_in")
    return filled.withColumns({c: F.when(F.col("_in"), F.col(c)) for c in FITTED}).drop("_in", "_ok")


def parameter_table(
    amax: DataFrame, cells: DataFrame, stations: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """The complete job. `amax`: product, bias, row, col, year, mm."""
    return fill_failed(fit_parameters(amax, duration_fits(cells, stations, vectors)))
