"""Fits, box-plot statistics, densities and class counts of gauge/product pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rainspark.functions.numeric import cap
from rainspark.operators.bias import plot_qc
from rainspark.operators.quantiles import exact_quantiles, quantile_columns
from rainspark.sources.inventory import first_row_per

BOX = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
ZETA_RANGE = (0.5, 3.5)


def origin_fit(pairs: DataFrame, groups: Sequence[str], x: str = "pr_g", y: str = "pr_p") -> DataFrame:
    """(groups, n, slope, r2): line through the origin and its uncentred R2, from three sums."""
    sums = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum(F.col(x) * F.col(y)).alias("sxy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"),
    )
    sxx = F.nullif(F.col("sxx"), F.lit(0.0))
    return sums.select(
        *groups, "n", (F.col("sxy") / sxx).alias("slope"),
        (F.col("sxy") * F.col("sxy") / (sxx * F.nullif(F.col("syy"), F.lit(0.0)))).alias("r2"),
    )


def exponential_fit(
    rows: DataFrame, groups: Sequence[str], x_m: str = "elev_m", y: str = "zeta",
    clip: tuple[float, float] | None = ZETA_RANGE,
) -> DataFrame:
    """(groups, n, a, b, r2) of y = a exp(b * km), fitted on ln y; R2 on y itself.

    Groups with fewer than three rows get NULL. The second pass, for R2, joins two numbers per
    group; the sums of both passes are combined before they are shuffled.
    """
    value = F.col(y) if clip is None else cap(F.col(y), *clip)
    pts = rows.select(
        *groups, (F.col(x_m) / 1000.0).alias("h"), value.alias("z")
    ).filter(F.col("h").isNotNull() & (F.col("z") > 0))
    line = pts.groupBy(*groups).agg(
        F.count("*").alias("n"), F.regr_slope(F.log("z"), F.col("h")).alias("b"),
        F.regr_intercept(F.log("z"), F.col("h")).alias("ln_a"), F.avg("z").alias("mean_z"),
    ).withColumn("a", F.exp("ln_a"))
    gap = F.col("z") - F.col("a") * F.exp(F.col("b") * F.col("h"))
    dev = F.col("z") - F.col("mean_z")
    quality = pts.join(line, list(groups)).groupBy(*groups).agg(
        F.sum(gap * gap).alias("res"), F.sum(dev * dev).alias("tot")
    )
    enough = F.col("n") >= 3
    return line.join(quality, list(groups), "left").select(
        *groups, "n", F.when(enough, F.col("a")).alias("a"), F.when(enough, F.col("b")).alias("b"),
        F.when(enough, F.lit(1.0) - F.col("res") / F.nullif(F.col("tot"), F.lit(0.0))).alias("r2"),
    )


def fill_coordinates(pairs: DataFrame, order: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Rows without lat/lon take those of the station's first row, by `order`, that has them."""
    known = first_row_per(
        pairs.dropna(subset=["station_id", "lat", "lon"]), ["station_id"], order
    ).select("station_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return (
        pairs.join(known, "station_id", "left")
        .withColumn("lat", F.coalesce("lat", "_lat")).withColumn("lon", F.coalesce("lon", "_lon"))
        .drop("_lat", "_lon")
    )


def _stages(rows: DataFrame, keep: Sequence[str], raw: Column, cor: Column) -> DataFrame:
    both = F.array(
        F.struct(F.lit("raw").alias("stage"), raw.alias("bias")),
        F.struct(F.lit("corrected").alias("stage"), cor.alias("bias")),
    )
    return rows.select(*keep, F.explode(both).alias("s")).select(*keep, "s.stage", "s.bias")


def event_bias(pairs_with_zeta: DataFrame, keep: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """(product, stage, bias): P/G and zeta*P/G of each event, outside values dropped."""
    g = F.nullif(F.col("pr_g"), F.lit(0.0))
    staged = _stages(plot_qc(pairs_with_zeta), ["product"], F.col("pr_p") / g, F.col("pr_cor") / g)
    return staged.filter(F.col("bias").between(*keep))


def _station_centres(pairs_with_zeta: DataFrame, centre: str) -> DataFrame:
    """Per product and station: centre of P and of G over its events, and zeta."""
    def of(c: str) -> Column:
        return F.avg(c) if centre == "mean" else F.percentile(c, F.lit(0.5))

    return plot_qc(pairs_with_zeta).groupBy("product", "station_id").agg(
        of("pr_g").alias("g"), of("pr_p").alias("p"), F.first("zeta").alias("zeta")
    )


def station_bias(
    pairs_with_zeta: DataFrame, centre: str = "mean", min_mm: float = 1.0,
    keep: tuple[float, float] = (0.01, 20.0),
) -> DataFrame:
    """(product, station_id, stage, bias) from station means or medians."""
    s = _station_centres(pairs_with_zeta, centre).filter((F.col("g") >= min_mm) & (F.col("p") >= min_mm))
    staged = _stages(
        s, ["product", "station_id"], F.col("p") / F.col("g"), F.col("p") * F.col("zeta") / F.col("g")
    )
    return staged.filter(F.col("bias").between(*keep))


def station_relative_bias(pairs_with_zeta: DataFrame, min_mm: float = 1.0) -> DataFrame:
    """(product, station_id, stage, bias) with bias = (P-G)/G; 0 means unbiased."""
    s = _station_centres(pairs_with_zeta, "mean").filter(F.col("g") >= min_mm)
    return _stages(
        s, ["product", "station_id"], (F.col("p") - F.col("g")) / F.col("g"),
        (F.col("zeta") * F.col("p") - F.col("g")) / F.col("g"),
    )


def box_stats(biases: DataFrame) -> DataFrame:
    """(product, stage, n, p05, q1, median, q3, p95), exact for groups of any size."""
    return quantile_columns(biases, ["product", "stage"], "bias", BOX)


def axis_limits(
    pairs_with_zeta: DataFrame, pcts: Sequence[float], groups: Sequence[str] = (), floor: float = 10.0
) -> DataFrame:
    """(groups, prob, lim): percentiles over gauge, product and corrected values together."""
    stacked = pairs_with_zeta.select(*groups, F.explode(F.array("pr_g", "pr_p", "pr_cor")).alias("v"))
    return exact_quantiles(stacked, groups, "v", pcts).select(
        *groups, "prob", F.greatest("q", F.lit(floor)).alias("lim")
    )


def axis_limit(
    pairs_with_zeta: DataFrame, groups: Sequence[str] = (), pct: float = 0.995, floor: float = 10.0
) -> DataFrame:
    """(groups, lim): one percentile of `axis_limits`."""
    return axis_limits(pairs_with_zeta, [pct], groups, floor).drop("prob")


def _edge_bin(v: Column, low: Column, high: Column, nbins: int) -> Column:
    """Bin whose left edge is the last one not above `v`, clamped into range.

    The quotient can be off by one next to an edge, so it is checked against the edges.
    """
    step = (high - low) / F.lit(float(nbins))
    guess = F.floor((v - low) / F.nullif(step, F.lit(0.0)))
    up = F.when(low + (guess + 1) * step <= v, guess + 1).otherwise(guess)
    exact = F.when(low + up * step > v, up - 1).otherwise(up)
    return F.least(F.greatest(exact, F.lit(0)), F.lit(nbins - 1)).cast("int")


def histogram2d(
    points: DataFrame, x: str, y: str, nbins: int, x_range: tuple[Column, Column],
    y_range: tuple[Column, Column], groups: Sequence[str] = (),
) -> DataFrame:
    """(groups, ix, iy, n) of the points in range; the last bin includes its right edge."""
    inside = F.col(x).between(*x_range) & F.col(y).between(*y_range)
    return (
        points.filter(inside)
        .withColumn("ix", _edge_bin(F.col(x), *x_range, nbins))
        .withColumn("iy", _edge_bin(F.col(y), *y_range, nbins))
        .groupBy(*groups, "ix", "iy").agg(F.count("*").alias("n"))
    )


def density_of_points(
    points: DataFrame, x: str, y: str, nbins: int, x_range: tuple[Column, Column],
    y_range: tuple[Column, Column], groups: Sequence[str] = (),
) -> DataFrame:
    """Each point with the count of its bin; points outside look at the nearest edge bin.

    The bin table has at most nbins^2 rows per group.
    """
    counts = histogram2d(points, x, y, nbins, x_range, y_range, groups).withColumnRenamed("n", "density")
    placed = (
        points.withColumn("ix", _edge_bin(F.col(x), *x_range, nbins))
        .withColumn("iy", _edge_bin(F.col(y), *y_range, nbins))
    )
    return placed.join(counts, [*groups, "ix", "iy"], "left").withColumn(
        "density", F.coalesce("density", F.lit(0))
    )


def density_ranges(
    points: DataFrame, x: str, y: str, groups: Sequence[str] = (), top: float = 0.995
) -> DataFrame:
    """(groups, x_lo, x_hi, y_lo, y_hi): from the minimum to a high percentile, padded by 2 %.

    Both columns share one run of the quantiles.
    """
    named = F.array(*[F.struct(F.lit(n).alias("axis"), F.col(c).cast("double").alias("v")) for c, n in ((x, "x"), (y, "y"))])
    stacked = points.select(*groups, F.explode(named).alias("s")).select(*groups, "s.axis", "s.v")
    q = quantile_columns(stacked, [*groups, "axis"], "v", {"lo": 0.0, "hi": top})
    pad = F.lit(0.02) * (F.col("hi") - F.col("lo") + F.lit(1e-9))
    ends = {"lo": F.greatest(F.col("lo") - pad, F.lit(0.0)), "hi": F.col("hi") + pad}
    return q.groupBy(*groups).agg(
        *[F.max(F.when(F.col("axis") == n, ends[e])).alias(f"{n}_{e}") for n in ("x", "y") for e in ("lo", "hi")]
    )


def raster_summary(cells: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mean and population standard deviation of the cells that have a value."""
    return cells.groupBy(*groups).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n")
    )


def integer_classes(rows: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, k, n): classes one wide, centred on the integers."""
    k = F.floor(F.col(value) + 0.5).cast("int").alias("k")
    return rows.filter(F.col(value).isNotNull()).groupBy(*groups, k).agg(F.count("*").alias("n"))


def equal_width_classes(
    rows: DataFrame, value: str, low: float, high: float, classes: int, groups: Sequence[str] = ()
) -> DataFrame:
    """(groups, class, n): values are clipped into [low, high] first."""
    clipped = cap(F.col(value), low, high)
    k = _edge_bin(clipped, F.lit(float(low)), F.lit(float(high)), classes).alias("class")
    return rows.filter(F.col(value).isNotNull()).groupBy(*groups, k).agg(F.count("*").alias("n"))
