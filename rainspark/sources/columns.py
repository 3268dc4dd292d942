"""Plan-time choice of columns in files whose headers vary."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Column names met in station, pair and inventory files.
LAT_NAMES = ("lat", "latitude", "y", "lat_g", "y_g", "coord_y", "latitude_dd")
LON_NAMES = ("lon", "longitude", "long", "x", "lng", "lon_g", "x_g", "coord_x", "longitude_dd")
NYD_NAMES = ("nyd", "n_y_d", "n_y", "years_data", "n_years_data")
STATE_NAMES = ("uf", "state", "st", "region")
STATE_PATTERN = r"state|province|region|uf|admin"
PRODUCT_COLUMNS = {
    "xavier_pr_mm": "BR-DWGD", "xavier_mm": "BR-DWGD", "xavier": "BR-DWGD",
    "imerg_mm": "IMERG", "imerg": "IMERG",
    "chirps_mm": "CHIRPS", "chirps": "CHIRPS",
    "persiann_mm": "PERSIANN", "persiann": "PERSIANN",
}
START_PATTERNS = (r"^start", r"^begin", r"first", r"^from", r"^year_start")
END_PATTERNS = (r"^end", r"last", r"^to", r"^year_end")

ROLES = {"lat": LAT_NAMES, "lon": LON_NAMES, "nyd": NYD_NAMES, "state": STATE_NAMES}


def file_headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files of each first line, sorted; one reading finds the first lines of all files.

    Only a file's first block counts, and one task holds it, so `first` is the first line.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    heads = lines.filter("at = 0").groupBy("file").agg(F.first("value").alias("header"))
    found = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return {r["header"]: [unquote(f) for f in r["files"]] for r in found}


def guess_column(df: DataFrame, role: str) -> str | None:
    """Name of the column that plays `role` ('lat', 'lon', 'nyd' or 'state').

    A file may have no state column (None); the other roles must be there.
    """
    by_lower = {c.strip().lower(): c for c in reversed(df.columns)}
    for name in ROLES[role]:
        if name in by_lower:
            return by_lower[name]
    if role == "state":
        for c in df.columns:
            if re.search(STATE_PATTERN, c, re.IGNORECASE):
                return c
        return None
    raise ValueError(f"no {role} column among {df.columns}")


def guess_year(df: DataFrame, role: str) -> Column:
    """Start or end year of the first column that has any: '...year' columns first, then dates.

    One aggregate over the file decides for the whole column; without a column the year is NULL.
    """
    patterns = START_PATTERNS if role == "start" else END_PATTERNS
    hits = [c for c in df.columns if any(re.search(p, c.lower()) for p in patterns)]
    named_year = [c for c in hits if "year" in c.lower()]
    options = [F.col(c).try_cast("double").cast("int") for c in named_year]
    for c in hits:
        text = F.col(c).cast("string")
        options.append(F.coalesce(
            F.year(F.try_to_timestamp(text, F.lit("M/d/yyyy"))), F.year(F.try_to_timestamp(text))
        ))
    if not options:
        return F.lit(None).cast("int")
    counts = df.agg(*[F.count(o).alias(str(i)) for i, o in enumerate(options)]).first()
    return next((o for o, n in zip(options, counts) if n), F.lit(None).cast("int"))


def product_column(df: DataFrame, hint: str | None = None) -> tuple[str, str]:
    """(column, product label) of the product rainfall in a pair table."""
    if hint and hint in df.columns:
        return hint, PRODUCT_COLUMNS.get(hint, hint)
    for name, label in PRODUCT_COLUMNS.items():
        if name in df.columns:
            return name, label
    raise ValueError(f"no product rainfall column among {df.columns}")


def normalise_product_column(df: DataFrame, hint: str | None = None) -> DataFrame:
    """Rename the product rainfall to `pr_p` and label its product."""
    if "pr_p" in df.columns and "product" in df.columns:
        return df
    name, label = product_column(df, hint)
    return df.withColumnRenamed(name, "pr_p").withColumn("product", F.lit(label))


def require_columns(df: DataFrame, names: set[str], what: str) -> DataFrame:
    missing = names - set(df.columns)
    if missing:
        raise ValueError(f"{what} lacks columns {sorted(missing)}; has {df.columns}")
    return df
