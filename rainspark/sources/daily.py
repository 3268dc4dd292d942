"""Daily series: wide files to the long table (code, date, pr_g) and back."""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainspark.functions.numeric import coerce_numeric
from rainspark.sources.columns import file_headers

DATE_HEADER = re.compile(r"^(\d{1,2})/(\d{1,2})/(\d{4})$")


def parse_header(name: str) -> dt.date | None:
    """Date of a 'M/D/YYYY' header, else None."""
    hit = DATE_HEADER.match(name.strip())
    if not hit:
        return None
    try:
        return dt.date(int(hit[3]), int(hit[1]), int(hit[2]))
    except ValueError:
        return None


def date_headers(df: DataFrame) -> dict[str, dt.date]:
    found = {c: d for c in df.columns if (d := parse_header(c)) is not None}
    if not found:
        raise ValueError("no daily columns named M/D/YYYY")
    return found


def file_years(df: DataFrame) -> tuple[int, int]:
    years = [d.year for d in date_headers(df).values()]
    return min(years), max(years)


def clip_years(df: DataFrame, first: int | None, last: int | None) -> tuple[int, int]:
    """The wanted window cut to the file's years; an empty window is an error."""
    lo, hi = file_years(df)
    first, last = max(lo, first or lo), min(hi, last or hi)
    if first > last:
        raise ValueError(f"no overlap with the years {lo}-{hi} of the file")
    return first, last


def wide_to_long(
    df: DataFrame, ids: Sequence[str], first: int | None = None, last: int | None = None
) -> DataFrame:
    """(ids..., date, pr_g) with NULL for blanks; only the wanted years are read."""
    first, last = clip_years(df, first, last)
    wanted = {c: d for c, d in date_headers(df).items() if first <= d.year <= last}
    # arrays instead of unpivot: one generated loop, not one projection per day
    days = F.expr("array(" + ", ".join(f"DATE'{d}'" for d in wanted.values()) + ")")
    values = F.expr("array(" + ", ".join(f"string(`{c}`)" for c in wanted) + ")")
    return df.select(
        *ids, F.explode(F.arrays_zip(days.alias("date"), values.alias("mm"))).alias("v")
    ).select(*ids, F.col("v.date").alias("date"), coerce_numeric(F.col("v.mm")).alias("pr_g"))


def _fields(line: Column) -> Column:
    """Fields of a CSV line, quoted ones still in their quotes."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), 1)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1))


def _unquoted(field: Column) -> Column:
    inner = F.replace(F.substring(field, 2, F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"') & field.endswith('"') & (F.length(field) > 1), inner).otherwise(field)


def read_wide_daily(
    spark: SparkSession, path: str | list[str], ids: Sequence[str], first: int | None = None, last: int | None = None
) -> DataFrame:
    """Wide CSV files as (ids..., date, pr_g), NULL for blanks and for what is no number.

    Lines are split and zipped with the dates of the header, so the plan has no expression per day. Files of one header are one scan; each header is cut to the wanted years, and headers
    without any of them are left out unless none is left. Files are UTF-8, a field holds no line
    break, and lines without text are skipped; fields a short line lacks are NULL.
    """
    out, spans = None, []
    for header, files in sorted(file_headers(spark, path).items()):
        names = next(csv.reader([header.removeprefix("\ufeff")]))
        dates = [parse_header(n) for n in names]
        years = [d.year for d in dates if d is not None]
        if not years:
            raise ValueError("no daily columns named M/D/YYYY")
        if absent := [c for c in ids if c not in names]:
            raise ValueError(f"no column {absent} in the daily file")
        spans += years
        lo, hi = max(min(years), first or min(years)), min(max(years), last or max(years))
        if lo > hi:
            continue
        wanted = ",".join(d.isoformat() if d is not None and lo <= d.year <= hi else "" for d in dates)
        # one literal of all dates, read while the plan is built and not once per line
        days = F.split(F.lit(wanted), ",").try_cast("array<date>")
        lines = spark.read.text(files).filter((F.col("value") != F.lit(header)) & (F.trim("value") != ""))
        rows = lines.select(_fields(F.col("value")).alias("fields"))
        lacking = F.greatest(F.lit(len(dates)) - F.size("fields"), F.lit(0))
        padded = F.concat("fields", F.array_repeat(F.lit(None).cast("string"), lacking))
        long = rows.select(
            *[_unquoted(F.get("fields", F.lit(names.index(c)))).alias(c) for c in ids], F.posexplode(padded).alias("i", "mm")
        ).select(*ids, F.get(days, F.col("i")).alias("date"), coerce_numeric(_unquoted(F.col("mm"))).alias("pr_g")).filter("date IS NOT NULL")
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise ValueError(f"no overlap with the years {min(spans)}-{max(spans)} of the files" if spans else "no daily files")
    return out


def write_wide_daily(
    daily: DataFrame, meta: DataFrame, path: str, start: dt.date, end: dt.date, value: str = "pr_g"
) -> None:
    """CSV files with one line per station of `meta` and one column per day of the period, any number of days.

    A line is put together from the station's own days, with as many commas between two of them as
    days lie between, so the plan has no expression per day and the table is read once. Of several
    values of a station and day the smallest is written.
    """
    if start > end:
        raise ValueError(f"the period ends on {end}, before its start {start}")
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    header = ",".join([_csv_text(c) for c in meta.columns] + [f"{d.month}/{d.day}/{d.year}" for d in days])
    known = crop_period(daily, start.isoformat(), end.isoformat()).filter(F.col(value).isNotNull())
    own = known.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("mm")))).alias("_days"))

    def piece(day: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_days", i - 1)["date"])
        step = F.date_diff(day["date"], F.coalesce(before, F.lit(start)))
        text = F.concat(F.repeat(F.lit(","), step), day["mm"].cast("string"))
        return F.when(before == day["date"], "").otherwise(text)

    after = F.date_diff(F.lit(end), F.coalesce(F.get("_days", F.size("_days") - 1)["date"], F.lit(start)))
    values = F.concat(
        F.coalesce(F.array_join(F.transform("_days", piece), ""), F.lit("")), F.repeat(F.lit(","), after)
    )
    ids = [F.col(f"`{c}`").cast("string") for c in meta.columns]
    ids = [F.when(c.rlike('[",]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in ids]
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in ids], values)
    # one column whose name is the whole header: a separator that no text holds keeps lines as they are
    rows = meta.join(own, "code", "left").select(line.alias(header))
    rows.write.mode("overwrite").option("header", True).option("sep", "\x01").option("quote", "").csv(path)


def _csv_text(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in '",') else name


def write_bucketed(daily: DataFrame, table: str, buckets: int) -> None:
    """Long table bucketed and sorted by station.

    Per-station and per-station-year windows and aggregates over such a table need no shuffle.
    """
    daily.write.mode("overwrite").bucketBy(buckets, "code").sortBy("code", "date").saveAsTable(table)


def crop_period(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive at both ends."""
    return daily.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def year_slice(daily: DataFrame, first: int, last: int) -> DataFrame:
    """Whole years as a date range, which parquet statistics can prune."""
    return crop_period(daily, f"{first}-01-01", f"{last}-12-31")


def export_wide_daily(
    daily: DataFrame, meta: DataFrame, start: dt.date, end: dt.date, value: str = "pr_g"
) -> DataFrame:
    """One row per station of `meta`, one column per day of the period.

    Call it per year to bound the number of columns; the day list is literal, so no pass over
    the data is needed to find it.
    """
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    labels = [f"{d.month}/{d.day}/{d.year}" for d in days]
    wide = (
        crop_period(daily, start.isoformat(), end.isoformat())
        .select("code", F.date_format("date", "M/d/yyyy").alias("ds"), value)
        .groupBy("code").pivot("ds", labels).agg(F.first(value))
    )
    return meta.join(wide, "code", "left")


def date_from_image_index(idx: Column, own: Column | None = None) -> Column:
    """Date in an image name: its last eight digits, else the image's own date."""
    found = F.try_to_date(F.regexp_extract(idx, r"(\d{8})$", 1), "yyyyMMdd")
    return found if own is None else F.coalesce(found, own)


def missing_stations(requested: DataFrame, got: DataFrame) -> DataFrame:
    """Requested codes without any value, distinct and sorted."""
    return (
        requested.select("code").distinct()
        .join(got.select("code"), "code", "left_anti")
        .orderBy("code")
    )
