"""Date functions: sitemap sort keys, lenient dates, ISO weeks, address templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sitemap_sort_key(loc: Column, lastmod: Column) -> Column:
    """struct(at, seq): the lastmod as an instant and 0, else date and number of the file name, else the epoch.

    A lastmod without an offset is read as UTC (the session's zone must be UTC).
    """
    # Casts don't read an offset after minutes, and take a clock time alone for one of today.
    whole = F.regexp_replace(F.regexp_replace(lastmod, r"[zZ]$", "+00:00"), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=[+-])", "$1:00")
    at = F.when(lastmod.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}(?!\d)"), F.try_to_timestamp(whole))
    g = lambda i: F.regexp_extract(loc, r"/(\d{4})/(\d{2})/(\d{2})_(\d+)\.xml$", i)
    named = F.try_to_timestamp(F.concat_ws("-", F.nullif(g(1), F.lit("")), F.nullif(g(2), F.lit("")), F.nullif(g(3), F.lit(""))), F.lit("yyyy-MM-dd"))
    epoch = F.timestamp_seconds(F.lit(0))
    return F.struct(F.coalesce(at, named, epoch).alias("at"), F.when(at.isNull() & named.isNotNull(), g(4).try_cast("int")).otherwise(0).alias("seq"))


def lenient_date(value: Column) -> Column:
    """The calendar date a text starts with in ISO form; null for anything else."""
    return F.regexp_extract(value, r"^\s*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def strict_date(value: Column) -> Column:
    """A date in ISO form; raises an error for anything else, null for null."""
    return F.when(value.isNotNull(), F.to_date(value, "yyyy-MM-dd"))


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d)


def iso_week(d: Column) -> Column:
    return F.weekofyear(d)


def coded_date(value: Column) -> Column:
    """A date coded as the integer yyyymmdd; null where it isn't one."""
    return F.try_to_timestamp(value.cast("string"), F.lit("yyyyMMdd")).cast("date")


def day_marker(url: Column, day: Column) -> Column:
    """Whether an address names a day as ``/yyyy/mm/dd_``."""
    return F.contains(url, F.date_format(day, "/yyyy/MM/dd_"))


def index_candidates(root: str, day: Column, explicit: str | None = None) -> Column:
    """Addresses at which a sitemap index may lie, in the order of trying."""
    month = F.date_format(day, "yyyy/MM")
    found = [F.concat(F.lit(root), F.lit("/sitemap.xml")), F.concat(F.lit(root), F.lit("/index.xml")), F.concat(F.lit(root + "/"), month, F.lit("/index.xml")), F.concat(F.lit(root + "/"), month, F.lit("/sitemap.xml"))]
    return F.array(*([F.lit(explicit)] if explicit else []), *found)
