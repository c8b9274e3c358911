"""Counts per ISO week on a dense grid of years and weeks, with quantiles for a colour scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarrafa.functions.dates import iso_week, iso_year


def weekly_counts(df: DataFrame, day: str) -> DataFrame:
    """(iso_year, iso_week, n); rows without a date are left out."""
    dated = df.where(F.col(day).isNotNull())
    return dated.groupBy(iso_year(F.col(day)).cast("int").alias("iso_year"), iso_week(F.col(day)).cast("int").alias("iso_week")).agg(F.count("*").alias("n"))


def weekly_grid(counts: DataFrame) -> DataFrame:
    """(iso_year, iso_week, n, log_n, masked_n): weeks 1 to 53 of each year that occurs, with zeros filled in."""
    years = counts.select("iso_year").distinct()
    grid = years.select("iso_year", F.explode(F.sequence(F.lit(1), F.lit(53))).alias("iso_week"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    full = grid.join(counts, ["iso_year", "iso_week"], "left").select("iso_year", "iso_week", n.alias("n"))
    return full.withColumns({"log_n": F.log10(F.col("n") + 1), "masked_n": F.nullif("n", F.lit(0))})


def grid_quantiles(grid: DataFrame) -> DataFrame:
    """(low, q25, q50, q75, high, ticks) of all cells, cut to whole numbers; zeros for an empty grid."""
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = grid.agg(F.min("n").alias("a"), q.alias("q"), F.max("n").alias("b"))
    at = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    s = s.select(at(F.col("a")).alias("low"), *[at(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], at(F.col("b")).alias("high"))
    return s.withColumn("ticks", F.array_distinct(F.array("low", "q25", "q50", "q75", "high")))
