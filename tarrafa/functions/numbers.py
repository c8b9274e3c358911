"""Lenient numbers: what can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def lenient_integer(text: Column, kind: str = "long") -> Column:
    """Whole numbers in any notation (``3``, ``3.0``, ``1e3``); fractions, blanks and words are null.

    Plain digits are read as such, so that ids beyond 2^53 keep every digit.
    """
    x = lenient_double(text)
    return F.coalesce(F.trim(text).try_cast(kind), F.when(x == F.floor(x), x.try_cast(kind)))


def catch_up(rate_slow: int, rate_fast: int, behind: int, spark):
    """(t, remote, local) of the first second at which the fast side has caught up."""
    # remote = behind + t // slow, local = t // fast; the answer lies below this bound.
    bound = int((behind + 2) / (1 / rate_fast - 1 / rate_slow)) + 2 * rate_slow
    t = spark.range(bound).withColumnRenamed("id", "t")
    both = t.select("t", (F.lit(behind) + F.floor(F.col("t") / rate_slow)).alias("remote"), F.floor(F.col("t") / rate_fast).alias("local"))
    return both.where("local >= remote").groupBy().agg(F.min(F.struct("t", "remote", "local")).alias("m")).select("m.*")
