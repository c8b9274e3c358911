"""First and last row per key, in an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row of each key that comes first; null keys are one key. Aggregates map-side, so hot keys are cheap.

    Rows that tie in ``order`` are told apart by all their columns, so the result is always the same.
    """
    return _extreme(df, keys, order, F.min)


def last_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    return _extreme(df, keys, order, F.max)


def _extreme(df: DataFrame, keys: list[str], order, pick) -> DataFrame:
    # The row itself is the end of what is compared, so it travels once.
    place = F.struct(*[(df[o] if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[df[c] for c in df.columns]).alias("row"))
    return df.groupBy(*keys).agg(pick(place).alias("_place")).select("_place.row.*")
