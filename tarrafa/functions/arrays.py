"""Set operations over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersect_all(lists: Column) -> Column:
    """What all lists of an array of arrays share, each once; an empty array for none or for an empty list."""
    first = F.coalesce(F.get(lists, F.lit(0)), F.array().cast("array<string>"))
    return F.aggregate(lists, F.array_distinct(first), lambda acc, x: F.array_intersect(acc, F.coalesce(x, F.array().cast("array<string>"))))


def common_count(a: Column, b: Column) -> Column:
    """How many different values two arrays share; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.size(F.array_intersect(F.coalesce(a, empty), F.coalesce(b, empty)))
