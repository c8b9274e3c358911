"""Queries of the core, by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarrafa import relational
from tarrafa.operators import timestamps
from tarrafa.session import table

QUERIES, SQL = dict(relational.QUERIES), dict(relational.SQL)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "g1_articles", "url", "first_seen_at", *timestamps.FIELDS)
    return timestamps.normalise_articles(articles, table(spark, sf_dir, "edition_zones"))


def p1_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each edition as its articles alone tell it, beside the given one."""
    articles = table(spark, sf_dir, "g1_articles", "url", "first_seen_at", *timestamps.FIELDS)
    found = timestamps.estimate_zones(timestamps.unzoned_times(timestamps.parsed_fields(articles, timestamps.ALIGNED)), "edition", "local", "seen_micros")
    return found.join(table(spark, sf_dir, "edition_zones").withColumnRenamed("time_zone", "given_zone"), "edition", "left")


QUERIES |= {f.__name__: f for f in (p1_found, p1_zones)}
