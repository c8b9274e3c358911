"""Ranking candidates against a base article by shared entities and similarity, and picking what goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarrafa.functions.vector import cosine
from tarrafa.models import continuity
from tarrafa.operators.entities import overlap_with


def ranked(candidates: DataFrame, base: DataFrame, least_common: int = 0) -> DataFrame:
    """(url, common, common_count, similarity, continuity) of candidates (url, ents, embedding), best first."""
    shared = overlap_with(candidates.select("url", "ents"), base.select("url", "ents")).where(F.col("common_count") >= least_common)
    one = base.limit(1).select("embedding").scalar()
    scored = shared.join(candidates.select("url", "embedding"), "url").withColumn("_e", one).withColumn("similarity", cosine(F.col("embedding"), F.col("_e")))
    judged = scored.withColumn("continuity", continuity(F.col("similarity"), F.col("common_count")))
    return judged.select("url", "common", "common_count", "similarity", "continuity").orderBy(F.desc("common_count"), F.desc_nulls_last("similarity"), "url")


def continued(ranking: DataFrame, dates: DataFrame) -> DataFrame:
    """What goes on from the base article, by date (url, date_published)."""
    return ranking.where(F.col("continuity") == "Sim").select("url").join(dates, "url").orderBy(F.asc_nulls_last("date_published"), "url")
