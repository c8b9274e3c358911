"""Entities of articles: get-or-create with stable ids, links per mention, overlap with a base article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarrafa.functions.arrays import common_count
from tarrafa.operators.interleave import numbered


def missing_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The distinct (text, type) pairs of mentions that have no entity yet."""
    return mentions.where("text is not null and type is not null").select("text", "type").distinct().join(entities, ["text", "type"], "left_anti")


def get_or_create(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """All entities, old ones as they are and new ones numbered on from the largest id in the order of (text, type)."""
    new = numbered(missing_entities(mentions, entities), ["text", "type"], "_n")
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")).scalar()
    return entities.select("id", "text", "type").unionByName(new.select((top + F.col("_n")).alias("id"), "text", "type"))


def link_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(g1_article_url, g1_entities_id): one row per mention, repeats kept."""
    return mentions.join(entities, ["text", "type"]).select(F.col("url").alias("g1_article_url"), F.col("id").alias("g1_entities_id"))


def entities_of(article_url: str, links: DataFrame, entities: DataFrame) -> DataFrame:
    mine = links.where(F.col("g1_article_url") == article_url).select(F.col("g1_entities_id").alias("id"))
    return mine.join(entities, "id").select("id", "text", "type")


def entity_lists(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(url, ents): each article's distinct entity texts, sorted. Pairs are made distinct before they are gathered."""
    pairs = links.select("g1_article_url", F.col("g1_entities_id").alias("id")).distinct().join(entities.select("id", "text"), "id")
    return pairs.groupBy(F.col("g1_article_url").alias("url")).agg(F.array_sort(F.collect_set("text")).alias("ents"))


def overlap_with(lists: DataFrame, base: DataFrame) -> DataFrame:
    """(url, common, common_count) of every article against one base row (url, ents); the base is a single row."""
    # The base row is a scalar subquery: the other rows meet no join.
    one = base.limit(1).select(F.struct(F.col("url").alias("u"), F.col("ents").alias("e"))).scalar()
    both = lists.withColumn("_one", one).select("url", "ents", F.col("_one.u").alias("_base"), F.col("_one.e").alias("_ents")).where("url <> _base")
    return both.select("url", F.array_sort(F.array_intersect("ents", "_ents")).alias("common"), common_count(F.col("ents"), F.col("_ents")).alias("common_count"))
