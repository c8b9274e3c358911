"""Derived tables over events, articles and chunks: enrichment, counts, projections, integrity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarrafa import dims
from tarrafa.functions.url import host


def enriched_events(events: DataFrame) -> DataFrame:
    """Every event with the labels of its codes; unknown and null codes keep their row, with null labels."""
    spark = events.sparkSession
    out = events
    quads = dims.quad_class(spark).select(F.col("code").alias("_c"), F.col("label").alias("quadclass_label"))
    roots = dims.root_event(spark).select(F.col("code").alias("_c"), F.col("label").alias("eventrootcode_label"))
    out = out.join(F.broadcast(quads), out["quadclass"] == quads["_c"], "left").drop("_c")
    out = out.join(F.broadcast(roots), out["eventrootcode"] == roots["_c"], "left").drop("_c")
    for role in ("actor1geo_type", "actor2geo_type", "actiongeo_type"):
        geo = dims.geo_type(spark).select(F.col("code").alias("_c"), F.col("label").alias(f"{role}_label"))
        out = out.join(F.broadcast(geo), out[role] == geo["_c"], "left").drop("_c")
    return out


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def embedded_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("embedding").alias("count"))


def count_by_date(articles: DataFrame) -> DataFrame:
    return articles.groupBy("date_published").agg(F.count("*").alias("count"))


def chunks_by_article(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(url, count) of every article, 0 where it has no chunks; chunks are counted before the join."""
    per = chunks.groupBy("article").agg(F.count("*").alias("_n"))
    return articles.join(per, articles["url"] == per["article"], "left").select("url", F.coalesce("_n", F.lit(0).cast("long")).alias("count"))


def average_chunks(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks_by_article(articles, chunks).agg(F.avg("count").alias("avg"))


def events_crawled_too(events: DataFrame, articles: DataFrame) -> DataFrame:
    """How many events lead to an address that was crawled as an article."""
    return row_count(events.join(articles.select(F.col("url").alias("sourceurl")), "sourceurl", "left_semi"))


def events_of_host(events: DataFrame, name: str) -> DataFrame:
    return events.where(host(F.col("sourceurl")) == name)


def title_source_date(events: DataFrame) -> DataFrame:
    return events.select("sourceurl", "title", "sqldate")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(value, count): keys of ``child`` that ``parent`` lacks; null keys are no orphans."""
    lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("count"))


def crawl_counters(articles: DataFrame) -> DataFrame:
    """(sitemap_url, urls_seen, ok, failed) of each sitemap's articles."""
    return articles.groupBy("sitemap_url").agg(F.count("*").alias("urls_seen"), F.count_if(F.col("extraction_status") == "ok").alias("ok"), F.count_if(F.col("extraction_status").isNotNull() & (F.col("extraction_status") != "ok")).alias("failed"))


def fetch_counters(events: DataFrame) -> DataFrame:
    """(processed, success, failed) of fetched titles."""
    return events.agg(F.count("title_fetch_status").alias("processed"), F.count_if(F.col("title_fetch_status") == "ok").alias("success"), F.count_if(F.col("title_fetch_status") != "ok").alias("failed"))


def growth(spark, start: int, remote_every: int, local_every: int, seconds: int, step: int = 3600) -> DataFrame:
    """(t, remote, local): the size of both corpora at every step."""
    t = spark.range(0, seconds + 1, step).withColumnRenamed("id", "t")
    return t.select("t", (F.lit(start) + F.floor(F.col("t") / remote_every)).alias("remote"), F.floor(F.col("t") / local_every).alias("local"))
