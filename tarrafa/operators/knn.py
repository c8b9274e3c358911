"""Exact nearest-neighbour search for one query vector, with date filter and paging.

The query is a literal, so a search is one scan, one semi-join and one ``TakeOrderedAndProject``; rows without a
usable vector (null, zero, of another length) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarrafa.functions.vector import cosine, l2


def literal_vector(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def by_cosine(rows: DataFrame, vector: Column, embedding: str, tie: list, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Rows by falling similarity, then by ``tie`` (which should end in a unique column)."""
    ordered = rows.withColumn("similarity", cosine(F.col(embedding), vector)).orderBy(F.desc_nulls_last("similarity"), *tie).offset(offset)
    # Rows without a similarity sort last and are dropped behind the limit: a filter in front of it would have
    # every similarity computed twice.
    return (ordered if limit is None else ordered.limit(limit)).where("similarity is not null")


def by_l2(rows: DataFrame, vector: Column, embedding: str, tie: list, limit: int | None = None) -> DataFrame:
    scored = rows.where(F.size(embedding) == F.size(vector)).withColumn("distance", l2(F.col(embedding), vector)).where("distance is not null")
    ordered = scored.orderBy("distance", *tie)
    return ordered if limit is None else ordered.limit(limit)


def search_chunks(chunks: DataFrame, articles: DataFrame, vector: Column, limit: int = 100, offset: int = 0, top_k: int | None = None) -> DataFrame:
    """(article, id, chunk, title, date_published, similarity) of one page of chunks of the given articles.

    Order: similarity, then date, newest first with undated ones in front, then id. ``top_k`` bounds the
    candidates before paging when given; the page itself is limit and offset.
    """
    embedded = chunks.join(articles.select(F.col("url").alias("article"), "title", "date_published"), "article")
    tie = [F.desc_nulls_first("date_published"), F.asc("id")]
    if top_k is not None:
        embedded = by_cosine(embedded, vector, "embedding", tie, limit=top_k).drop("similarity")
    page = by_cosine(embedded, vector, "embedding", tie, limit, offset)
    return page.select("article", "id", "chunk", "title", "date_published", "similarity")


def in_date_order(page: DataFrame) -> DataFrame:
    """A page of results as it is shown: by date, oldest first and undated last, then by similarity."""
    return page.orderBy(F.asc_nulls_last("date_published"), F.desc("similarity"), "id")
