"""Row selection: work queues, lookups, semi and anti joins. Every limit has an order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarrafa.functions.retry import TERMINAL


def page(df: DataFrame, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a table in the order of its key."""
    return df.orderBy(key).offset(offset).limit(limit)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row or rows with a key; the filter reaches the scan."""
    return df.where(F.col(key) == (value if isinstance(value, Column) else F.lit(value)))


def chunks_of(chunks: DataFrame, article) -> DataFrame:
    """The chunks of one article, in the order of their ids."""
    return by_key(chunks, "article", article).orderBy("id")


def empty(text: Column) -> Column:
    return text.isNull() | (text == "")


def pending_urls(events: DataFrame, now: datetime | Column, max_attempts: int = 4, limit: int | None = None) -> DataFrame:
    """(sourceurl, first_ingested) of addresses whose title or content is still to be fetched, oldest first.

    An address once per table: its earliest row counts for the order, ties by address.
    """
    moment = now if isinstance(now, Column) else F.lit(now)
    wanted = events.where(
        ~empty(F.col("sourceurl")) & (empty(F.col("title")) | empty(F.col("article_content"))) & (F.coalesce("title_fetch_attempts", F.lit(0)) < max_attempts)
        & (F.col("title_next_retry_at").isNull() | (F.col("title_next_retry_at") <= moment)) & ~F.coalesce("title_fetch_status", F.lit("")).isin(TERMINAL)
    )
    queue = wanted.groupBy("sourceurl").agg(F.min("ingested_at").alias("first_ingested")).orderBy(F.asc_nulls_last("first_ingested"), "sourceurl")
    return queue if limit is None else queue.limit(limit)


def unchunked_articles(articles: DataFrame, limit: int | None = None) -> DataFrame:
    todo = articles.where(F.col("text_content").isNotNull() & ~F.coalesce("is_chunked", F.lit(False)))
    return todo if limit is None else todo.orderBy("url").limit(limit)


def unembedded_chunks(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    todo = chunks.where("embedding is null").select("id", "chunk")
    return todo if limit is None else todo.orderBy("id").limit(limit)


def articles_without_entities(articles: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    todo = articles.where("text_content is not null").join(links, articles["url"] == links["g1_article_url"], "left_anti")
    return todo if limit is None else todo.orderBy("url").limit(limit)


def extracted_urls(articles: DataFrame) -> DataFrame:
    """Addresses that need no second crawl."""
    return articles.where((F.col("extraction_status") == "ok") & ~empty(F.col("text_content"))).select("url")


def dated(df: DataFrame, column: str, date_from=None, date_to=None) -> DataFrame:
    """Rows within inclusive bounds; a bound that is empty or None doesn't count."""
    if date_from:
        df = df.where(F.col(column) >= F.lit(date_from))
    if date_to:
        df = df.where(F.col(column) <= F.lit(date_to))
    return df


def searchable_articles(articles: DataFrame, min_length: int = 200, date_from=None, date_to=None) -> DataFrame:
    """Articles with more than ``min_length`` characters of text, within the dates."""
    return dated(articles.where(F.length("text_content") > min_length), "date_published", date_from, date_to)


def pending_files(listed: DataFrame, processed: DataFrame, bootstrap: int | None = None) -> DataFrame:
    """Files of a manifest not yet processed, newest name first; on a first run the latest ``bootstrap`` of them."""
    todo = listed.join(processed, "file_name", "left_anti").orderBy(F.desc("file_name"))
    return todo.limit(bootstrap) if bootstrap is not None and processed.isEmpty() else todo
