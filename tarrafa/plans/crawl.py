"""Sitemap crawl and chunking as table-to-table steps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarrafa.functions.dates import sitemap_sort_key
from tarrafa.functions.retry import extraction_status
from tarrafa.functions.text import CHUNK_OVERLAP, CHUNK_SIZE, chunk_header, chunks, clean_array, first_filled, html_title
from tarrafa.functions.url import host
from tarrafa.models import extract_pages, json_parts
from tarrafa.operators.select import extracted_urls
from tarrafa.operators.upsert import seed_articles
from tarrafa.sources.fetching import Get


def newest_sitemaps(index: DataFrame, until: date | None = None, limit: int | None = None) -> DataFrame:
    """(loc, lastmod, at, seq) of an index, newest first; ``until`` cuts at midnight UTC of that day."""
    keyed = index.withColumn("_k", sitemap_sort_key(F.col("loc"), F.col("lastmod"))).select("loc", "lastmod", "_k.at", "_k.seq")
    if until is not None:
        keyed = keyed.where(F.col("at") <= F.lit(until).cast("timestamp"))
    ordered = keyed.orderBy(F.desc("at"), F.desc("seq"), "loc")
    return ordered if limit is None else ordered.limit(limit)


def seeds(entries: DataFrame, sitemap_url: Column, sitemap_lastmod: Column, now: Column) -> DataFrame:
    """Article seeds of a sitemap's entries (pos, loc, lastmod, image_loc), with the entry kept as JSON."""
    raw = F.to_json(F.struct("loc", "lastmod", "image_loc"), {"ignoreNullFields": "false"})
    return entries.select(F.col("loc").alias("url"), now.alias("first_seen_at"), now.alias("last_seen_at"), sitemap_url.alias("sitemap_url"), sitemap_lastmod.alias("sitemap_lastmod"), F.col("lastmod").alias("sitemap_article_lastmod"), F.col("image_loc").alias("sitemap_image_url"), raw.alias("raw_sitemap"), "pos")


def pending_articles(found: DataFrame, articles: DataFrame, per_sitemap: int | None = None, reprocess: bool = False) -> DataFrame:
    """Seeds to fetch: those not extracted yet, at most ``per_sitemap`` of each sitemap in its own order."""
    todo = found if reprocess else found.join(extracted_urls(articles), "url", "left_anti")
    if per_sitemap is None:
        return todo
    return todo.withColumn("_n", F.row_number().over(Window.partitionBy("sitemap_url").orderBy("pos", "url"))).where(F.col("_n") <= per_sitemap).drop("_n")


def crawl(articles: DataFrame, found: DataFrame, per_sitemap: int | None = None, reprocess: bool = False) -> tuple[DataFrame, DataFrame]:
    """(articles with the seeds put in, seeds to fetch)."""
    return seed_articles(articles, found), pending_articles(found, articles, per_sitemap, reprocess)


def sitemap_counts(found: DataFrame, todo: DataFrame, outcomes: DataFrame | None, target_date: date, now: Column) -> DataFrame:
    """Rows of the sitemap table for ``mark_sitemaps_processed``, from a run's seeds, what of them was to be fetched, and its outcomes.

    ``outcomes`` has url and ok, once per fetched address. Counts cover this run; a sitemap without anything to fetch
    counts all its addresses as extracted.
    """
    listed = found.groupBy("sitemap_url").agg(F.any_value("sitemap_lastmod").alias("sitemap_lastmod"), F.count("*").cast("int").alias("urls_in_sitemap"))
    tried = todo.select("sitemap_url", "url")
    tried = tried.withColumn("ok", F.lit(None).cast("boolean")) if outcomes is None else tried.join(outcomes.select("url", "ok"), "url", "left")
    done = tried.groupBy("sitemap_url").agg(F.count_if("ok").cast("int").alias("_ok"), F.count_if(~F.coalesce("ok", F.lit(False))).cast("int").alias("_failed"))
    return listed.join(done, "sitemap_url", "left").select(
        "sitemap_url", "sitemap_lastmod", F.lit(target_date).alias("target_date"), now.alias("discovered_at"), now.alias("processed_at"), "urls_in_sitemap",
        F.coalesce("_ok", "urls_in_sitemap").alias("extracted_ok"), F.coalesce("_failed", F.lit(0)).alias("extracted_failed"),
    )


def metadata_json(meta: Column, final_url: Column) -> Column:
    """A map or struct of metadata as JSON, dates in ISO form, with the page's address where it names none."""
    named = F.map_from_arrays(F.array(F.lit("url")), F.array(final_url))
    return F.to_json(merged_metadata(meta, named), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def merged_metadata(main: Column, fallback: Column) -> Column:
    """Keys of ``main`` (a map), with those of ``fallback`` that it lacks."""
    return F.map_concat(F.map_filter(fallback, lambda k, v: ~F.map_contains_key(main, k)), main)


def article_fields(meta: DataFrame) -> DataFrame:
    """Stored columns from extracted metadata, each from the first of its sources that is filled."""
    return meta.select(
        "url", "title", "author", first_filled(F.col("hostname"), host(F.col("final_url"))).alias("hostname"), "sitename",
        first_filled(F.col("date"), F.col("published")).alias("date_published"), first_filled(F.col("description"), F.col("excerpt")).alias("excerpt"),
        clean_array(F.col("categories")).alias("categories"), clean_array(F.col("tags")).alias("tags"), "text_content",
    )


def article_chunks(articles: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(article, chunk_no, chunk): overlapping windows with the article's header in front; none for an empty text."""
    header = chunk_header(F.col("title"), F.col("date_published"), F.col("excerpt"), F.col("categories"))
    cut = articles.where("text_content is not null").select(F.col("url").alias("article"), header.alias("_h"), F.posexplode(chunks(F.col("text_content"), size, overlap)).alias("chunk_no", "_c"))
    return cut.select("article", "chunk_no", F.concat("_h", "_c").alias("chunk"))


def with_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with the vectors that were made for them put in by id; vectors of their own stay where there is no new one."""
    made = embeddings.groupBy("id").agg(F.any_value("embedding").alias("_made"))
    return chunks.join(made, "id", "left").withColumn("embedding", F.coalesce("_made", "embedding")).drop("_made").select(*chunks.columns)


def with_fetched(articles: DataFrame, todo: DataFrame, get: Get, now: Column) -> tuple[DataFrame, DataFrame]:
    """(articles with what was fetched and extracted put in, outcomes (url, ok)) of the seeds ``todo``, each address once."""
    from tarrafa.operators.upsert import record_extractions, record_fetch_errors
    from tarrafa.plans.backfill import fetch_pages
    from tarrafa.session import checkpointed

    pages = checkpointed(fetch_pages(todo.select("url").distinct(), get, "url"))
    failed = pages.where("status <> 'ok'").select("url", F.col("status").alias("fetch_status"), F.col("error").alias("fetch_error"), F.regexp_extract("error", r"^http_(\d+)$", 1).try_cast("int").alias("http_status"), now.alias("fetched_at"), "final_url")
    parsed = extract_pages(extract_pages(pages.where("status = 'ok'"), "html"), "html", "_json", json_parts)
    title, text = first_filled(F.col("page.title"), F.col("_json.title"), html_title(F.col("html"))), first_filled(F.col("page.text"), F.col("_json.text"))
    extracted = parsed.select(
        "url", F.lit(200).alias("http_status"), now.alias("fetched_at"), "final_url", extraction_status(title, text, F.col("html").isNull()).alias("extraction_status"), now.alias("extracted_at"),
        title.alias("title"), first_filled(F.col("page.author"), F.col("_json.author")).alias("author"), host(F.col("final_url")).alias("hostname"), first_filled(F.col("page.date"), F.col("_json.date")).alias("date_published"), text.alias("text_content"),
        metadata_json(F.create_map(F.lit("title"), title, F.lit("date"), first_filled(F.col("page.date"), F.col("_json.date"))), F.col("final_url")).alias("raw_metadata"),
    )
    extracted = checkpointed(extracted)
    stored = record_extractions(record_fetch_errors(articles, failed), extracted)
    return stored, pages.select("url", (F.col("status") == "ok").alias("_f")).join(extracted.select("url", "extraction_status"), "url", "left").select("url", (F.coalesce("extraction_status", F.lit("")) == "ok").alias("ok"))
