"""Title and content backfill: which pages to fetch, in what order, and what becomes of the results."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarrafa.functions.retry import extraction_status, status_label
from tarrafa.functions.text import first_filled, html_title
from tarrafa.functions.url import is_login_url
from tarrafa.models import extract_pages, json_parts
from tarrafa.operators.interleave import cooldown, numbered, round_robin, streaks
from tarrafa.operators.select import pending_urls
from tarrafa.sources.fetching import Get


def fetch_queue(events: DataFrame, now: datetime, limit: int | None = None, max_attempts: int = 4) -> DataFrame:
    """(sourceurl, domain, domain_count, place, streak, cooldown_s) in fetch order."""
    todo = pending_urls(events, now, max_attempts, limit)
    placed = round_robin(numbered(todo, ["first_ingested", "sourceurl"], "pos"), "pos")
    return cooldown(streaks(placed, "place")).select("sourceurl", "domain", "domain_count", "place", "streak", "cooldown_s")


def page_results(fetched: DataFrame) -> DataFrame:
    """(sourceurl, title, article_content, status, error) of fetched pages (url, final_url, http_status, html, error)."""
    parsed = extract_pages(extract_pages(fetched, "html"), "html", "_json", json_parts)
    # Title and text from the page's body, else from what it tells about itself, else the title element alone.
    parsed = parsed.withColumns({"_title": first_filled(F.col("page.title"), F.col("_json.title"), html_title(F.col("html"))), "_text": first_filled(F.col("page.text"), F.col("_json.text"))})
    login = is_login_url(F.coalesce("final_url", "url"))
    status = (
        F.when(F.col("http_status").isNull(), "download_failed").when(F.col("http_status") != 200, status_label(F.col("http_status")))
        .when(login, "login_required").otherwise(extraction_status(F.col("_title"), F.col("_text"), F.col("html").isNull()))
    )
    use = (F.col("http_status") == 200) & ~login
    return parsed.select(F.col("url").alias("sourceurl"), F.when(use, F.col("_title")).alias("title"), F.when(use, F.col("_text")).alias("article_content"), status.alias("status"), "error")


PAGE = "url string, html string, final_url string, status string, error string"


def fetch_pages(queue: DataFrame, get: Get, url: str = "sourceurl", wait: str | None = None, domain: str | None = None) -> DataFrame:
    """(url, html, final_url, status, error) of each address by ``fetching.page``, within tasks.

    With ``wait``, a column of seconds, a task rests after each page; with ``domain`` a site's pages are one task's, in
    their order, as waiting for a site makes sense one after the other only.
    """
    import time

    from tarrafa.sources.fetching import page

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                out.append((row.u, *page(get, row.u)))
                time.sleep(max(0.0, row.w))
            yield pd.DataFrame(out, columns=["url", "html", "final_url", "status", "error"])

    ordered = queue.repartition(domain).sortWithinPartitions("place") if domain else queue
    return ordered.select(F.col(url).alias("u"), (F.col(wait) if wait else F.lit(0.0)).cast("double").alias("w")).mapInPandas(run, PAGE)


def labelled_results(pages: DataFrame) -> DataFrame:
    """``page_results`` of fetched pages: what failed keeps the label it failed with."""
    ok = page_results(pages.where("status = 'ok'").select("url", "final_url", F.lit(200).alias("http_status"), "html", "error"))
    none = F.lit(None).cast("string")
    return ok.unionByName(pages.where("status <> 'ok'").select(F.col("url").alias("sourceurl"), none.alias("title"), none.alias("article_content"), "status", "error"))
