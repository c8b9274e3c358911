"""Writes with conflict rules as full outer joins of the old snapshot with new rows, and snapshot directories.

Parquet has no row-level changes: an upsert yields a new snapshot, which ``write_snapshot`` puts into a directory
of its own before a pointer to it is added. Nothing overwrites the path that it reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarrafa.operators.dedup import first_per_key, last_per_key
from tarrafa.session import names, read_text, write_text

Rule = Callable[[Column, Column], Column]
take_new: Rule = lambda old, new: new
keep_old: Rule = lambda old, new: F.coalesce(old, new)
prefer_new: Rule = lambda old, new: F.coalesce(new, old)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, default: Rule = take_new) -> DataFrame:
    """Old rows with new ones put in; ``rules`` give the value of a column where both have the key.

    ``new`` must have each key once. Columns that ``new`` lacks keep their old values (null for new rows).
    Null keys never meet, as in SQL.
    """
    rules = rules or {}
    o = old.select(F.struct(*old.columns).alias("o"), *[F.col(k).alias(f"_o_{k}") for k in keys])
    n = new.select(F.struct(*new.columns).alias("n"), *[F.col(k).alias(f"_n_{k}") for k in keys])
    on = [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys]
    joined = o.join(n, on, "full_outer")
    out = []
    for c in old.columns:
        if c not in new.columns:
            value = F.col("o")[c]
        else:
            both = rules.get(c, default)(F.col("o")[c], F.col("n")[c])
            value = F.when(F.col("o").isNull(), F.col("n")[c]).when(F.col("n").isNull(), F.col("o")[c]).otherwise(both)
        out.append(value.alias(c))
    return joined.select(*out)


def update(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, default: Rule = take_new) -> DataFrame:
    """As ``upsert``, but keys that ``old`` lacks are left out; a key may stand in many old rows."""
    rules = rules or {}
    n = new.select(F.struct(*new.columns).alias("_n"), *[F.col(k).alias(f"_n_{k}") for k in keys])
    joined = old.join(n, [old[k] == n[f"_n_{k}"] for k in keys], "left")
    value = lambda c: F.when(F.col("_n").isNull(), old[c]).otherwise(rules.get(c, default)(old[c], F.col("_n")[c])) if c in new.columns and c not in keys else old[c]
    return joined.select(*[value(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` that may be added: keys unknown to ``old``, each once. Keys with a null never conflict."""
    free = F.lit(False)
    for k in keys:
        free = free | F.col(k).isNull()
    first = first_per_key(new.where(~free), keys).unionByName(new.where(free))
    return first.join(old.select(*keys), keys, "left_anti").select(*new.columns)


def seed_articles(old: DataFrame, found: DataFrame) -> DataFrame:
    """Crawled addresses into the articles: ``first_seen_at`` stays, all else that ``found`` has moves on.

    ``found`` has ``pos``; of an address named twice the later one counts.
    """
    new = last_per_key(found, ["url"], "pos").drop("pos")
    return upsert(old, new, ["url"], {"first_seen_at": keep_old})


def discover_sitemaps(old: DataFrame, found: DataFrame) -> DataFrame:
    """Sitemaps of an index: counts start at 0 and are left alone where they exist."""
    new = found.select("sitemap_url", "sitemap_lastmod", "target_date", "discovered_at", *[F.lit(0).alias(c) for c in ("urls_in_sitemap", "extracted_ok", "extracted_failed")])
    return upsert(old, new, ["sitemap_url"], {c: keep_old for c in ("urls_in_sitemap", "extracted_ok", "extracted_failed")})


def mark_sitemaps_processed(old: DataFrame, done: DataFrame) -> DataFrame:
    """Sitemaps that were worked through: ``done`` replaces all that is stored of them, the time of discovery too."""
    return upsert(old, done, ["sitemap_url"])


def record_fetch_errors(articles: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed fetches (url, fetch_status, fetch_error, http_status, fetched_at, final_url): one attempt more."""
    counted = failed.withColumn("fetch_attempts", F.lit(1))
    return update(articles, counted, ["url"], {"fetch_attempts": lambda old, new: F.coalesce(old, F.lit(0)) + new, "final_url": prefer_new})


def record_extractions(articles: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extracted articles: the fetch counts as ok even where the extraction failed; nulls overwrite."""
    counted = extracted.withColumns({"fetch_status": F.lit("ok"), "fetch_error": F.lit(None).cast("string"), "fetch_attempts": F.lit(1)})
    return update(articles, counted, ["url"], {"fetch_attempts": lambda old, new: F.coalesce(old, F.lit(0)) + new})


def record_titles(events: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Fetch results (sourceurl, title, article_content, status, error) into all rows of their address."""
    from tarrafa.functions.retry import next_retry_at

    new = results.select("sourceurl", "title", "article_content", now.alias("title_last_fetch_at"), F.col("status").alias("title_fetch_status"), F.col("error").alias("title_fetch_error"), F.lit(1).alias("title_fetch_attempts"), next_retry_at(F.col("status"), F.lit(1), now).alias("title_next_retry_at"))
    return update(events, new, ["sourceurl"], {"title_fetch_attempts": lambda old, n: F.coalesce(old, F.lit(0)) + n})


def mark_chunked(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """is_chunked set where an article has chunks, unchanged elsewhere."""
    has = chunks.select(F.col("article").alias("_a")).distinct()
    joined = articles.join(has, articles["url"] == has["_a"], "left")
    return joined.select(*[(F.col("_a").isNotNull() | F.coalesce(articles[c], F.lit(False))).alias(c) if c == "is_chunked" else articles[c] for c in articles.columns])


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write ``df`` as a new snapshot under ``root``; the pointer with the highest number counts.

    Pointers are only ever added, each by one rename, so that a reader finds the snapshot before or the one after.
    Of two writers at once the slower one fails.
    """
    spark, name = df.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    number = max(_pointers(spark, root), default=0) + 1
    df.write.parquet(f"{root}/{name}")
    write_text(spark, f"{root}/_pointers/{number:012d}", name)
    return name


def _pointers(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in names(spark, f"{root}/_pointers") if n.isdigit()]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The current snapshot under ``root``, on any file system, or None before the first."""
    numbers = _pointers(spark, root)
    return spark.read.parquet(f"{root}/{read_text(spark, f'{root}/_pointers/{max(numbers):012d}').strip()}") if numbers else None
