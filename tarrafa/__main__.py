"""Command line: ``python -m tarrafa --help``. Options may be set by ``TARRAFA_<OPTION>`` in the environment, too."""

from __future__ import annotations

import argparse
import json
import os
import time
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarrafa.session import exists, ship_package


def session() -> SparkSession:
    """The session of a command; workers get this package's source with it, wherever they run."""
    spark = SparkSession.builder.appName("tarrafa").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    ship_package(spark)
    return spark


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table kept as snapshots, or as plain Parquet files; None where there is neither."""
    from tarrafa.operators.upsert import read_snapshot

    snapshot = read_snapshot(spark, path)
    return snapshot if snapshot is not None else spark.read.parquet(path) if exists(spark, path) else None


def _table(spark: SparkSession, path: str) -> DataFrame:
    found = _stored(spark, path)
    if found is None:
        raise SystemExit(f"nothing is stored under {path}")
    return found


def _getter(a):
    """How pages are fetched: from a mirrored folder, or by plain requests; either way with retries."""
    from tarrafa.sources import fetching

    get = fetching.mirrored(a.mirror) if a.mirror else fetching.http_get
    return fetching.retrying(get, max(1, a.request_max_attempts), max(0.5, a.retry_base_seconds), max(1.0, a.retry_max_seconds), final=(403, 404))


def _search(a) -> None:
    from tarrafa.plans.search import Request, SearchService

    spark = session()
    service = SearchService(_chunks_with_vectors(spark, a), _table(spark, a.articles))
    response = service.search(Request(a.query, a.top_k, a.limit, a.offset, a.date_from, a.date_to))
    for row in response["results"]:
        print(f"{row['similarity']:.4f}  {row['article_date_published']}  {row['article_title']}  {row['article_url']}")


def _chunks_with_vectors(spark: SparkSession, a) -> DataFrame:
    from tarrafa.plans.crawl import with_embeddings

    chunks = _table(spark, a.chunks)
    return with_embeddings(chunks, _table(spark, a.embeddings)) if a.embeddings else chunks


def _serve(a) -> None:
    from wsgiref.simple_server import make_server

    from tarrafa.plans.search import SearchService, wsgi

    spark = session()
    with make_server(a.host, a.port, wsgi(SearchService(_chunks_with_vectors(spark, a), _table(spark, a.articles)))) as server:
        server.serve_forever()


def _ingest(a) -> None:
    """Exports that lie in a folder, or that a manifest lists and the ledger lacks; ``--polls 0`` goes on for ever."""
    from tarrafa.operators.select import pending_files
    from tarrafa.plans.ingest import ingest_files
    from tarrafa.sources.readers import read_manifest
    from tarrafa.streaming.ingest import ingest_stream

    if bool(a.landing) == bool(a.manifest):
        raise SystemExit("give either --landing or --manifest")
    spark, ledger = session(), a.ledger or f"{a.out.rstrip('/')}_processed_files"
    poll = 0
    while not a.polls or poll < a.polls:
        poll += 1
        try:
            if a.landing:
                query = ingest_stream(spark, a.landing, a.out, a.checkpoint or f"{a.out.rstrip('/')}_checkpoint", max(1, a.files_per_batch), ledger_root=ledger)
                query.awaitTermination()
                print(json.dumps(query.lastProgress, default=str))
            else:
                processed = spark.read.option("basePath", ledger).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], "file_name string")
                files = pending_files(read_manifest(spark, a.manifest), processed, max(0, a.bootstrap_latest_files) or None)
                taken = ingest_files(spark, files.limit(max(1, a.files_per_batch)), _getter(a), a.out, ledger)
                print(json.dumps({"files": taken}))
        except Exception as e:  # a failed round is tried again after the pause, unless it was the last
            print(json.dumps({"error": f"{type(e).__name__}: {e}"[:500]}))
            if a.polls and poll >= a.polls:
                raise
        if not a.polls or poll < a.polls:
            time.sleep(max(0, a.poll_interval_seconds))


def _dims(a) -> None:
    from tarrafa import dims
    from tarrafa.operators.views import enriched_events, orphans

    spark = session()
    for name in ("quad_class", "geo_type", "root_event", "column_dictionary"):
        getattr(dims, name)(spark).coalesce(1).write.mode("overwrite").parquet(f"{a.out}/{name}")
    if a.events:
        events = _table(spark, a.events)
        enriched_events(events).createOrReplaceTempView("gdelt_brazil_events_enriched")
        if a.check_keys == "yes":
            keys = {"quadclass": (dims.quad_class, "code"), "eventrootcode": (dims.root_event, "code"), **{c: (dims.geo_type, "code") for c, t in dims.coded_columns().items() if t == "geo_type"}}
            print(json.dumps({c: orphans(events, c, parent(spark), key).count() for c, (parent, key) in keys.items()}))


def _chunks(a) -> None:
    """Chunks of articles that have none yet, then the articles' flag; a run after a failure in between adds nothing twice."""
    from tarrafa.operators.select import unchunked_articles
    from tarrafa.operators.upsert import mark_chunked, write_snapshot
    from tarrafa.plans.crawl import article_chunks

    spark = session()
    articles, chunks = _table(spark, a.articles), _stored(spark, a.out)
    todo = unchunked_articles(articles)
    if chunks is not None:
        todo = todo.join(chunks.select(F.col("article").alias("url")), "url", "left_anti")
    rows = article_chunks(todo).select(F.xxhash64("article", "chunk_no").alias("id"), "article", "chunk_no", "chunk", F.lit(None).cast("array<float>").alias("embedding"))
    rows.write.mode("append").parquet(a.out)
    write_snapshot(mark_chunked(articles, spark.read.parquet(a.out)), a.articles)


def _embeddings(a) -> None:
    """Vectors of chunks that have none, neither in their own table nor in ``--out``."""
    from tarrafa.models import embed
    from tarrafa.operators.select import unembedded_chunks

    spark = session()
    todo, made = unembedded_chunks(_table(spark, a.chunks)), _stored(spark, a.out)
    if made is not None:
        todo = todo.join(made.select("id"), "id", "left_anti")
    embed(todo, "chunk").select("id", "embedding").write.mode("append").parquet(a.out)


def _entities(a) -> None:
    from tarrafa.models import extract_entities
    from tarrafa.operators.select import articles_without_entities

    spark = session()
    todo, made = _table(spark, a.articles), _stored(spark, a.out)
    if a.links:
        todo = articles_without_entities(todo, _table(spark, a.links))
    if made is not None:
        todo = todo.join(made.select("url"), "url", "left_anti")
    extract_entities(todo, "url", "text_content").write.mode("append").parquet(a.out)


def _now(a) -> datetime:
    return datetime.fromisoformat(a.now) if a.now else datetime.now(UTC).replace(tzinfo=None)


def _queue(a) -> None:
    from tarrafa.plans.backfill import fetch_queue

    queue = fetch_queue(_table(session(), a.events), _now(a), a.limit, a.max_attempts)
    queue.orderBy("place").write.mode("overwrite").parquet(a.out)


def _backfill(a) -> None:
    """Titles and texts of pages still to be fetched, put into all rows of their address."""
    from tarrafa.operators.interleave import cooldown
    from tarrafa.operators.upsert import record_titles, write_snapshot
    from tarrafa.plans.backfill import fetch_pages, fetch_queue, labelled_results
    from tarrafa.session import checkpointed

    spark, now = session(), _now(a)
    events = _table(spark, a.events)
    queue = cooldown(fetch_queue(events, now, a.limit, a.max_attempts), a.base_cooldown_seconds, a.streak_cooldown_seconds, a.streak_threshold, a.heavy_cooldown_seconds, a.heavy_threshold)
    pages = checkpointed(fetch_pages(queue, _getter(a), wait="cooldown_s" if a.wait == "yes" else None, domain="domain"))
    results = checkpointed(labelled_results(pages))
    write_snapshot(record_titles(events, results, F.lit(now).cast("timestamp")), a.events)
    print(json.dumps({r["status"]: r["n"] for r in results.groupBy("status").agg(F.count("*").alias("n")).collect()}))


def _crawl(a) -> None:
    """A sitemap index and the sitemaps it names into the articles and the sitemap table; fetches pages if asked to.

    Sitemaps come from a folder of files or, by address, from ``--root``: there the first valid index of the usual
    places counts. With --dry-run what would be fetched is counted, and nothing is written.
    """
    from tarrafa.functions.dates import index_candidates
    from tarrafa.operators.upsert import discover_sitemaps, mark_sitemaps_processed, write_snapshot
    from tarrafa.plans.crawl import crawl, newest_sitemaps, seeds, sitemap_counts, with_fetched
    from tarrafa.schemas import ARTICLES, SITEMAPS
    from tarrafa.session import checkpointed
    from tarrafa.sources.readers import decode_utf8, decompress, fetch, first_valid, read_xml, sitemap_index, sitemap_urlset

    if bool(a.sitemaps) == bool(a.root):
        raise SystemExit("give either --sitemaps or --root")
    spark, day = session(), date.fromisoformat(a.date) if a.date else datetime.now(UTC).date()
    until = date.fromisoformat(a.date) if a.date else None
    if a.root:
        get = _getter(a)
        got = lambda urls: fetch(urls, lambda u: (*get(u), None)).select("url", decode_utf8(decompress(F.col("body"))).alias("xml"))
        tried = spark.range(1).select(F.posexplode(index_candidates(a.root.rstrip("/"), F.lit(day), a.index)).alias("pos", "url"))
        found_index = first_valid(checkpointed(got(tried.select("url"))).join(tried, "url"))
        if found_index.isEmpty():
            raise SystemExit(f"no sitemap index found under {a.root}")
        index = checkpointed(newest_sitemaps(sitemap_index(found_index), until, a.max_sitemaps))
        xml = checkpointed(got(index.select(F.col("loc").alias("url")))).withColumnRenamed("url", "loc")
        chosen = xml.join(index, "loc")
    else:
        files = read_xml(spark, a.sitemaps).withColumn("file", F.element_at(F.split("path", "/"), -1))
        index = checkpointed(newest_sitemaps(sitemap_index(files), until, a.max_sitemaps))
        chosen = files.join(index.withColumn("file", F.element_at(F.split("loc", "/"), -1)), "file")
    # Newest first, as sitemaps are worked through; of an address named twice the one worked through last counts.
    place = F.struct(F.date_diff(F.lit("2200-01-01"), F.col("at")), -F.unix_micros("at"), -F.col("seq"), F.col("loc"))
    entries = sitemap_urlset(chosen.withColumnsRenamed({"lastmod": "_lastmod"}).withColumn("_place", place).withColumnRenamed("loc", "_sitemap"), keep=("_sitemap", "_lastmod", "_place"))
    entries = entries.withColumn("pos", F.struct("_place", "pos"))
    found = checkpointed(seeds(entries, F.col("_sitemap"), F.col("_lastmod"), F.current_timestamp()))

    stored = _stored(spark, a.articles)
    articles, todo = crawl(spark.createDataFrame([], ARTICLES) if stored is None else stored, found, a.max_articles, a.reprocess == "yes")
    todo = checkpointed(todo)
    print(json.dumps({"sitemaps": index.count(), "urls": found.count(), "pending": todo.count()}))
    if a.dry_run == "yes":
        return
    outcomes = None
    if a.fetch == "yes":
        articles, outcomes = with_fetched(articles, todo, _getter(a), F.current_timestamp())
    write_snapshot(articles, a.articles)
    if a.sitemap_table:
        maps = _stored(spark, a.sitemap_table)
        maps = spark.createDataFrame([], SITEMAPS) if maps is None else maps
        named = index.select(F.col("loc").alias("sitemap_url"), F.col("lastmod").alias("sitemap_lastmod"), F.lit(day).alias("target_date"), F.current_timestamp().alias("discovered_at"))
        maps = discover_sitemaps(maps, named.dropDuplicates(["sitemap_url"]))
        if a.fetch == "yes":
            maps = mark_sitemaps_processed(maps, sitemap_counts(found, todo, outcomes, day, F.current_timestamp()))
        write_snapshot(maps, a.sitemap_table)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tarrafa", description=__doc__)
    sub = parser.add_subparsers(required=True)

    def command(name: str, run, **options) -> None:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for option, kind in options.items():
            set_ = os.environ.get(f"TARRAFA_{option.upper()}")
            flag = f"--{option.replace('_', '-')}"
            if kind is None:
                p.add_argument(flag, required=set_ is None, default=set_)
            else:
                of = type(kind[0]) if kind[0] is not None else kind[1]
                p.add_argument(flag, type=of, default=kind[0] if set_ is None else of(set_))

    page = {"top_k": (None, int), "limit": (100,), "offset": (0,), "date_from": (None, str), "date_to": (None, str)}
    web = {"mirror": (None, str), "request_max_attempts": (6,), "retry_base_seconds": (2.0,), "retry_max_seconds": (90.0,)}
    command("search", _search, chunks=None, articles=None, query=None, embeddings=(None, str), **page)
    command("serve", _serve, chunks=None, articles=None, embeddings=(None, str), host=("127.0.0.1",), port=(8000,))
    command("ingest-events", _ingest, out=None, landing=(None, str), manifest=(None, str), checkpoint=(None, str), ledger=(None, str), files_per_batch=(16,), bootstrap_latest_files=(4,), polls=(1,), poll_interval_seconds=(300,), **web)
    command("backfill-queue", _queue, events=None, out=None, limit=(None, int), max_attempts=(4,), now=(None, str))
    cooldowns = {"base_cooldown_seconds": (1.5,), "streak_cooldown_seconds": (3.0,), "streak_threshold": (3,), "heavy_cooldown_seconds": (2.0,), "heavy_threshold": (20,)}
    command("backfill", _backfill, events=None, limit=(None, int), max_attempts=(4,), now=(None, str), wait=("yes",), **cooldowns, **web)
    command("crawl", _crawl, articles=None, sitemaps=(None, str), root=(None, str), index=(None, str), sitemap_table=(None, str), date=(None, str), max_sitemaps=(None, int), max_articles=(None, int), dry_run=("no",), reprocess=("no",), fetch=("no",), **web)
    command("populate-dims", _dims, out=None, events=(None, str), check_keys=("no",))
    command("populate-chunks", _chunks, articles=None, out=None)
    command("populate-embeddings", _embeddings, chunks=None, out=None)
    command("populate-entities", _entities, articles=None, out=None, links=(None, str))
    a = parser.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
