"""Queries of the relational operators over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarrafa.functions import arrays, dates, numbers, retry, text, url, vector
from tarrafa.operators import dedup, entities, interleave, knn, select, upsert, views, weekly
from tarrafa.plans import crawl, ranking
from tarrafa.session import table
from tarrafa.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The moment at which queue queries are asked.
NOW = datetime(2024, 1, 1)
_HOST = r"lower(regexp_extract(trim({0}, chr(9) || chr(10) || chr(13) || chr(32) || chr(160)), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)', 1))"
_E = _HOST.format("sourceurl")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def events(spark, d, *c):
    return table(spark, d, "gdelt_brazil_events", *c)


def articles(spark, d, *c):
    return table(spark, d, "g1_articles", *c)


def chunks(spark, d, *c):
    return table(spark, d, "g1_chunks", *c)


# Scalar functions


@query(f"SELECT id, {_E} AS host FROM gdelt_brazil_events")
def url_host(spark, d):
    return events(spark, d, "id", "sourceurl").select("id", url.host(F.col("sourceurl")).alias("host"))


@query(f"SELECT id, ends_with({_E}, '.br') OR {_E} IN ('brasil247.com', 'exame.com', 'g1.globo.com', 'globo.com', 'metropoles.com', 'revistaoeste.com') AS allowed FROM gdelt_brazil_events")
def source_allowlist(spark, d):
    return events(spark, d, "id", "sourceurl").select("id", url.allowed_source(F.col("sourceurl")).alias("allowed"))


@query("SELECT url, list_extract(string_split(url, '/'), -1) AS segment, array_to_string(list_slice(string_split(list_extract(string_split(url, '/'), -1), '-'), 1, -2), ' ') AS slug FROM g1_articles")
def slug_title(spark, d):
    return articles(spark, d, "url").select("url", url.last_segment(F.col("url")).alias("segment"), url.slug_title(F.col("url")).alias("slug"))


@query(r"SELECT id, regexp_matches(lower(sourceurl), 'require_login|/login|signin|credentials_cookie_auth|acl_users') AS login FROM gdelt_brazil_events")
def login_url_flag(spark, d):
    return events(spark, d, "id", "sourceurl").select("id", url.is_login_url(F.col("sourceurl")).alias("login"))


@query("SELECT id, CASE WHEN starts_with(sourceurl, 'http://') THEN sourceurl || ' ' || 'https://' || substr(sourceurl, 8) ELSE sourceurl END AS tried FROM gdelt_brazil_events")
def fetch_candidates(spark, d):
    return events(spark, d, "id", "sourceurl").select("id", F.array_join(url.fetch_candidates(F.col("sourceurl")), " ").alias("tried"))


@query(r"SELECT id, nullif(trim(regexp_replace(replace(title, '&amp;', '&'), '\s+', ' ', 'g')), '') AS page_title FROM gdelt_brazil_events")
def html_title(spark, d):
    """Pages are made from titles, as the tables hold no markup."""
    page = F.concat(F.lit("<html><head>\n<TITLE lang='pt'>\n"), F.col("title"), F.lit("  </TITLE></head><body><title>x</title></body></html>"))
    return events(spark, d, "id", "title").select("id", text.html_title(page).alias("page_title"))


_STATUS = "CASE WHEN {0} = 404 THEN 'not_found' WHEN {0} = 410 THEN 'gone' WHEN {0} = 403 THEN 'forbidden' WHEN {0} = 429 THEN 'rate_limited' WHEN {0} >= 500 THEN {1} WHEN {0} <> 200 THEN 'download_failed' END"


@query(f"""SELECT url, {_STATUS.format("http_status", "'server_error'")} AS label, coalesce({_STATUS.format("http_status", "'download_failed'")}, 'download_failed') AS raised,
    CASE http_status WHEN 403 THEN 'forbidden' WHEN 404 THEN 'not_found' ELSE 'download_failed' END AS crawler FROM g1_articles""")
def http_status_class(spark, d):
    c = F.col("http_status")
    return articles(spark, d, "url", "http_status").select("url", retry.status_label(c).alias("label"), retry.raised_label(c).alias("raised"), retry.crawl_label(c).alias("crawler"))


@query("""SELECT id, CAST(CASE WHEN title_fetch_status IN ('ok', 'not_found', 'gone', 'login_required', 'forbidden', 'blocked') THEN NULL WHEN title_fetch_status = 'rate_limited' THEN 1800
    WHEN title_fetch_status IN ('server_error', 'download_failed') THEN least(21600, 300 * greatest(1, coalesce(title_fetch_attempts, 1)))
    WHEN title_fetch_status IN ('extract_failed', 'no_title', 'no_content', 'error') THEN least(86400, 3600 * greatest(1, coalesce(title_fetch_attempts, 1))) ELSE 7200 END AS INTEGER) AS seconds,
    least(90.0, 2.0 * pow(2, greatest(1, coalesce(title_fetch_attempts, 1)) - 1)) AS backoff FROM gdelt_brazil_events""")
def retry_delay(spark, d):
    a = F.greatest(F.lit(1), F.coalesce("title_fetch_attempts", F.lit(1)))
    return events(spark, d, "id", "title_fetch_status", "title_fetch_attempts").select("id", retry.retry_seconds(F.col("title_fetch_status"), F.col("title_fetch_attempts")).alias("seconds"), retry.backoff_seconds(a).alias("backoff"))


@query("SELECT id, regexp_matches(lower(coalesce(title_fetch_error, '')), '" + "|".join(retry.DNS_MARKERS) + "') AS dns FROM gdelt_brazil_events")
def dns_errors(spark, d):
    return events(spark, d, "id", "title_fetch_error").select("id", retry.is_dns_error(F.col("title_fetch_error")).alias("dns"))


@query(r"""WITH v AS (SELECT url, unnest([date_published, sitemap_lastmod, sitemap_article_lastmod]) AS raw FROM g1_articles),
    n AS (SELECT url, raw, CASE WHEN regexp_matches(trim(raw), '^[+-]?\d+(\.\d*)?$') THEN CAST(trim(raw) AS DOUBLE) END AS x FROM v)
    SELECT url, raw, CASE WHEN x = floor(x) THEN CAST(x AS BIGINT) END AS whole, x AS real FROM n""")
def numeric_coercion(spark, d):
    v = articles(spark, d, "url", "date_published", "sitemap_lastmod", "sitemap_article_lastmod").select("url", F.explode(F.array("date_published", "sitemap_lastmod", "sitemap_article_lastmod")).alias("raw"))
    return v.select("url", "raw", numbers.lenient_integer(F.col("raw")).alias("whole"), numbers.lenient_double(F.col("raw")).alias("real"))


# A lastmod as date, clock time, fraction and offset; what isn't one of these notations, or no date, leaves the file's name.
_MOD = r"'^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d+))?([zZ]|[+-]\d{2}:?\d{2})?)?$'"
_SITEMAPS = rf"""SELECT sitemap_url, coalesce(stamp, named, 0) AS at_micros, CASE WHEN stamp IS NULL AND named IS NOT NULL THEN CAST(regexp_extract(sitemap_url, '_(\d+)\.xml$', 1) AS INTEGER) ELSE 0 END AS seq FROM (
    SELECT sitemap_url, CASE WHEN NOT regexp_matches(sitemap_url, '/\d{{4}}/\d{{2}}/\d{{2}}_\d+\.xml$') THEN NULL ELSE epoch_us(try_cast(replace(regexp_extract(sitemap_url, '/(\d{{4}}/\d{{2}}/\d{{2}})_\d+\.xml$', 1), '/', '-') AS TIMESTAMP)) END AS named,
    CASE WHEN regexp_matches(sitemap_lastmod, {_MOD}) THEN epoch_us(try_cast(regexp_extract(sitemap_lastmod, {_MOD}, 1) || ' ' || coalesce(nullif(regexp_extract(sitemap_lastmod, {_MOD}, 2), ''), '00:00') || coalesce(nullif(regexp_extract(sitemap_lastmod, {_MOD}, 3), ''), ':00') AS TIMESTAMP))
        + CAST(rpad(left(regexp_extract(sitemap_lastmod, {_MOD}, 4), 6), 6, '0') AS BIGINT)
        - CASE WHEN regexp_matches(sitemap_lastmod, '[+-]\d{{2}}:?\d{{2}}$') AND regexp_extract(sitemap_lastmod, {_MOD}, 5) <> '' THEN CAST(left(regexp_extract(sitemap_lastmod, {_MOD}, 5), 1) || '1' AS BIGINT)
            * (CAST(substring(regexp_extract(sitemap_lastmod, {_MOD}, 5), 2, 2) AS BIGINT) * 60 + CAST(right(regexp_extract(sitemap_lastmod, {_MOD}, 5), 2) AS BIGINT)) * 60000000 ELSE 0 END END AS stamp
    FROM g1_sitemaps)"""


def _newest(spark, d, until=None, limit=None):
    index = table(spark, d, "g1_sitemaps", "sitemap_url", "sitemap_lastmod").withColumnsRenamed({"sitemap_url": "loc", "sitemap_lastmod": "lastmod"})
    return crawl.newest_sitemaps(index, until, limit).select(F.col("loc").alias("sitemap_url"), F.unix_micros("at").alias("at_micros"), "seq")


@query(_SITEMAPS)
def sitemap_sort(spark, d):
    """All sitemaps, lastmod as stored, with what they are sorted by."""
    return _newest(spark, d)


@query(f"{_SITEMAPS} ORDER BY at_micros DESC, seq DESC, sitemap_url")
def sitemap_order(spark, d):
    """All sitemaps, newest first."""
    return _newest(spark, d)


@query(f"SELECT * FROM ({_SITEMAPS}) WHERE at_micros <= epoch_us(TIMESTAMP '2019-01-01')")
def sitemap_cutoff(spark, d):
    """Sitemaps up to a day's midnight in UTC."""
    return _newest(spark, d, date(2019, 1, 1))


@query(f"SELECT * FROM ({_SITEMAPS}) ORDER BY at_micros DESC, seq DESC, sitemap_url LIMIT 10")
def sitemap_cap(spark, d):
    """The newest few: the limit is the operator."""
    return _newest(spark, d, None, 10)


_DATE = r"try_cast(nullif(regexp_extract(date_published, '^\s*(\d{4}-\d{2}-\d{2})', 1), '') AS DATE)"


@query(f"SELECT url, {_DATE} AS day, CAST(isoyear({_DATE}) AS INTEGER) AS iso_year, CAST(weekofyear({_DATE}) AS INTEGER) AS iso_week FROM g1_articles")
def lenient_dates(spark, d):
    day = articles(spark, d, "url", "date_published").select("url", dates.lenient_date(F.col("date_published")).alias("day"))
    return day.select("url", "day", dates.iso_year(F.col("day")).cast("int").alias("iso_year"), dates.iso_week(F.col("day")).cast("int").alias("iso_week"))


@query("SELECT id, try_strptime(CAST(sqldate AS VARCHAR), '%Y%m%d')::DATE AS day, contains(sourceurl, strftime(try_strptime(CAST(sqldate AS VARCHAR), '%Y%m%d'), '/%Y/%m/%d_')) AS marked FROM gdelt_brazil_events")
def coded_dates(spark, d):
    day = events(spark, d, "id", "sqldate", "sourceurl").withColumn("day", dates.coded_date(F.col("sqldate")))
    return day.select("id", "day", dates.day_marker(F.col("sourceurl"), F.col("day")).alias("marked"))


@query(f"SELECT url, coalesce(nullif(hostname, ''), nullif({_HOST.format('final_url')}, '')) AS hostname, coalesce(nullif(excerpt, ''), nullif(title, '')) AS lead FROM g1_articles")
def first_filled(spark, d):
    return articles(spark, d, "url", "hostname", "final_url", "excerpt", "title").select("url", text.first_filled(F.col("hostname"), url.host(F.col("final_url"))).alias("hostname"), text.first_filled(F.col("excerpt"), F.col("title")).alias("lead"))


@query("""WITH t AS (SELECT url, list_filter(list_transform(string_split(array_to_string(tags, ' , '), ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM g1_articles)
    SELECT url, CASE WHEN len(items) > 0 THEN array_to_string(items, '|') END AS items FROM t""")
def text_array(spark, d):
    joined = F.array_join("tags", " , ")
    return articles(spark, d, "url", "tags").select("url", F.array_join(text.text_array(joined), "|").alias("items"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_object('id', event_id, 'kind', event_type) AS made FROM events")
def json_extract(spark, d):
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    return table(spark, d, "events", "event_id", "props", "event_type").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), made.alias("made"))


@query("""WITH n AS (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1024 THEN 1 ELSE CAST(ceil((length(text) - 1024) / 768.0) AS INTEGER) + 1 END AS n FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, text, unnest(range(0, n)) AS chunk_no FROM n) SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, substring(text, chunk_no * 768 + 1, 1024) AS chunk FROM c""")
def chunk_documents(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query("""WITH n AS (SELECT *, CASE WHEN length(text_content) = 0 THEN 0 WHEN length(text_content) <= 1024 THEN 1 ELSE CAST(ceil((length(text_content) - 1024) / 768.0) AS INTEGER) + 1 END AS n FROM g1_articles WHERE text_content IS NOT NULL),
    c AS (SELECT *, unnest(range(0, n)) AS i FROM n)
    SELECT url AS article, CAST(i AS INTEGER) AS chunk_no, 'Título: ' || coalesce(title, 'None') || chr(10) || 'Publicado: ' || coalesce(date_published, 'None') || chr(10)
    || CASE WHEN length(excerpt) > 0 THEN 'Trecho: ' || excerpt || chr(10) ELSE '' END
    || CASE WHEN len(categories) > 0 THEN 'Categorias: ' || array_to_string(list_transform(categories, lambda x: coalesce(x, 'None')), ', ') || chr(10) ELSE '' END || chr(10)
    || substring(text_content, i * 768 + 1, 1024) AS chunk FROM c""")
def chunk_header(spark, d):
    return crawl.article_chunks(articles(spark, d, "url", "title", "date_published", "excerpt", "categories", "text_content"))


@query("SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_functions(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    a, b = e.select(F.col("vec_id").alias("vec_a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("vec_b"), F.col("embedding").alias("y"))
    both = a.join(b, F.col("vec_b") == F.col("vec_a") + 1)
    return both.select("vec_a", "vec_b", F.round(vector.cosine(F.col("x"), F.col("y")), 6).alias("similarity"), F.round(vector.l2(F.col("x"), F.col("y")), 6).alias("distance"))


@query(f"SELECT date_published, count(*) AS n FROM g1_articles WHERE date_published IS NOT NULL AND {_DATE} IS NULL GROUP BY 1")
def raw_sql(spark, d):
    """SQL over registered views: dates that aren't ISO dates."""
    from tarrafa.sources.tables import register

    register(spark, d, ["g1_articles"])
    return spark.sql(r"SELECT date_published, count(*) AS n FROM g1_articles WHERE date_published IS NOT NULL AND try_cast(regexp_extract(date_published, '^\\s*(\\d{4}-\\d{2}-\\d{2})', 1) AS DATE) IS NULL GROUP BY 1")


@query("""SELECT url, '{"title":' || coalesce(replace(to_json(title)::VARCHAR, '\\/', '/'), 'null') || ',"url":' || replace(to_json(url)::VARCHAR, '\\/', '/') || '}' AS body FROM g1_articles""")
def json_rows(spark, d):
    """Response rows of all articles as JSON."""
    return articles(spark, d, "url", "title").select("url", F.to_json(F.struct("title", "url"), {"ignoreNullFields": "false"}).alias("body"))


@query(SQL["json_rows"])
def json_rows_all(spark, d):
    return json_rows(spark, d)


# Joins and filters


@query("""SELECT e.id, e.quadclass, q.label AS quadclass_label, r.label AS eventrootcode_label, g1.label AS actor1geo_type_label, g2.label AS actor2geo_type_label, g3.label AS actiongeo_type_label FROM gdelt_brazil_events e
    LEFT JOIN (VALUES (1, 'Verbal Cooperation'), (2, 'Material Cooperation'), (3, 'Verbal Conflict'), (4, 'Material Conflict')) q(code, label) ON e.quadclass = q.code
    LEFT JOIN (VALUES """ + ", ".join(f"('{c}', '{x}')" for c, x in __import__("tarrafa.dims", fromlist=["ROOT_EVENTS"]).ROOT_EVENTS) + """) r(code, label) ON e.eventrootcode = r.code
    LEFT JOIN geo g1 ON e.actor1geo_type = g1.code LEFT JOIN geo g2 ON e.actor2geo_type = g2.code LEFT JOIN geo g3 ON e.actiongeo_type = g3.code""")
def enriched_events(spark, d):
    e = views.enriched_events(events(spark, d, "id", "quadclass", "eventrootcode", "actor1geo_type", "actor2geo_type", "actiongeo_type"))
    return e.select("id", "quadclass", "quadclass_label", "eventrootcode_label", "actor1geo_type_label", "actor2geo_type_label", "actiongeo_type_label")


SQL["enriched_events"] = "WITH geo(code, label) AS (VALUES (1, 'COUNTRY'), (2, 'USSTATE'), (3, 'USCITY'), (4, 'WORLDCITY'), (5, 'WORLDSTATE')) " + SQL["enriched_events"]


@query("SELECT id, article FROM g1_chunks WHERE article IN (SELECT url FROM g1_articles WHERE length(text_content) > 200 AND date_published >= '2018' AND date_published <= '2023')")
def semi_long_articles(spark, d):
    chosen = select.searchable_articles(articles(spark, d, "url", "text_content", "date_published"), 200, "2018", "2023")
    return chunks(spark, d, "id", "article").join(chosen.select(F.col("url").alias("article")), "article", "left_semi").select("id", "article")


@query("SELECT url FROM g1_articles WHERE text_content IS NOT NULL AND NOT EXISTS (SELECT 1 FROM article_entities x WHERE x.g1_article_url = url)")
def anti_without_entities(spark, d):
    return select.articles_without_entities(articles(spark, d, "url", "text_content"), table(spark, d, "article_entities", "g1_article_url")).select("url")


@query("SELECT url FROM g1_articles WHERE text_content IS NOT NULL AND is_chunked IS NOT TRUE ORDER BY url LIMIT 50")
def unchunked_batch(spark, d):
    """A work batch: the limit is the operator."""
    return select.unchunked_articles(articles(spark, d, "url", "text_content", "is_chunked"), 50).select("url")


@query("SELECT id, chunk FROM g1_chunks WHERE embedding IS NULL ORDER BY id LIMIT 100")
def unembedded_batch(spark, d):
    """A work batch: the limit is the operator."""
    return select.unembedded_chunks(chunks(spark, d, "id", "chunk", "embedding"), 100)


@query("SELECT url FROM g1_articles WHERE extraction_status = 'ok' AND text_content <> ''")
def extracted_urls(spark, d):
    return select.extracted_urls(articles(spark, d, "url", "extraction_status", "text_content"))


@query("SELECT DISTINCT source_file AS file_name FROM gdelt_brazil_events WHERE source_file NOT IN (SELECT file_name FROM processed_files)")
def pending_files(spark, d):
    listed = events(spark, d, "source_file").distinct().withColumnRenamed("source_file", "file_name")
    return select.pending_files(listed, table(spark, d, "processed_files", "file_name"))


@query("SELECT DISTINCT source_file AS file_name FROM gdelt_brazil_events ORDER BY file_name DESC LIMIT 4")
def bootstrap_files(spark, d):
    """The latest files of a first run: the limit is the operator."""
    listed = events(spark, d, "source_file").distinct().withColumnRenamed("source_file", "file_name")
    return select.pending_files(listed, spark.createDataFrame([], "file_name string"), 4)


_PENDING = """SELECT sourceurl, min(ingested_at) AS first_ingested FROM gdelt_brazil_events WHERE sourceurl <> '' AND (coalesce(title, '') = '' OR coalesce(article_content, '') = '') AND coalesce(title_fetch_attempts, 0) < 4
    AND (title_next_retry_at IS NULL OR title_next_retry_at <= TIMESTAMP '2024-01-01') AND coalesce(title_fetch_status, '') NOT IN ('ok', 'not_found', 'gone', 'login_required', 'forbidden', 'blocked') GROUP BY sourceurl"""


def _pending(spark, d):
    return select.pending_urls(events(spark, d, "sourceurl", "title", "article_content", "title_fetch_attempts", "title_next_retry_at", "title_fetch_status", "ingested_at"), NOW)


@query(f"SELECT sourceurl, epoch_us(first_ingested) AS first_micros FROM ({_PENDING})")
def pending_urls(spark, d):
    return _pending(spark, d).select("sourceurl", F.unix_micros("first_ingested").alias("first_micros"))


@query(f"SELECT sourceurl FROM ({_PENDING}) ORDER BY first_ingested, sourceurl LIMIT 25")
def pending_batch(spark, d):
    """The oldest of the queue: the limit is the operator."""
    queue = select.pending_urls(events(spark, d, "sourceurl", "title", "article_content", "title_fetch_attempts", "title_next_retry_at", "title_fetch_status", "ingested_at"), NOW, limit=25)
    return queue.select("sourceurl")


@query("""SELECT sitemap_url, url FROM (SELECT sitemap_url, url, row_number() OVER (PARTITION BY sitemap_url ORDER BY url) AS n FROM g1_articles WHERE NOT (extraction_status = 'ok' AND coalesce(text_content, '') <> '') IS TRUE) WHERE n <= 3""")
def capped_per_sitemap(spark, d):
    """Articles still to be fetched, a few of each sitemap: the cap is the operator."""
    a = articles(spark, d, "url", "sitemap_url", "extraction_status", "text_content")
    found = a.select("url", "sitemap_url", F.lit(0).alias("pos"))
    return crawl.pending_articles(found, a, 3).select("sitemap_url", "url")


@query(f"SELECT {_E} AS domain, count(*) AS pending FROM ({_PENDING}) GROUP BY 1")
def pending_per_domain(spark, d):
    return _pending(spark, d).groupBy(url.host(F.col("sourceurl")).alias("domain")).agg(F.count("*").alias("pending"))


@query("SELECT id, text, type FROM g1_entities WHERE (text, type) IN (SELECT e.text, e.type FROM article_entities x JOIN g1_entities e ON e.id = x.g1_entities_id)")
def composite_in(spark, d):
    """Entities whose pair of text and type some article mentions."""
    e = table(spark, d, "g1_entities", "id", "text", "type")
    named = e.join(table(spark, d, "article_entities", "g1_entities_id"), F.col("id") == F.col("g1_entities_id"), "left_semi").select("text", "type")
    return e.join(named, ["text", "type"], "left_semi").select("id", "text", "type")


@query("SELECT url, title, http_status FROM g1_articles WHERE url = (SELECT max(url) FROM g1_articles)")
def point_lookup(spark, d):
    """One row by its key."""
    a = articles(spark, d, "url", "title", "http_status")
    return select.by_key(a, "url", a.agg(F.max("url").alias("m")).scalar())


@query("SELECT id, article, chunk FROM g1_chunks WHERE article = (SELECT max(article) FROM g1_chunks) ORDER BY id")
def chunks_of_article(spark, d):
    """The chunks of one article."""
    c = chunks(spark, d, "id", "article", "chunk")
    return select.chunks_of(c, c.agg(F.max("article").alias("m")).scalar())


@query("SELECT url, title FROM g1_articles ORDER BY url LIMIT 100 OFFSET 20")
def table_page(spark, d):
    """A page of a table: limit and offset are the operator."""
    return select.page(articles(spark, d, "url", "title"), "url", 100, 20)


@query("SELECT l.id, l.g1_article_url, e.text, e.type FROM article_entities l JOIN g1_entities e ON e.id = l.g1_entities_id")
def mentions(spark, d):
    links = table(spark, d, "article_entities", "id", "g1_article_url", "g1_entities_id")
    e = table(spark, d, "g1_entities").select(F.col("id").alias("g1_entities_id"), "text", "type")
    return links.join(e, "g1_entities_id").select("id", "g1_article_url", "text", "type")


# Aggregates and windows


@query("SELECT id, sourceurl FROM (SELECT id, sourceurl, row_number() OVER (PARTITION BY sourceurl ORDER BY source_file, id) AS n FROM gdelt_brazil_events) WHERE n = 1")
def dedup_first(spark, d):
    return dedup.first_per_key(events(spark, d, "id", "sourceurl", "source_file"), ["sourceurl"], "source_file", "id").select("id", "sourceurl")


@query("SELECT id, sourceurl FROM (SELECT id, sourceurl, row_number() OVER (PARTITION BY sourceurl ORDER BY source_file DESC, id DESC) AS n FROM gdelt_brazil_events) WHERE n = 1")
def dedup_last(spark, d):
    return dedup.last_per_key(events(spark, d, "id", "sourceurl", "source_file"), ["sourceurl"], "source_file", "id").select("id", "sourceurl")


@query("SELECT title, url FROM (SELECT title, url, row_number() OVER (PARTITION BY title ORDER BY url) AS n FROM g1_articles) WHERE n = 1")
def title_first(spark, d):
    return dedup.first_per_key(articles(spark, d, "title", "url"), ["title"], "url")


_WEEKS = f"SELECT CAST(isoyear({_DATE}) AS INTEGER) AS iso_year, CAST(weekofyear({_DATE}) AS INTEGER) AS iso_week, count(*) AS n FROM g1_articles WHERE {_DATE} IS NOT NULL GROUP BY 1, 2"
_GRID = f"SELECT y.iso_year, CAST(w.w AS INTEGER) AS iso_week, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT iso_year FROM ({_WEEKS})) y CROSS JOIN range(1, 54) w(w) LEFT JOIN ({_WEEKS}) c ON c.iso_year = y.iso_year AND c.iso_week = w.w"


def _weeks(spark, d):
    return weekly.weekly_counts(articles(spark, d, "date_published").select(dates.lenient_date(F.col("date_published")).alias("day")), "day")


@query(_WEEKS)
def weekly_counts(spark, d):
    return _weeks(spark, d)


@query(f"SELECT iso_year, iso_week, n, round(log10(n + 1), 6) AS log_n, nullif(n, 0) AS masked_n FROM ({_GRID})")
def weekly_grid(spark, d):
    return weekly.weekly_grid(_weeks(spark, d)).withColumn("log_n", F.round("log_n", 6))


@query(f"""SELECT CAST(min(n) AS BIGINT) AS low, CAST(trunc(quantile_cont(n, 0.25)) AS BIGINT) AS q25, CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS q50, CAST(trunc(quantile_cont(n, 0.75)) AS BIGINT) AS q75, CAST(max(n) AS BIGINT) AS high FROM ({_GRID})""")
def grid_quantiles(spark, d):
    return weekly.grid_quantiles(weekly.weekly_grid(_weeks(spark, d))).drop("ticks")


@query(f"""WITH q AS ({SQL["grid_quantiles"]}) SELECT DISTINCT unnest([low, q25, q50, q75, high]) AS tick FROM q""")
def grid_ticks(spark, d):
    """The distinct ticks of the colour scale."""
    return weekly.grid_quantiles(weekly.weekly_grid(_weeks(spark, d))).select(F.explode("ticks").alias("tick"))


_QUEUE = f"""SELECT sourceurl, row_number() OVER (ORDER BY first_ingested, sourceurl) AS pos FROM ({_PENDING})"""
_ROBIN = f"""SELECT sourceurl, domain, domain_count, row_number() OVER (ORDER BY turn, domain_count DESC, first) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos) AS turn, count(*) OVER (PARTITION BY domain) AS domain_count, min(pos) OVER (PARTITION BY domain) AS first FROM (SELECT *, {_E} AS domain FROM ({_QUEUE})))"""


def _robin(spark, d):
    return interleave.round_robin(interleave.numbered(_pending(spark, d), ["first_ingested", "sourceurl"], "pos"), "pos")


@query(_ROBIN)
def interleave_domains(spark, d):
    return _robin(spark, d).select("sourceurl", "domain", "domain_count", "place")


@query("""WITH s AS (SELECT id, source_file, domain, CASE WHEN domain = '' OR lag(domain) OVER w IS DISTINCT FROM domain THEN 1 ELSE 0 END AS fresh FROM (SELECT id, source_file, {0} AS domain FROM gdelt_brazil_events) WINDOW w AS (PARTITION BY source_file ORDER BY id)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY source_file ORDER BY id) AS run FROM s),
    k AS (SELECT id, domain, row_number() OVER (PARTITION BY source_file, run ORDER BY id) AS streak, count(*) OVER (PARTITION BY source_file, domain) AS domain_count FROM r)
    SELECT id, streak, 1.5 + CASE WHEN streak >= 3 THEN 3.0 ELSE 0.0 END + CASE WHEN domain <> '' AND domain_count >= 20 THEN 2.0 ELSE 0.0 END AS cooldown_s FROM k""".replace("{0}", _E))
def domain_streak(spark, d):
    """Runs and waits within each source file, the shard of the queue here."""
    e = events(spark, d, "id", "source_file", "sourceurl").select("id", "source_file", url.host(F.col("sourceurl")).alias("domain"))
    e = e.withColumn("domain_count", F.count("*").over(Window.partitionBy("source_file", "domain")))
    run = interleave.cooldown(interleave.streaks(e, "id", partition=["source_file"]))
    return run.select("id", F.col("streak").cast("long").alias("streak"), "cooldown_s")


@query(f"""WITH s AS (SELECT *, CASE WHEN domain = '' OR lag(domain) OVER w IS DISTINCT FROM domain THEN 1 ELSE 0 END AS fresh FROM ({_ROBIN}) WINDOW w AS (ORDER BY place)),
    r AS (SELECT *, sum(fresh) OVER (ORDER BY place) AS run FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY place) AS streak FROM r)
    SELECT sourceurl, place, streak, 1.5 + CASE WHEN streak >= 3 THEN 3.0 ELSE 0.0 END + CASE WHEN domain <> '' AND domain_count >= 20 THEN 2.0 ELSE 0.0 END AS cooldown_s FROM k""")
def queue_streak(spark, d):
    """Runs and waits over the whole queue, in its fair order."""
    run = interleave.cooldown(interleave.streaks(_robin(spark, d), "place"))
    return run.select("sourceurl", "place", "streak", "cooldown_s")


@query("SELECT (SELECT count(*) FROM g1_articles) AS articles, (SELECT count(*) FROM gdelt_brazil_events) AS events, (SELECT count(*) FROM g1_chunks) AS chunks, (SELECT count(embedding) FROM g1_chunks) AS embedded, (SELECT count(*) FROM gdelt_brazil_events WHERE sourceurl IN (SELECT url FROM g1_articles)) AS crawled_events")
def global_counts(spark, d):
    a, e, c = articles(spark, d, "url"), events(spark, d, "sourceurl"), chunks(spark, d, "id", "embedding")
    counts = {"articles": views.row_count(a), "events": views.row_count(e), "chunks": views.row_count(c), "embedded": views.embedded_count(c), "crawled_events": views.events_crawled_too(e, a)}
    return spark.range(1).select(*[df.scalar().alias(name) for name, df in counts.items()])


@query("SELECT date_published, count(*) AS count FROM g1_articles GROUP BY 1")
def count_by_date(spark, d):
    return views.count_by_date(articles(spark, d, "date_published"))


@query("SELECT a.url, count(c.id) AS count FROM g1_articles a LEFT JOIN g1_chunks c ON c.article = a.url GROUP BY 1")
def chunks_by_article(spark, d):
    return views.chunks_by_article(articles(spark, d, "url"), chunks(spark, d, "article"))


@query("SELECT round(avg(n), 6) AS avg FROM (SELECT a.url, count(c.id) AS n FROM g1_articles a LEFT JOIN g1_chunks c ON c.article = a.url GROUP BY 1)")
def avg_chunks(spark, d):
    return views.average_chunks(articles(spark, d, "url"), chunks(spark, d, "article")).select(F.round("avg", 6).alias("avg"))


@query("SELECT sitemap_url, count(*) AS urls_seen, count(*) FILTER (extraction_status = 'ok') AS ok, count(*) FILTER (extraction_status <> 'ok') AS failed FROM g1_articles GROUP BY 1")
def crawl_counters(spark, d):
    return views.crawl_counters(articles(spark, d, "sitemap_url", "extraction_status"))


@query("SELECT count(title_fetch_status) AS processed, count(*) FILTER (title_fetch_status = 'ok') AS success, count(*) FILTER (title_fetch_status <> 'ok') AS failed FROM gdelt_brazil_events")
def fetch_counters(spark, d):
    return views.fetch_counters(events(spark, d, "title_fetch_status"))


@query("SELECT sourceurl, title, sqldate FROM gdelt_brazil_events")
def title_source_date(spark, d):
    return views.title_source_date(events(spark, d, "sourceurl", "title", "sqldate"))


@query(f"SELECT id, sourceurl FROM gdelt_brazil_events WHERE {_E} = 'folha-vixal-ner.noticias.example.br'")
def events_of_host(spark, d):
    return views.events_of_host(events(spark, d, "id", "sourceurl"), "folha-vixal-ner.noticias.example.br")


@query("SELECT g1_article_url AS value, count(*) AS count FROM article_entities x WHERE g1_article_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g1_articles a WHERE a.url = x.g1_article_url) GROUP BY 1")
def fk_orphans(spark, d):
    return views.orphans(table(spark, d, "article_entities", "g1_article_url"), "g1_article_url", articles(spark, d, "url"), "url")


@query("WITH t AS (SELECT range AS t, 378146 + range // 900 AS remote, range // 4 AS local FROM range(1600000)) SELECT min(t) AS t, arg_min(remote, t) AS remote, arg_min(local, t) AS local FROM t WHERE local >= remote")
def growth_catch_up(spark, d):
    return numbers.catch_up(900, 4, 378_146, spark)


@query("SELECT range AS t, 378146 + range // 900 AS remote, range // 4 AS local FROM range(0, 86401, 3600)")
def growth_curve(spark, d):
    return views.growth(spark, 378_146, 900, 4, 86_400)


# Nearest neighbours, entities, ranking

_USABLE = "len(embedding) = 768 AND isfinite(list_sum(CAST(embedding AS DOUBLE[]))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"


def _usable(rows: DataFrame, dims: int = 768) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.where(F.size("embedding") == dims).where(F.abs(total) < F.lit(float("inf")))


def _first_vector(rows: DataFrame):
    """The vector of the row with the least id, as a literal: one row to the driver."""
    return knn.literal_vector(rows.orderBy("id").limit(1).select("embedding").first()[0])


@query(f"""WITH u AS (SELECT id, article, chunk, CAST(embedding AS DOUBLE[]) AS e FROM g1_chunks WHERE {_USABLE}), q AS (SELECT e AS v FROM u ORDER BY id LIMIT 1),
    p AS (SELECT u.id, u.article, a.date_published, list_cosine_similarity(u.e, q.v) AS s FROM u JOIN g1_articles a ON a.url = u.article, q WHERE length(a.text_content) > 200 ORDER BY s DESC, a.date_published DESC NULLS FIRST, u.id LIMIT 20 OFFSET 5)
    SELECT id, article, date_published, round(s, 6) AS similarity FROM p""")
def knn_cosine(spark, d):
    """The flagship: chunks of long articles by similarity to a query vector, one page of 20 after the first 5."""
    usable = _usable(chunks(spark, d))
    chosen = select.searchable_articles(articles(spark, d, "url", "title", "date_published", "text_content"))
    page = knn.in_date_order(knn.search_chunks(usable, chosen, _first_vector(usable), limit=20, offset=5))
    return page.select("id", "article", "date_published", F.round("similarity", 6).alias("similarity"))


SQL["knn_cosine"] = SQL["knn_cosine"].replace(" AND list_bool_or(list_transform(embedding, lambda x: x <> 0))", " AND list_max(list_transform(embedding, lambda x: abs(x))) > 0")


@query("SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings")
def knn_l2(spark, d):
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    vec = knn.literal_vector(rows.where("vec_id = 0").select("embedding").first()[0])
    return knn.by_l2(rows, vec, "embedding", ["vec_id"]).select("vec_id", F.round("distance", 6).alias("distance"))


_LISTS = "SELECT x.g1_article_url AS url, list_sort(list_distinct(list(e.text))) AS ents FROM article_entities x JOIN g1_entities e ON e.id = x.g1_entities_id GROUP BY 1"


@query(f"WITH l AS ({_LISTS}), b AS (SELECT * FROM l ORDER BY url LIMIT 1) SELECT l.url, len(list_intersect(l.ents, b.ents)) AS common_count, array_to_string(list_sort(list_intersect(l.ents, b.ents)), '|') AS common FROM l, b WHERE l.url <> b.url")
def entity_overlap(spark, d):
    lists = entities.entity_lists(table(spark, d, "article_entities", "g1_article_url", "g1_entities_id"), table(spark, d, "g1_entities", "id", "text"))
    out = entities.overlap_with(lists, lists.orderBy("url").limit(1))
    return out.select("url", F.col("common_count").cast("long").alias("common_count"), F.array_join("common", "|").alias("common"))


@query("""SELECT url, array_to_string(list_sort(list_intersect(list_intersect(string_split(a, ' '), string_split(b, ' ')), string_split(c, ' '))), '|') AS shared FROM
    (SELECT url, coalesce(title, '') AS a, coalesce(excerpt, '') AS b, coalesce(sitename, '') || ' de em' AS c FROM g1_articles)""")
def intersect_lists(spark, d):
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    lists = F.array(words(F.col("title")), words(F.col("excerpt")), words(F.concat(F.coalesce("sitename", F.lit("")), F.lit(" de em"))))
    return articles(spark, d, "url", "title", "excerpt", "sitename").select("url", F.array_join(F.array_sort(arrays.intersect_all(lists)), "|").alias("shared"))


@query("""WITH n AS (SELECT DISTINCT trim(unnest(tags)) AS text FROM g1_articles), m AS (SELECT text, 'TAG' AS type FROM n WHERE text <> '' AND (text, 'TAG') NOT IN (SELECT text, type FROM g1_entities WHERE text IS NOT NULL AND type IS NOT NULL))
    SELECT id, text, type FROM g1_entities UNION ALL SELECT (SELECT max(id) FROM g1_entities) + row_number() OVER (ORDER BY text COLLATE "binary"), text, type FROM m""")
def entity_get_or_create(spark, d):
    tags = articles(spark, d, "tags").select(F.explode(text.clean_array(F.col("tags"))).alias("text"), F.lit("TAG").alias("type"))
    return entities.get_or_create(tags, table(spark, d, "g1_entities", "id", "text", "type"))


SQL["entity_get_or_create"] = SQL["entity_get_or_create"].replace(' COLLATE "binary"', "")


@query(f"""WITH l AS ({_LISTS}), v AS (SELECT article AS url, arg_min(CAST(embedding AS DOUBLE[]), id) AS e FROM g1_chunks WHERE {_USABLE} GROUP BY 1), c AS (SELECT l.url, l.ents, v.e FROM l JOIN v ON v.url = l.url),
    b AS (SELECT * FROM c ORDER BY url LIMIT 1), r AS (SELECT c.url, len(list_intersect(c.ents, b.ents)) AS common_count, list_cosine_similarity(c.e, b.e) AS s FROM c, b WHERE c.url <> b.url)
    SELECT url, common_count, round(s, 6) AS similarity, CASE WHEN s >= 0.5 AND common_count >= 2 THEN 'Sim' ELSE 'Não' END AS continuity FROM r""")
def chunk_ranking(spark, d):
    """Articles ranked against one by shared entities and similarity of their first usable chunk's stored vector."""
    lists = entities.entity_lists(table(spark, d, "article_entities", "g1_article_url", "g1_entities_id"), table(spark, d, "g1_entities", "id", "text"))
    nonzero = _usable(chunks(spark, d, "id", "article", "embedding")).where(F.exists("embedding", lambda x: x != 0))
    first = nonzero.groupBy(F.col("article").alias("url")).agg(F.min_by("embedding", "id").alias("embedding"))
    rows = lists.join(first, "url")
    return ranking.ranked(rows, rows.orderBy("url").limit(1)).select("url", "common_count", F.round("similarity", 6).alias("similarity"), "continuity")


@query()
def candidate_ranking(spark, d):
    """Articles ranked against one by shared entities and similarity of hashed text vectors."""
    from tarrafa.models import embed

    lists = entities.entity_lists(table(spark, d, "article_entities", "g1_article_url", "g1_entities_id"), table(spark, d, "g1_entities", "id", "text"))
    texts = embed(articles(spark, d, "url", "text_content").where("text_content is not null"), "text_content", dims=64).select("url", "embedding")
    rows = lists.join(texts, "url")
    return ranking.ranked(rows, rows.orderBy("url").limit(1)).select("url", "common_count", F.round("similarity", 6).alias("similarity"), "continuity")


@query()
def named_entities(spark, d):
    """Mentions found by the offline default extractor."""
    from tarrafa.models import extract_entities

    return extract_entities(articles(spark, d, "url", "text_content"), "url", "text_content")


# Writes with conflict rules, as new snapshots


@query("""WITH o AS (SELECT url, first_seen_at, last_seen_at, sitemap_url FROM g1_articles WHERE fetch_status IS NOT NULL),
    n AS (SELECT url, last_seen_at AS first_seen_at, last_seen_at + INTERVAL 1 DAY AS last_seen_at, 'new' AS sitemap_url FROM g1_articles)
    SELECT n.url, epoch_us(coalesce(o.first_seen_at, n.first_seen_at)) AS first_micros, epoch_us(n.last_seen_at) AS last_micros, n.sitemap_url FROM n LEFT JOIN o ON o.url = n.url""")
def upsert_seed(spark, d):
    """All articles found again, into those that were fetched before."""
    a = articles(spark, d, "url", "first_seen_at", "last_seen_at", "sitemap_url", "fetch_status")
    found = a.select("url", F.col("last_seen_at").alias("first_seen_at"), (F.col("last_seen_at") + F.expr("interval 1 day")).alias("last_seen_at"), F.lit("new").alias("sitemap_url"), F.lit(0).alias("pos"))
    out = upsert.seed_articles(a.where("fetch_status is not null").drop("fetch_status"), found)
    return out.select("url", F.unix_micros("first_seen_at").alias("first_micros"), F.unix_micros("last_seen_at").alias("last_micros"), "sitemap_url")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY source_file, globaleventid, sourceurl ORDER BY globaleventid, id, source_file, sourceurl) AS k FROM gdelt_brazil_events)
    SELECT n.id FROM n WHERE globaleventid IS NULL OR k = 1 AND NOT EXISTS (SELECT 1 FROM gdelt_brazil_events o WHERE o.title_fetch_status IS NOT NULL AND o.source_file = n.source_file AND o.globaleventid = n.globaleventid AND o.sourceurl = n.sourceurl)""")
def insert_ignore(spark, d):
    """All rows into a table of those whose title was fetched; a key with a null never conflicts."""
    e = events(spark, d, "id", "source_file", "globaleventid", "sourceurl", "title_fetch_status")
    return upsert.insert_ignore(e.where("title_fetch_status is not null"), e.drop("title_fetch_status"), ["source_file", "globaleventid", "sourceurl"]).select("id")


@query("""SELECT id, CASE WHEN title_fetch_status = 'no_content' THEN NULL ELSE title END AS title, CASE WHEN title_fetch_status = 'no_content' THEN 'gone' ELSE title_fetch_status END AS status,
    CASE WHEN sourceurl IN (SELECT sourceurl FROM gdelt_brazil_events WHERE title_fetch_status = 'no_content') THEN coalesce(title_fetch_attempts, 0) + 1 ELSE title_fetch_attempts END AS attempts FROM gdelt_brazil_events""")
def record_titles(spark, d):
    """Pages without content found gone at the next fetch: all rows of their addresses change."""
    e = events(spark, d)
    bad = e.where("title_fetch_status = 'no_content'").select("sourceurl").distinct()
    results = bad.select("sourceurl", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("article_content"), F.lit("gone").alias("status"), F.lit(None).cast("string").alias("error"))
    out = upsert.record_titles(e, results, F.lit(NOW).cast("timestamp"))
    return out.select("id", "title", F.col("title_fetch_status").alias("status"), F.col("title_fetch_attempts").alias("attempts"))


SQL["record_titles"] = """WITH b AS (SELECT DISTINCT sourceurl FROM gdelt_brazil_events WHERE title_fetch_status = 'no_content')
    SELECT e.id, CASE WHEN b.sourceurl IS NULL THEN e.title END AS title, CASE WHEN b.sourceurl IS NULL THEN e.title_fetch_status ELSE 'gone' END AS status, CASE WHEN b.sourceurl IS NULL THEN e.title_fetch_attempts ELSE coalesce(e.title_fetch_attempts, 0) + 1 END AS attempts
    FROM gdelt_brazil_events e LEFT JOIN b ON b.sourceurl = e.sourceurl"""


@query("SELECT url, coalesce(is_chunked, false) OR url IN (SELECT article FROM g1_chunks WHERE article IS NOT NULL) AS is_chunked FROM g1_articles")
def mark_chunked(spark, d):
    return upsert.mark_chunked(articles(spark, d, "url", "is_chunked"), chunks(spark, d, "article"))


@query("""SELECT n.sitemap_url, 'x' AS sitemap_lastmod, CASE WHEN n.processed_at IS NOT NULL THEN coalesce(n.urls_in_sitemap, 0) ELSE 0 END AS urls_in_sitemap FROM g1_sitemaps n""")
def discover_sitemaps(spark, d):
    """All sitemaps found again, beside those that were processed before."""
    s = table(spark, d, "g1_sitemaps")
    found = s.select("sitemap_url", F.lit("x").alias("sitemap_lastmod"), "target_date", "discovered_at")
    return upsert.discover_sitemaps(s.where("processed_at is not null"), found).select("sitemap_url", "sitemap_lastmod", "urls_in_sitemap")


@query("""WITH done AS (SELECT sitemap_url, CAST(count(*) AS INTEGER) AS urls, CAST(count(*) FILTER (extraction_status = 'ok') AS INTEGER) AS ok FROM g1_articles WHERE sitemap_url IS NOT NULL GROUP BY 1)
    SELECT coalesce(d.sitemap_url, s.sitemap_url) AS sitemap_url, coalesce(d.urls, s.urls_in_sitemap) AS urls_in_sitemap, CASE WHEN d.sitemap_url IS NULL THEN s.extracted_ok ELSE d.ok END AS extracted_ok, CASE WHEN d.sitemap_url IS NULL THEN s.extracted_failed ELSE d.urls - d.ok END AS extracted_failed
    FROM done d FULL JOIN g1_sitemaps s ON s.sitemap_url = d.sitemap_url""")
def sitemaps_processed(spark, d):
    """Counts of a run over all articles, put over what is stored of their sitemaps."""
    a = articles(spark, d, "url", "sitemap_url", "sitemap_lastmod", "extraction_status").where("sitemap_url is not null")
    outcomes = a.select("url", (F.coalesce("extraction_status", F.lit("")) == "ok").alias("ok"))
    done = crawl.sitemap_counts(a, a, outcomes, date(2024, 1, 1), F.lit(NOW).cast("timestamp"))
    return upsert.mark_sitemaps_processed(table(spark, d, "g1_sitemaps"), done).select("sitemap_url", "urls_in_sitemap", "extracted_ok", "extracted_failed")


# Sources, over texts made of the tables


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("SELECT file_url AS url, file_name FROM processed_files WHERE regexp_matches(file_url, '/gdeltv2/\\d{14}\\.translation\\.export\\.CSV\\.zip$')")
def manifest_lines(spark, d):
    """Manifest lines of all processed files, among others that aren't exports."""
    files = table(spark, d, "processed_files", "file_url")
    lines = files.select(F.explode(F.array(F.concat(F.lit("123 abc  "), "file_url"), F.concat(F.lit("1 "), "file_url"), F.concat(F.lit("1 a "), "file_url", F.lit(".md5")))).alias("value"))
    return readers.manifest(lines)


@query("SELECT sitemap_url AS loc, nullif(trim(sitemap_lastmod), '') AS lastmod FROM g1_sitemaps")
def index_entries(spark, d):
    """All sitemaps, from an index of each target date."""
    s = table(spark, d, "g1_sitemaps", "sitemap_url", "sitemap_lastmod", "target_date")
    entry = F.concat(F.lit("<sitemap><loc> "), _escaped(F.col("sitemap_url")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), _escaped(F.col("sitemap_lastmod")), F.lit("</lastmod>")), F.lit("")), F.lit("</sitemap>"))
    xml = s.groupBy("target_date").agg(F.concat(F.lit("<?xml version='1.0'?>\n<sitemapindex>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</sitemapindex>")).alias("xml"))
    return readers.sitemap_index(xml)


@query("SELECT sitemap_url, url AS loc, nullif(trim(sitemap_article_lastmod, chr(9) || chr(10) || chr(13) || ' ' || chr(160)), '') AS lastmod, nullif(trim(sitemap_image_url), '') AS image_loc FROM g1_articles")
def urlset_entries(spark, d):
    """All articles, from the sitemap of each."""
    a = articles(spark, d, "url", "sitemap_url", "sitemap_article_lastmod", "sitemap_image_url")
    part = lambda tag, c: F.coalesce(F.concat(F.lit(f"<{tag}>"), _escaped(F.col(c)), F.lit(f"</{tag}>")), F.lit(""))
    image = F.when(F.col("sitemap_image_url").isNotNull(), F.concat(F.lit("<image:image>"), part("image:loc", "sitemap_image_url"), F.lit("</image:image>"))).otherwise("")
    xml = a.groupBy("sitemap_url").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url>"), part("loc", "url"), image, part("lastmod", "sitemap_article_lastmod"), F.lit("</url>"))), ""), F.lit("</urlset>")).alias("xml"))
    return readers.sitemap_urlset(xml, keep=("sitemap_url",)).drop("pos")


@query("SELECT id, coalesce(CAST(globaleventid AS VARCHAR), '') AS globaleventid, coalesce(actor1name, '') AS actor1name, coalesce(actiongeo_fullname, '') AS actiongeo_fullname, split_part(sourceurl, chr(9), 1) AS sourceurl FROM gdelt_brazil_events")
def export_lines(spark, d):
    """All events as lines of an export, read back; a tab within an address ends it, as in any such file."""
    from tarrafa.schemas import EVENT_COLUMNS

    e = events(spark, d, "id", *EVENT_COLUMNS)
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EVENT_COLUMNS])
    rows = readers.export_rows(e.select(F.col("id").cast("string").alias("source_file"), F.lit(0).cast("long").alias("line_no"), line.alias("line")))
    return rows.select(F.col("source_file").cast("long").alias("id"), "globaleventid", "actor1name", "actiongeo_fullname", "sourceurl")


@query("""SELECT title, url FROM g1_articles WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(text_content, '')), 'prefeitura') AND contains(lower(coalesce(title, '') || ' ' || coalesce(text_content, '')), 'saúde') ORDER BY url, title LIMIT 10""")
def news_results(spark, d):
    """A news search over the articles: the number of results is the operator's."""
    from tarrafa.sources.news_search import search_news

    results = articles(spark, d, "title", "url", "text_content").withColumnRenamed("text_content", "body")
    return search_news(results, "prefeitura saúde").select("title", "url")
