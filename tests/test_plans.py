import gzip
import io
import json
import os
import zipfile
import zlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarrafa import dims, models
from tarrafa.plans import backfill, crawl, ingest, ranking
from tarrafa.plans.search import Request, SearchService, wsgi
from tarrafa.schemas import ARTICLES, EVENT_COLUMNS, EVENTS
from tarrafa.sources import news_search, readers
from tarrafa.streaming import ingest as streaming


def export_line(**values) -> str:
    return "\t".join(str(values.get(c, "")) for c in EVENT_COLUMNS)


def write_zip(path, lines) -> None:
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.CSV", "\n".join(lines) + "\n")


def test_manifest(spark):
    lines = ["1 abc http://x/gdeltv2/20240101000000.translation.export.CSV.zip", "1 abc http://x/gdeltv2/20240101000000.export.CSV.zip", "two fields", "", "  9  d  http://y/gdeltv2/20240101001500.translation.export.CSV.zip "]
    got = readers.manifest(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["file_name"] for r in got] == ["20240101000000.translation.export.CSV.zip", "20240101001500.translation.export.CSV.zip"]


def test_exports_and_ingest(spark, tmp_path):
    write_zip(tmp_path / "1.zip", [export_line(globaleventid="5", sourceurl="https://a.com.br/x", quadclass="1", avgtone="-2.5"), export_line(globaleventid="6", sourceurl="https://a.com.br/x"), export_line(globaleventid="7.5", sourceurl="https://b.br/y", actor1name='"say ""hi"""'), export_line(globaleventid="8", sourceurl="https://c.com/z"), "short\trow"])
    raw = readers.read_exports(spark, str(tmp_path / "*.zip"))
    assert raw.count() == 5
    fresh = ingest.new_events(raw, spark.createDataFrame([], EVENTS), datetime(2024, 1, 1))
    got = {r["sourceurl"]: r for r in fresh.collect()}
    assert set(got) == {"https://a.com.br/x", "https://b.br/y"}
    assert got["https://a.com.br/x"]["globaleventid"] == 5 and got["https://a.com.br/x"]["avgtone"] == -2.5 and got["https://a.com.br/x"]["actor1name"] == ""
    assert got["https://b.br/y"]["globaleventid"] is None and got["https://b.br/y"]["actor1name"] == 'say "hi"'
    assert ingest.new_events(raw, fresh, datetime(2024, 1, 1)).count() == 0


def test_stream_is_exactly_once(spark, tmp_path):
    landing, root, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    os.makedirs(landing)
    write_zip(landing / "a.zip", [export_line(globaleventid="1", sourceurl="https://a.br/1"), export_line(globaleventid="2", sourceurl="https://a.br/2")])
    streaming.ingest_stream(spark, str(landing), root, ck).awaitTermination()
    write_zip(landing / "b.zip", [export_line(globaleventid="3", sourceurl="https://a.br/2"), export_line(globaleventid="4", sourceurl="https://a.br/3")])
    for _ in range(2):
        streaming.ingest_stream(spark, str(landing), root, ck).awaitTermination()
    assert sorted(r["sourceurl"] for r in streaming.stored_events(spark, root).collect()) == ["https://a.br/1", "https://a.br/2", "https://a.br/3"]


INDEX = '<?xml version="1.0"?><sitemapindex xmlns="x"><sitemap><loc> https://x/1.xml </loc><lastmod>2026-04-13</lastmod></sitemap><sitemap><lastmod>2026</lastmod></sitemap><sitemap><loc>https://x/2.xml?a=1&amp;b=2</loc><lastmod></lastmod></sitemap></sitemapindex>'
URLSET = '<s:urlset xmlns:s="x" xmlns:image="y"><s:url><s:loc>https://x/a</s:loc><s:lastmod>2026-04-13T00:00:00Z</s:lastmod><image:image><image:loc>https://i/1</image:loc></image:image><image:image><image:loc>https://i/2</image:loc></image:image></s:url><s:url><image:image><image:loc>https://i/3</image:loc></image:image></s:url><s:url><s:loc>https://x/b</s:loc></s:url></s:urlset>'


def test_sitemaps(spark, tmp_path):
    df = spark.createDataFrame([(INDEX,), (URLSET,), ("<html/>",), (None,), ("",)], "xml string")
    assert [tuple(r) for r in readers.sitemap_index(df).collect()] == [("https://x/1.xml", "2026-04-13"), ("https://x/2.xml?a=1&b=2", None)]
    assert [tuple(r) for r in readers.sitemap_urlset(df).collect()] == [(0, "https://x/a", "2026-04-13T00:00:00Z", "https://i/2"), (2, "https://x/b", None, None)]
    (tmp_path / "s.xml.bin").write_bytes(gzip.compress(INDEX.encode()))
    assert readers.sitemap_index(readers.read_xml(spark, str(tmp_path))).count() == 2
    newest = crawl.newest_sitemaps(readers.sitemap_index(df), until=date(2026, 4, 12)).collect()
    assert [r["loc"] for r in newest] == ["https://x/2.xml?a=1&b=2"]


def test_bodies():
    for packed in (gzip.compress(b"hi"), zlib.compress(b"hi"), zlib.compress(b"hi")[2:-4], b"hi"):
        assert readers.decompressed(packed) == b"hi"


def test_candidates_and_documents(spark, tmp_path):
    (tmp_path / "c.csv").write_text('"A, b e c",https://x/1\nD,https://x/2\n')
    assert [tuple(r) for r in readers.read_candidates(spark, str(tmp_path / "c.csv")).collect()] == [("A, b e c", "https://x/1"), ("D", "https://x/2")]
    os.makedirs(tmp_path / "docs")
    (tmp_path / "docs" / "a.txt").write_text("Title | Site |Body | with bar\nmore")
    got = readers.read_documents(spark, str(tmp_path / "docs")).first()
    assert (got["title"], got["site"], got["body"]) == ("Title", "Site", "Body | with bar\nmore")


def test_news_search(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text("\n".join(json.dumps(r) for r in [{"title": "INSS e PF", "url": "https://g1.x/1", "body": "a"}, {"title": "outro", "url": "https://g1.x/2", "body": "b"}]))
    news_search.register(spark)
    got = spark.read.format("news_search").option("path", str(tmp_path / "n.jsonl")).option("query", "inss").option("site", "g1.x").load()
    assert [r["url"] for r in got.collect()] == ["https://g1.x/1"]


def test_crawl(spark):
    found = spark.createDataFrame([("https://x/a", "m", None, 0), ("https://x/b", "m", None, 1), ("https://x/b", "n", "i", 2)], "loc string, lastmod string, image_loc string, pos int")
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    stored = spark.createDataFrame([], ARTICLES)
    articles, todo = crawl.crawl(stored, crawl.seeds(found, F.lit("s"), F.lit("l"), now))
    assert {(r["url"], r["sitemap_article_lastmod"]) for r in articles.collect()} == {("https://x/a", "m"), ("https://x/b", "n")}
    assert todo.count() == 3
    done = articles.withColumns({"extraction_status": F.lit("ok"), "text_content": F.lit("t")})
    assert crawl.pending_articles(crawl.seeds(found, F.lit("s"), F.lit("l"), now), done).count() == 0


def test_backfill(spark):
    rows = [(f"https://{d}.br/{i}", None, None, None, None, None, datetime(2020, 1, 1 + i)) for i, d in enumerate(["a", "a", "b", "a"])]
    events = spark.createDataFrame(rows, "sourceurl string, title string, article_content string, title_fetch_attempts int, title_next_retry_at timestamp, title_fetch_status string, ingested_at timestamp")
    queue = backfill.fetch_queue(events, datetime(2024, 1, 1)).orderBy("place").collect()
    assert [r["domain"] for r in queue] == ["a.br", "b.br", "a.br", "a.br"] and [r["streak"] for r in queue] == [1, 1, 1, 2]
    pages = spark.createDataFrame([("u", "u", 200, "<title>T</title><p>Body text</p><script>no</script>", None), ("v", "v/login", 200, "<title>T</title>", None), ("w", None, None, None, "timeout"), ("x", "x", 404, "", None), ("y", "y", 200, "<p>only</p>", None), ("z", "z", 200, "<title>T</title>", None)], "url string, final_url string, http_status int, html string, error string")
    got = {r["sourceurl"]: (r["title"], r["article_content"], r["status"]) for r in backfill.page_results(pages).collect()}
    assert got["u"] == ("T", "Body text", "ok") and got["v"][2] == "login_required" and got["w"][2] == "download_failed" and got["x"] == (None, None, "not_found")
    assert got["y"][2] == "no_title" and got["z"][2] == "no_content"


@pytest.fixture(scope="module")
def service(spark):
    articles = spark.createDataFrame([("u1", "INSS fraude", "2024-01-02", "x" * 300), ("u2", "Chuva", None, "y" * 300), ("u3", "curta", "2024-01-01", "z")], "url string, title string, date_published string, text_content string")
    chunks = models.embed(spark.createDataFrame([(1, "u1", "fraude no inss"), (2, "u2", "chuva forte"), (3, "u3", "fraude no inss"), (4, "u1", "outra coisa")], "id long, article string, chunk string"), "chunk")
    return SearchService(chunks, articles)


def test_search(service):
    got = service.search(Request("fraude inss", limit=2))
    assert got["results"][0]["article_url"] == "u1" and got["total"] == 2 and all(r["article_url"] != "u3" for r in got["results"])
    assert service.search(Request("fraude", date_from="2024-01-01"))["total"] == 2
    assert [r["chunk"] for r in service.search(Request("fraude no inss", limit=1))["results"]] == ["fraude no inss"]


def test_http(service):
    def call(path, query):
        out = {}
        body = b"".join(wsgi(service)({"PATH_INFO": path, "QUERY_STRING": query}, lambda s, h: out.update(status=s)))
        return out["status"], json.load(io.BytesIO(body))

    assert call("/search", "query=")[0].startswith("400") and call("/search", "query=a&limit=x")[0].startswith("400") and call("/", "")[0].startswith("404")
    assert call("/search", "query=chuva&limit=1")[1]["limit"] == 1
    assert call("/search", "query=chuva&limit=1000000")[0].startswith("400")


def test_ranking(spark):
    rows = spark.createDataFrame([("b", ["x", "y"], [1.0, 0.0]), ("c", ["x", "y"], [1.0, 0.0]), ("d", ["z"], [0.0, 0.0])], "url string, ents array<string>, embedding array<double>")
    got = ranking.ranked(rows, rows.where("url = 'b'")).collect()
    assert [(r["url"], r["common_count"], r["continuity"]) for r in got] == [("c", 2, "Sim"), ("d", 0, "Não")]


def test_models(spark):
    df = spark.createDataFrame([("u", "A polícia prendeu João da Silva. Depois, o INSS negou."), ("v", None), ("w", "")], "url string, t string")
    found = {(r["text"], r["type"]) for r in models.extract_entities(df, "url", "t").collect()}
    assert ("João da Silva", "MISC") in found and ("INSS", "ORG") in found
    assert [r["embedding"] is None for r in models.embed(df, "t", dims=8).orderBy("url").collect()] == [False, True, False]


def test_dims(spark):
    assert [dims.quad_class(spark).count(), dims.geo_type(spark).count(), dims.root_event(spark).count(), dims.column_dictionary(spark).count()] == [4, 5, 20, 23]
