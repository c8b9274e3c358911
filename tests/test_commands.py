"""Commands run twice: what is done is marked done, and nothing is added or counted twice."""

import hashlib
import io
import json
import zipfile
from datetime import datetime

import pytest

from tarrafa.__main__ import main
from tarrafa.operators.upsert import read_snapshot, write_snapshot
from tarrafa.schemas import ARTICLES, EVENT_COLUMNS, EVENTS
from tarrafa.sources.fetching import HttpStatus, crawler_delay, mirrored, retrying


def page(title, text):
    return f"<html><head><title>{title}</title></head><body><p>{text}</p></body></html>".encode()


@pytest.fixture
def web(tmp_path):
    folder = tmp_path / "web"
    folder.mkdir()

    def put(url, body):
        (folder / hashlib.sha1(url.encode()).hexdigest()).write_bytes(body)

    return str(folder), put


def sitemaps(put):
    put("https://x/sitemap.xml", b"<sitemapindex><sitemap><loc>https://x/2020/01/02_1.xml</loc></sitemap><sitemap><loc>https://x/2020/01/03_1.xml</loc><lastmod>2020-01-03</lastmod></sitemap></sitemapindex>")
    for day in (2, 3):
        urls = "".join(f"<url><loc>https://x/{day}/{i}</loc><lastmod>2020-01-0{day}</lastmod></url>" for i in range(3))
        put(f"https://x/2020/01/0{day}_1.xml", f"<urlset>{urls}<url><loc>https://x/both</loc><lastmod>day {day}</lastmod></url></urlset>".encode())


def test_crawl_keeps_each_sitemaps_own_metadata_and_cap(spark, tmp_path, web, capsys):
    mirror, put = web
    sitemaps(put)
    for i in range(3):
        put(f"https://x/3/{i}", page(f"T{i}", "Corpo da matéria"))
    arts, maps = str(tmp_path / "arts"), f"file://{tmp_path}/maps"
    common = ["crawl", "--root", "https://x", "--articles", arts, "--sitemap-table", maps, "--mirror", mirror, "--request-max-attempts", "1"]
    main([*common, "--max-articles", "1", "--dry-run", "yes"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"sitemaps": 2, "urls": 8, "pending": 2} and read_snapshot(spark, arts) is None
    main([*common, "--max-articles", "1", "--fetch", "yes"])
    rows = {r["url"]: r for r in read_snapshot(spark, arts).collect()}
    assert len(rows) == 7 and rows["https://x/2/0"]["sitemap_url"] == "https://x/2020/01/02_1.xml" and rows["https://x/3/0"]["sitemap_lastmod"] == "2020-01-03"
    assert rows["https://x/both"]["sitemap_article_lastmod"] == "day 2"  # the older sitemap is worked through last
    assert rows["https://x/3/0"]["title"] == "T0" and rows["https://x/3/0"]["extraction_status"] == "ok" and rows["https://x/3/0"]["fetch_attempts"] == 1
    assert (rows["https://x/2/0"]["fetch_status"], rows["https://x/2/0"]["http_status"]) == ("not_found", 404)
    counted = {r["sitemap_url"][-8:-6]: (r["urls_in_sitemap"], r["extracted_ok"], r["extracted_failed"]) for r in read_snapshot(spark, maps).collect()}
    assert counted == {"02": (4, 0, 1), "03": (4, 1, 0)}
    main([*common, "--fetch", "yes"])
    rows = {r["url"]: r for r in read_snapshot(spark, arts).collect()}
    assert len(rows) == 7 and rows["https://x/3/0"]["fetch_attempts"] == 1 and rows["https://x/2/0"]["fetch_attempts"] == 2 and rows["https://x/3/2"]["title"] == "T2"


def test_index_is_looked_for_in_the_usual_places(spark, tmp_path, web):
    mirror, put = web
    put("https://x/index.xml", b"<sitemapindex/>")
    main(["crawl", "--root", "https://x", "--articles", str(tmp_path / "a"), "--mirror", mirror, "--request-max-attempts", "1"])
    with pytest.raises(SystemExit):
        main(["crawl", "--root", "https://none", "--articles", str(tmp_path / "a"), "--mirror", mirror, "--request-max-attempts", "1"])


def export(url, n):
    line = "\t".join(str(n) if c == "globaleventid" else url if c == "sourceurl" else "" for c in EVENT_COLUMNS)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.csv", line + "\n")
    return out.getvalue()


def test_ingest_by_manifest(spark, tmp_path, web):
    mirror, put = web
    names = [f"2020010{d}000000.translation.export.CSV.zip" for d in (1, 2, 3)]
    urls = [f"http://data/gdeltv2/{n}" for n in names]
    (tmp_path / "master.txt").write_text("".join(f"1 a {u}\n" for u in urls))
    for i, u in enumerate(urls):
        if i != 1:  # one can't be fetched yet
            put(u, export(f"https://a.br/{i}", i))
    out = str(tmp_path / "events")
    run = ["ingest-events", "--manifest", str(tmp_path / "master.txt"), "--out", out, "--mirror", mirror, "--request-max-attempts", "1", "--poll-interval-seconds", "0"]
    main([*run, "--bootstrap-latest-files", "2"])
    stored = lambda: sorted(r["source_file"] for r in spark.read.parquet(out).collect())
    ledger = lambda: sorted(r["file_name"] for r in spark.read.parquet(out + "_processed_files").collect())
    assert stored() == ledger() == [names[2]]
    put(urls[1], export("https://a.br/1", 1))
    main([*run, "--polls", "2"])
    assert stored() == ledger() == names


def test_landing_writes_its_ledger(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    for i in range(2):
        (tmp_path / f"landing/f{i}.zip").write_bytes(export(f"https://a.br/{i}", i))
    out = str(tmp_path / "events")
    for _ in range(2):
        main(["ingest-events", "--landing", str(tmp_path / "landing"), "--out", out])
        assert spark.read.parquet(out).count() == 2 and spark.read.parquet(out + "_processed_files").count() == 2


def test_chunks_embeddings_and_entities_twice(spark, tmp_path):
    arts, chunks, vectors, names = (str(tmp_path / n) for n in ("arts", "chunks", "vectors", "names"))
    row = {f.name: None for f in ARTICLES.fields}
    write_snapshot(spark.createDataFrame([row | {"url": "u1", "title": "t", "text_content": "A polícia prendeu João da Silva. " * 60}, row | {"url": "u2", "text_content": ""}], ARTICLES), arts)
    seen = set()
    for _ in range(2):
        main(["populate-chunks", "--articles", arts, "--out", chunks])
        main(["populate-embeddings", "--chunks", chunks, "--out", vectors])
        main(["populate-entities", "--articles", arts, "--out", names])
        seen.add((spark.read.parquet(chunks).count(), spark.read.parquet(vectors).count(), spark.read.parquet(names).count()))
    assert len(seen) == 1 and min(*seen) > 0
    assert {r["url"]: r["is_chunked"] for r in read_snapshot(spark, arts).collect()} == {"u1": True, "u2": False}
    main(["search", "--chunks", chunks, "--embeddings", vectors, "--articles", arts, "--query", "polícia"])


def test_backfill_stores_what_it_fetches(spark, tmp_path, web, capsys):
    mirror, put = web
    put("https://a.br/1", page("Título", "Texto da página"))
    put("https://a.br/2", b'<html><script type="application/ld+json">{"headline": "De JSON", "articleBody": "Corpo"}</script></html>')
    row = {f.name: None for f in EVENTS.fields} | {"ingested_at": datetime(2020, 1, 1)}
    events = str(tmp_path / "events")
    write_snapshot(spark.createDataFrame([row | {"id": i, "sourceurl": f"https://a.br/{i}"} for i in (1, 2, 3)], EVENTS), events)
    for _ in range(2):
        main(["backfill", "--events", events, "--mirror", mirror, "--wait", "no", "--request-max-attempts", "1", "--now", "2024-01-01T00:00:00"])
        got = {r["id"]: (r["title"], r["article_content"], r["title_fetch_status"], r["title_fetch_attempts"]) for r in read_snapshot(spark, events).collect()}
        assert got == {1: ("Título", "Texto da página", "ok", 1), 2: ("De JSON", "Corpo", "ok", 1), 3: (None, None, "not_found", 1)}


def test_options_from_the_environment(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TARRAFA_OUT", str(tmp_path / "dims"))
    main(["populate-dims"])
    assert spark.read.parquet(str(tmp_path / "dims/column_dictionary")).count() == 23


def test_crawler_delays(tmp_path):
    assert crawler_delay(1, 2.0, 60.0, lambda: -5.0) == 1.0 and crawler_delay(10, 2.0, 60.0, lambda: 0.5) == 60.5
    waits = []
    with pytest.raises(HttpStatus):
        retrying(mirrored(str(tmp_path)), 3, sleep=waits.append, delay_of=lambda n: float(n))("https://x")
    assert waits == [1.0, 2.0]
