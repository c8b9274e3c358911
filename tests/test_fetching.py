import gzip

import pytest

from tarrafa.__main__ import main
from tarrafa.sources import fetching, readers, tables


def test_retries_back_off():
    calls, waits = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 4:
            raise OSError("getaddrinfo failed" if len(calls) == 1 else "reset")
        return b"x", url, 200

    assert fetching.retrying(get, 6, 2.0, 90.0, 1.5, sleep=waits.append, rand=lambda: 0.0)("u") == (b"x", "u", 200)
    assert waits == [5.0, 4.0, 8.0]
    calls.clear()

    def gone(url):
        calls.append(url)
        raise fetching.HttpStatus(404)

    with pytest.raises(fetching.HttpStatus):
        fetching.retrying(gone, 6, final=(403, 404), sleep=waits.append)("u")
    assert len(calls) == 1


def test_page_labels():
    def get(url):
        if url.startswith("http://"):
            raise fetching.HttpStatus(503)
        return gzip.compress("olá".encode("utf-8")), url, 200

    assert fetching.page(get, "http://x/a") == ("olá", "https://x/a", "ok", None)
    assert fetching.page(get, "http://x/login")[2] == "login_required"
    assert fetching.page(lambda u: (b"", u, 410), "https://x")[2] == "gone"
    assert fetching.page(lambda u: (b"", u, 500), "https://x")[2] == "server_error"
    assert fetching.decoded("é".encode("latin-1"), "text/html; charset=latin-1") == "é" and fetching.decoded(b"\xff", "text/html; charset=nope") == "�"


def test_fetch_keeps_errors(spark):
    def get(url):
        if url == "bad":
            raise ValueError("no")
        return b"x", url, 200, None

    got = {r["url"]: (r["http_status"], r["error"]) for r in readers.fetch(spark.createDataFrame([("ok",), ("bad",)], "url string"), get).collect()}
    assert got == {"ok": (200, None), "bad": (None, "ValueError: no")}


def test_tables(spark, tmp_path):
    root = str(tmp_path / "db")
    assert set(tables.create_tables(spark, root)) == set(tables.TABLES) and tables.create_tables(spark, root) == []
    assert "title" in tables.with_columns(spark.range(1), tables.TABLES["g1_articles"]).columns


def test_command_line(spark, tmp_path):
    main(["populate-dims", "--out", str(tmp_path / "dims")])
    assert spark.read.parquet(str(tmp_path / "dims/root_event")).count() == 20
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps/index.xml").write_text("<sitemapindex><sitemap><loc>https://x/a.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "maps/a.xml").write_text("<urlset><url><loc>https://x/1</loc></url></urlset>")
    for dry in ("yes", "no"):
        main(["crawl", "--sitemaps", str(tmp_path / "maps"), "--articles", str(tmp_path / "articles"), "--dry-run", dry])
    from tarrafa.operators.upsert import read_snapshot

    assert [r["url"] for r in read_snapshot(spark, str(tmp_path / "articles")).collect()] == ["https://x/1"]
    with pytest.raises(SystemExit):
        main(["search"])
