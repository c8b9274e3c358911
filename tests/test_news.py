"""The news connector over a folder of results and over a table, as brute force finds them."""

import json

from tarrafa.sources import news_search

ROWS = [{"title": f"INSS {i}", "url": f"https://{'g1' if i % 2 else 'x'}.br/{i}", "body": "Fraude" if i % 3 else None} for i in range(12)] + [{"title": None, "url": None, "body": None}]


def test_partitions_and_tables(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"p{part}.jsonl").write_text("\n".join(json.dumps(r) for r in ROWS[part::3]))
    news_search.register(spark)
    want = sorted(r["url"] for r in ROWS if "g1" in (r["url"] or "") and r["body"])
    loaded = spark.read.format("news_search").option("path", str(tmp_path)).option("query", "inss fraude").option("site", "g1.br").load()
    assert loaded.rdd.getNumPartitions() == 3 and sorted(r["url"] for r in loaded.collect()) == want
    table = spark.createDataFrame([(r["title"], r["url"], r["body"]) for r in ROWS], "title string, url string, body string")
    assert [r["url"] for r in news_search.search_news(table, "fraude INSS", "g1.br").collect()] == want
    assert [r["url"] for r in news_search.search_news(table, "", "", 2).collect()] == sorted(r["url"] for r in ROWS if r["url"])[:0] + [None, "https://g1.br/1"]
    assert news_search.search_news(table.limit(0), "x").count() == 0
