"""Hot sites, lines and pages, numbering in buckets, and lookups with and without broadcasts."""

from pyspark.sql import functions as F

from tarrafa.llm import repeated_lines

SCHEMA = "id long, sourceurl string, article_content string"


def data():
    rows = [(i, f"https://hot.br/{i % 900}", f"Assine já\nTexto {i}\n ASSINE  JÁ ") for i in range(1800)]
    rows += [(5000 + i, "https://hot.br/same", f"Única linha\nTexto {i}") for i in range(600)]
    return rows + [(8000 + i, f"https://s{i % 40}.br/{i}", f"linha {i % 3}\nTexto {i}") for i in range(800)]


def brute(rows):
    pages, every = {}, []
    for i, u, t in rows:
        for n, line in enumerate(t.split("\n"), 1):
            k = (u.split("/")[2], " ".join(line.split()).lower())
            pages.setdefault(k, set()).add(u)
            every.append((i, n, k))
    return {(i, n, len(pages[k])) for i, n, k in every if len(pages[k]) >= 6}


def test_hot_groups_in_every_way_of_joining(spark, monkeypatch):
    df = spark.createDataFrame(data(), SCHEMA)
    want = brute(data())
    assert {tuple(r) for r in repeated_lines.repeated_lines(df).collect()} == want
    monkeypatch.setattr(repeated_lines, "NUMBERING_ROWS", 64)
    looked_up = repeated_lines.looked_up
    monkeypatch.setattr(repeated_lines, "looked_up", lambda lines, wanted: looked_up(lines, wanted, limit=0, hot_lines=4))
    assert {tuple(r) for r in repeated_lines.repeated_lines(df).collect()} == want


def test_bitmaps_hold_each_page_once(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    lines = repeated_lines.text_lines(df, "id", "sourceurl", "article_content")
    bits = repeated_lines.page_bitmaps(lines)
    hot = bits.groupBy("_site", "_line").agg(F.sum(F.bit_count("_bits")).alias("n"), F.count("*").alias("words"), F.min("_bits").alias("low"), F.max("_bits").alias("high")).orderBy(F.desc("n")).first()
    assert hot["n"] == 900 and hot["words"] == 15


def test_deletion_beyond_a_word_of_the_bitmap(spark):
    texts = ["fim\n" + "\n".join(f"linha {i} {j}" for j in range(200)) + "\nfim\nFIM " for i in range(8)]
    df = spark.createDataFrame([(i, f"https://a.br/{i}", t) for i, t in enumerate(texts)], SCHEMA)
    got = {r["id"]: r["article_content"] for r in repeated_lines.remove_lines(df).collect()}
    assert got == {i: "\n".join(f"linha {i} {j}" for j in range(200)) for i in range(8)}
