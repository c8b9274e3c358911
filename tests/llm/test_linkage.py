"""The persisted index: what a batch reads, merged generations, hot sites; and the learnt score."""

import pytest
from pyspark.sql import functions as F

from tarrafa.llm import linkage
from tarrafa.session import folder_bytes, names

ORDER = ["source_file", "id"]


def addresses(spark, first, n, file):
    """n rows of different pages, every tenth one sent again under another scheme."""
    i = F.col("id")
    word = lambda k: F.substring(F.sha2(F.concat_ws("-", (i - (i % 10 == 9).cast("int") - first + F.xxhash64(F.lit(file)) % 1000003).cast("string"), F.lit(k)), 256), 1, 7)
    url = F.concat(F.when(i % 10 == 9, "http").otherwise("https"), F.lit("://s"), (i % 3).cast("string") * 0, F.lit(".br/"), F.concat_ws("-", *[F.regexp_replace(word(k), r"\\d", "z") for k in range(6)]))
    return spark.range(first, first + n).select(F.lit(file).alias("source_file"), "id", url.alias("sourceurl"))


def test_the_score_makes_no_mistake_on_what_it_learnt():
    b, wc, ws = linkage.fit_weights()
    assert all((b + wc * c + ws * s >= 0) == bool(y) for c, s, y in linkage.labelled_pairs())
    assert wc > 0 > ws
    assert sum(y for *_, y in linkage.labelled_pairs()) > 200


def test_what_a_batch_reads_follows_its_size(spark, tmp_path):
    index = linkage.PageIndex(spark, f"{tmp_path}/i", ORDER, bucket_rows=64, fan=2)
    read = {}
    for turn, n in enumerate((2_000, 10, 18_000, 10)):
        out = index.ingest(addresses(spark, 1_000_000 * turn, n, f"f{turn}"))
        assert out.where("is_duplicate").count() == n // 10
        read[turn] = sum(folder_bytes(spark, p) for p in index.opened)
    history = folder_bytes(spark, f"{tmp_path}/i/keys") + folder_bytes(spark, f"{tmp_path}/i/variants")
    # Nine times the history, in two large generations instead of one: each is opened at the batch's own folders.
    assert read[3] < 2.5 * read[1] and read[3] < history / 50, (read, history)


def test_generations_are_merged_and_say_the_same(spark, tmp_path):
    data = [(f"f{i // 8:02d}", i, f"https://s.br/{i % 40 // 20}/" + "-".join(f"w{(i * k) % 5}{chr(97 + k)}" for k in range(1, 6 + i % 3))) for i in range(56)]
    df = spark.createDataFrame(data, "source_file string, id long, sourceurl string")
    whole = {tuple(r) for r in linkage.duplicates(df, ORDER).collect()}
    found = set()
    for i in range(7):
        index = linkage.PageIndex(spark, f"{tmp_path}/i", ORDER, bucket_rows=16, fan=3)
        found |= {tuple(r)[:2] for r in index.ingest(df.where(F.col("source_file") == f"f{i:02d}")).where("is_duplicate").collect()}
    assert found == whole != set()
    assert len(index.state["live"]) <= 4 and sum(g["rows"]["variants"] for g in index.state["live"]) <= 56
    assert len(names(spark, f"{tmp_path}/i/keys")) <= 4 + 2 * 3
    assert {tuple(r) for r in linkage.duplicates(df, ORDER, groups=2).collect()} == whole


def test_one_site_whose_addresses_share_a_long_word(spark):
    data = [("f", i, f"https://big.br/desenvolvimento-{chr(97 + i % 26)}{i // 26:03d}x-{i * 7919 % 1009}q-{i * 31 % 997}k") for i in range(3000)]
    df = spark.createDataFrame([(f, i, u.translate(str.maketrans("0123456789", "ghijklmnop"))) for f, i, u in data], "source_file string, id long, sourceurl string")
    v = linkage.variants(linkage.parsed_rows(df, ORDER, "sourceurl"), ORDER)
    pairs = v.select(F.explode("_keys").alias("k")).groupBy("k").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert pairs < 10 * 3 * v.count()  # not the square
    assert linkage.duplicates(df, ORDER).count() == 0


def test_odd_tables(spark):
    schema = "source_file string, id long, sourceurl string, _variant string, _words int"
    df = spark.createDataFrame([(None, 1, None, "a", 1), ("f", 2, None, "a", 1), ("f", 3, "", "a", 1), ("f", 4, "https://a.br/" + "x-" * 5000 + "y", "a", 1), ("g", 5, "http://a.br/" + "x-" * 5000 + "y/", "a", 1), ("g", 5, "http://a.br/" + "x-" * 5000 + "y/", "a", 1)], schema)
    for groups in (1, 3):
        assert sorted(r["id"] for r in linkage.duplicates(df, ORDER, groups=groups).collect()) == [2, 3, 5, 5]
    assert linkage.duplicates(df.limit(0), ORDER, groups=3).count() == 0 and linkage.pages(df.limit(0), ORDER).count() == 0
    with pytest.raises(ValueError):
        linkage.duplicates(df, ORDER, threshold=0.5)
