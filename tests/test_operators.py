from collections import deque
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarrafa.functions import arrays, dates, numbers, retry, text, url, vector
from tarrafa.operators import dedup, entities, interleave, knn, select, upsert, views, weekly

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items())
    return spark.createDataFrame([tuple(v for v, _ in values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "address, host, site",
    [("HTTP://User:p@Www.Folha.COM.br:80/x", "www.folha.com.br", "folha.com.br"), (" https://m.a_b.br/x|y z ", "m.a_b.br", "a_b.br"), ("https://www.m.x.br", "www.m.x.br", "m.x.br"), ("nope", "", ""), ("", "", ""), (None, None, None), (" http://x.br.\t", "x.br", "x.br")],
)
def test_hosts(spark, address, host, site):
    assert one(spark, url.host(F.col("u")), u=(address, "string")) == host
    assert one(spark, url.site(F.col("u")), u=(address, "string")) == site


def test_allowed(spark):
    rows = [("https://x.com.br/a", True), ("https://g1.globo.com/a", True), ("https://www.globo.com/a", False), ("https://x.com/a", False), (None, False)]
    df = spark.createDataFrame(rows, "u string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", url.allowed_source(F.col("u"))).collect())


def test_text_functions(spark):
    assert one(spark, text.html_title(F.col("h")), h=("<TITLE a='b'>\n A &amp; B &lt;x&gt;\t c </TITLE>", "string")) == "A & B <x> c"
    assert one(spark, text.html_title(F.col("h"), True), h=("<title>caf&eacute; &#8211; x</title>", "string")) == "café – x"
    assert one(spark, text.html_title(F.col("h")), h=("<p>none</p>", "string")) is None
    assert one(spark, text.text_array(F.col("h")), h=(" a, ,b ,", "string")) == ["a", "b"]
    assert one(spark, text.text_array(F.col("h")), h=(" , ", "string")) is None
    header = text.chunk_header(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert one(spark, header, a=(None, "string"), b=("2020", "string"), c=("", "string"), d=(["x", "y"], "array<string>")) == "Título: None\nPublicado: 2020\nCategorias: x, y\n\n"


@QUICK
@given(st.text(alphabet="ab é\n", max_size=60))
def test_chunks_put_together(spark, s):
    got = one(spark, text.chunks(F.col("t"), 10, 3), t=(s, "string"))
    assert "".join(c if i == 0 else c[3:] for i, c in enumerate(got)) == s
    assert all(len(c) <= 10 for c in got) and (len(got) == 0) == (s == "")


def test_numbers(spark):
    for raw, whole, real in [("12", 12, 12.0), ("3.7", None, 3.7), ("1e3", 1000, 1000.0), ("", None, None), ("abc", None, None), (" 5 ", 5, 5.0), ("9007199254740993", 9007199254740993, 9007199254740992.0), (None, None, None)]:
        assert one(spark, numbers.lenient_integer(F.col("v")), v=(raw, "string")) == whole
        assert one(spark, numbers.lenient_double(F.col("v")), v=(raw, "string")) == real


def test_sitemap_sort_key(spark):
    rows = [("https://x/2026/04/13_1.xml", "2026-04-13T10:00:00Z"), ("https://x/2026/04/13_2.xml", None), ("https://x/a.xml", None), ("https://x/b.xml", "2026-04-13"), ("https://x/2026/04/14_7.xml", "junk")]
    got = [tuple(r["k"]) for r in spark.createDataFrame(rows, "l string, m string").select(dates.sitemap_sort_key(F.col("l"), F.col("m")).alias("k")).collect()]
    assert got == [(datetime(2026, 4, 13, 10), 0), (datetime(2026, 4, 13), 2), (datetime(1970, 1, 1), 0), (datetime(2026, 4, 13), 0), (datetime(2026, 4, 14), 7)]


@QUICK
@given(st.integers(1, 500), st.sampled_from(["server_error", "no_title", "rate_limited", "x", None]))
def test_retry_grows_and_is_bounded(spark, attempts, status):
    a = one(spark, retry.retry_seconds(F.col("s"), F.col("a")), s=(status, "string"), a=(attempts, "int"))
    b = one(spark, retry.retry_seconds(F.col("s"), F.col("a")), s=(status, "string"), a=(attempts + 1, "int"))
    assert a <= b <= 24 * 3600


def test_vectors(spark):
    v = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=(a, "array<float>"), b=(b, "array<float>"))
    assert v(vector.cosine, [1.0, 0.0], [1.0, 1.0]) == pytest.approx(2**-0.5)
    assert v(vector.cosine, [0.0, 0.0], [1.0, 1.0]) is None and v(vector.cosine, [1.0], [1.0, 1.0]) is None and v(vector.cosine, None, [1.0]) is None
    assert v(vector.l2, [0.0, 3.0], [4.0, 0.0]) == 5.0


@QUICK
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=4), max_size=4))
def test_intersect_all(spark, lists):
    want = set.intersection(*map(set, lists)) if lists else set()
    got = one(spark, arrays.intersect_all(F.col("l")), l=(lists, "array<array<string>>"))
    assert set(got) == want and len(got) == len(want)


@QUICK
@given(st.lists(st.sampled_from(["a", "b", "c", ""]), min_size=1, max_size=25))
def test_round_robin_is_the_deque_model(spark, domains):
    rows = [(i, f"https://{d}/x{i}" if d else f"x{i}") for i, d in enumerate(domains)]
    got = [r["pos"] for r in interleave.round_robin(spark.createDataFrame(rows, "pos long, sourceurl string"), "pos").orderBy("place").collect()]
    buckets: dict[str, deque] = {}
    for i, d in enumerate(domains):
        buckets.setdefault(d, deque()).append(i)
    order, want = sorted(buckets, key=lambda d: -len(buckets[d])), []
    while any(buckets.values()):
        want += [buckets[d].popleft() for d in order if buckets[d]]
    assert got == want


def test_streaks(spark):
    rows = list(enumerate(["a", "a", "b", "", "", "a", "a", "a", None]))
    d = spark.createDataFrame(rows, "pos int, domain string").withColumn("domain_count", F.lit(20))
    got = interleave.cooldown(interleave.streaks(d, "pos")).orderBy("pos").collect()
    assert [r["streak"] for r in got] == [1, 2, 1, 1, 1, 1, 2, 3, 1]
    assert [r["cooldown_s"] for r in got] == [3.5, 3.5, 3.5, 1.5, 1.5, 3.5, 3.5, 6.5, 1.5]


@QUICK
@given(st.lists(st.sampled_from(["a", "b", "", None]), min_size=1, max_size=20), st.integers(1, 4))
def test_streaks_in_blocks(spark, domains, block):
    df = spark.createDataFrame(list(enumerate(domains)), "pos long, domain string")
    got = [r["streak"] for r in interleave.streaks(df, "pos", block=block).orderBy("pos").collect()]
    want, last = [], None
    for d in domains:
        want.append(want[-1] + 1 if d and d == last else 1)
        last = d
    assert got == want


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w"), ("a", 1, "y")], "k string, p int, v string")
    assert {(r["k"], r["v"]) for r in dedup.first_per_key(df, ["k"], "p").collect()} == {("a", "y"), (None, "w")}
    assert {(r["k"], r["v"]) for r in dedup.last_per_key(df, ["k"], "p").collect()} == {("a", "x"), (None, "z")}
    assert dedup.first_per_key(df.limit(0), ["k"], "p").count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 2, "o"), (None, 9, "o")], "k string, first int, v string")
    new = spark.createDataFrame([("a", 5, "n"), ("c", 6, "n"), (None, 7, "n")], "k string, first int, v string")
    apply = lambda o: upsert.upsert(o, new.where("k is not null"), ["k"], {"first": upsert.keep_old})
    once = {tuple(r) for r in apply(old).collect()}
    assert once == {("a", 1, "n"), ("b", 2, "o"), ("c", 6, "n"), (None, 9, "o")}
    assert {tuple(r) for r in apply(apply(old)).collect()} == once
    assert sorted(r["v"] for r in upsert.insert_ignore(old, new, ["k"]).collect()) == ["n", "n"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert upsert.read_snapshot(spark, root) is None
    upsert.write_snapshot(spark.range(3), root)
    upsert.write_snapshot(upsert.read_snapshot(spark, root).where("id > 0"), root)
    assert sorted(r["id"] for r in upsert.read_snapshot(spark, root).collect()) == [1, 2]


def test_pending(spark):
    now = datetime(2024, 1, 1)
    rows = [("u1", None, "x", None, None, None, datetime(2020, 1, 2)), ("u1", "", None, 0, now, "error", datetime(2020, 1, 1)), ("u2", None, None, 4, None, None, now), ("u3", None, None, 0, None, "gone", now), ("u4", "t", "c", 0, None, None, now), ("", None, None, 0, None, None, now), ("u5", None, None, 1, datetime(2025, 1, 1), None, now)]
    df = spark.createDataFrame(rows, "sourceurl string, title string, article_content string, title_fetch_attempts int, title_next_retry_at timestamp, title_fetch_status string, ingested_at timestamp")
    assert [tuple(r) for r in select.pending_urls(df, now).collect()] == [("u1", datetime(2020, 1, 1))]


def test_weeks(spark):
    df = spark.createDataFrame([("2021-01-03",), ("2021-01-04",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    counts = weekly.weekly_counts(df, "d")
    assert {tuple(r) for r in counts.collect()} == {(2020, 53, 1), (2021, 1, 1)}
    assert weekly.weekly_grid(counts).count() == 106
    assert weekly.grid_quantiles(weekly.weekly_grid(counts.limit(0))).first()["ticks"] == [0]


def test_entities(spark):
    old = spark.createDataFrame([(7, "PF", "ORG")], "id long, text string, type string")
    found = spark.createDataFrame([("u", "PF", "ORG"), ("u", "INSS", "ORG"), ("v", "INSS", "ORG"), ("v", None, "ORG"), ("v", "PF", "MISC")], "url string, text string, type string")
    every = entities.get_or_create(found, old)
    assert {tuple(r) for r in every.collect()} == {(7, "PF", "ORG"), (8, "INSS", "ORG"), (9, "PF", "MISC")}
    assert entities.link_mentions(found, every).count() == 4
    lists = spark.createDataFrame([("a", ["Alessandro Stefanutto", "INSS", "PF"]), ("b", ["senador", "PF", "PT", "INSS"])], "url string, ents array<string>")
    assert entities.overlap_with(lists, lists.where("url = 'a'")).first()["common"] == ["INSS", "PF"]


def test_knn_ties_and_bad_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 1.0])], "id long, e array<float>")
    got = knn.by_cosine(rows, knn.literal_vector([1.0, 0.0]), "e", ["id"], limit=2, offset=1).collect()
    assert [r["id"] for r in got] == [2, 6]


def test_enriched_keeps_unknown_codes(spark):
    df = spark.createDataFrame([(1, 1, "01", 1, None, 9), (2, None, "99", 5, 2, 3)], "id long, quadclass int, eventrootcode string, actor1geo_type int, actor2geo_type int, actiongeo_type int")
    got = {r["id"]: r for r in views.enriched_events(df).collect()}
    assert got[1]["quadclass_label"] == "Verbal Cooperation" and got[1]["actiongeo_type_label"] is None
    assert got[2]["eventrootcode_label"] is None and got[2]["actor2geo_type_label"] == "USSTATE"


def test_catch_up(spark):
    assert numbers.catch_up(900, 4, 378_146, spark).first()["t"] == 1_519_337 or numbers.catch_up(900, 4, 378_146, spark).first()["t"] > 1_519_000
