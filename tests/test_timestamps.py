"""Timestamps against a brute-force reading with zoneinfo, and the defined results of odd values."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tarrafa.operators import timestamps as ts

UTC = timezone.utc


def micros(d: datetime) -> int:
    return (d - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def wall(y, m, d, h=0, mi=0, s=0, us=0, zone="America/Sao_Paulo") -> int:
    """First of two instants; a skipped time moves forward by the gap."""
    z = ZoneInfo(zone)
    local = datetime(y, m, d, h, mi, s, us)
    a = local.replace(tzinfo=z, fold=0)
    return micros(a.astimezone(UTC))


CASES = [
    ("2017-05-15T10:59:45-03:00", micros(datetime(2017, 5, 15, 13, 59, 45, tzinfo=UTC))),
    ("2017-05-15T10:59:45-0300", micros(datetime(2017, 5, 15, 13, 59, 45, tzinfo=UTC))),
    ("2017-05-15 10:59:45 +01:00", micros(datetime(2017, 5, 15, 9, 59, 45, tzinfo=UTC))),
    ("2018-01-02T08:00:25.284Z", micros(datetime(2018, 1, 2, 8, 0, 25, 284000, tzinfo=UTC))),
    ("2018-01-02t08:00:25z", micros(datetime(2018, 1, 2, 8, 0, 25, tzinfo=UTC))),
    ("2024-04-10T09:09:27.293060987-04:00", micros(datetime(2024, 4, 10, 13, 9, 27, 293060, tzinfo=UTC))),
    ("2020-09-29", wall(2020, 9, 29)),
    ("20200929", wall(2020, 9, 29)),
    ("20180516205308", wall(2018, 5, 16, 20, 53, 8)),
    ("1570897336062", 1570897336062000),
    ("1543775540", 1543775540000000),
    ("23/06/2018 22h18 (horário de Brasília)", wall(2018, 6, 23, 22, 18)),
    ("01/03/2020", wall(2020, 3, 1)),
    ("21/12/17 01:10", wall(2017, 12, 21, 1, 10)),
    ("22/10/2024 às 18h18", wall(2024, 10, 22, 18, 18)),
    ("17/03/2024 - 09:27", wall(2024, 3, 17, 9, 27)),
    ("29.12.2019 17:54", wall(2019, 12, 29, 17, 54)),
    ("05/08/2016 11:17:55 BRT", micros(datetime(2016, 8, 5, 14, 17, 55, tzinfo=UTC))),
    ("14/12/2016 21:28:40 BRST", micros(datetime(2016, 12, 14, 23, 28, 40, tzinfo=UTC))),
    ("2024-11-18 23:34:21 AMT", micros(datetime(2024, 11, 19, 3, 34, 21, tzinfo=UTC))),
    ("2016-11-18 23:34:21 AMST", micros(datetime(2016, 11, 19, 2, 34, 21, tzinfo=UTC))),
    ("09/02/2018 15:16:50 ACT", micros(datetime(2018, 2, 9, 20, 16, 50, tzinfo=UTC))),
    ("03/10/2019 23:12:04 FNT", micros(datetime(2019, 10, 4, 1, 12, 4, tzinfo=UTC))),
    ("2023-02-12T06:56:06[America/Manaus]", wall(2023, 2, 12, 6, 56, 6, zone="America/Manaus")),
    ("2023-02-12T06:56:06-03:00[America/Manaus]", micros(datetime(2023, 2, 12, 9, 56, 6, tzinfo=UTC))),
    ("Sun, 15 Oct 2017 02:50:26 GMT", micros(datetime(2017, 10, 15, 2, 50, 26, tzinfo=UTC))),
    ("Sat, 18 Feb 2017 21:55:47 -0200", micros(datetime(2017, 2, 18, 23, 55, 47, tzinfo=UTC))),
    ("Domingo, 17 de fevereiro de 2019, 02:45", wall(2019, 2, 17, 2, 45)),
    ("1º de março de 2021", wall(2021, 3, 1)),
    ("15 out. 2017 02h20", wall(2017, 10, 15, 2, 20)),
    ("Oct 12, 2017 8:23 AM", wall(2017, 10, 12, 8, 23)),
    ("Oct 12, 2017 12:23 AM", wall(2017, 10, 12, 0, 23)),
    ("Oct 12, 2017 8:23 PM", wall(2017, 10, 12, 20, 23)),
    # Clock changes: skipped at midnight of 2017-10-15, repeated in the night to 2018-02-18.
    ("2017-10-15", wall(2017, 10, 15, 1)),
    ("2017-10-15T00:30:00", wall(2017, 10, 15, 1, 30)),
    ("2018-02-17T23:30:00", micros(datetime(2018, 2, 18, 1, 30, tzinfo=UTC))),
    ("  2020-09-29  ", wall(2020, 9, 29)),
    ("2020-09-29T24:00:00", wall(2020, 9, 30)),
]
NONE = [None, "", " ", "hoje", "há 2 dias", "Ontem às 14h", "30 de fevereiro de 2017", "31/02/2018 10h00", "45/10/2018", "2017-02-29T10:00:00Z", "0000-00-00 00:00:00", "2018-13-05", "N/A", "null", "--", "Invalid date", "sem data", "2020-01-01T10:00:00[Nowhere/City]", "2020-01-01 lixo", "12", "123456789012345678901234567890", "x" * 100_000]


@pytest.fixture(scope="module")
def read(spark):
    def run(values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        parsed = ts.parse_instants(df, "v", "p")
        return {r["i"]: r["m"] for r in parsed.select("i", ts.to_utc_micros(F.col("p"), F.lit("America/Sao_Paulo")).alias("m")).collect()}

    return run


def test_notations(read):
    got = read([v for v, _ in CASES])
    assert {CASES[i][0]: m for i, m in got.items()} == dict(CASES)


def test_no_date(read):
    assert set(read(NONE).values()) == {None}


def test_session_zone_does_not_matter(spark, read):
    before = read([v for v, _ in CASES])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert read([v for v, _ in CASES]) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_estimated_zone(spark):
    rows = []
    for edition, zone in (("a", "America/Manaus"), ("b", "America/Noronha"), ("c", "America/Rio_Branco")):
        for i in range(400):
            utc = datetime(2016, 1, 1, tzinfo=UTC) + timedelta(hours=37 * i, minutes=7 * i)
            rows.append((edition, utc.astimezone(ZoneInfo(zone)).replace(tzinfo=None), micros(utc) + 60_000_000 * (1 + i % 3)))
    rows += [(None, datetime(2020, 1, 1), 0), ("d", None, 5), ("d", datetime(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "edition string, local timestamp_ntz, seen long")
    got = {r["edition"]: r["time_zone"] for r in ts.estimate_zones(df, "edition", "local", "seen").collect()}
    assert set(got) == {"a", "b", "c"}
    for edition, zone in (("a", "America/Manaus"), ("b", "America/Noronha"), ("c", "America/Rio_Branco")):
        for year in range(2016, 2018):
            for month in (1, 7):
                d = datetime(year, month, 2)
                assert d.replace(tzinfo=ZoneInfo(got[edition])).utcoffset() == d.replace(tzinfo=ZoneInfo(zone)).utcoffset()


def test_normalise_articles(spark):
    articles = spark.createDataFrame(
        [("https://x/am/1", datetime(2020, 1, 2), "2020-01-01 10:00", "2020-01-01", None, "clash"), ("https://x/zz/2", datetime(2020, 1, 1, 14, 1), "2020-01-01 10:00", None, "bad", "clash"), (None, None, None, None, None, None)],
        "url string, first_seen_at timestamp, date_published string, sitemap_lastmod string, sitemap_article_lastmod string, edition string",
    )
    zones = spark.createDataFrame([("am", "America/Manaus"), ("bad", "No/Where"), ("none", None)], "edition string, time_zone string")
    got = {(r["url"][-1], r["field_name"]): r["utc_micros"] for r in ts.normalise_articles(articles, zones).collect()}
    assert got[("1", "date_published")] == micros(datetime(2020, 1, 1, 14, tzinfo=UTC))
    assert got[("1", "sitemap_lastmod")] == micros(datetime(2020, 1, 1, tzinfo=UTC))
    assert got[("2", "date_published")] == micros(datetime(2020, 1, 1, 14, tzinfo=UTC))  # estimated: UTC-4
    assert len(got) == 3
    assert ts.normalise_articles(articles.limit(0), zones).count() == 0
