"""The order of all sitemaps, against one worked out row by row in plain Python."""

import os
import re
from datetime import UTC, datetime, timedelta

import pytest

from tarrafa import queries

SF = os.environ.get("TARRAFA_TEST_SF", "/root/testdata/sf0.1")
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: Every notation of lastmod that the tables hold, and the instant it names; None where the file name decides.
FORMS = [
    ("2016-09-16T18:15:27Z", "2016-09-16T18:15:27+00:00"), ("2017-01-02T12:38:19-02:00", "2017-01-02T14:38:19+00:00"), ("2016-08-28", "2016-08-28T00:00:00+00:00"), ("2016-09-06T10:08:15-0300", "2016-09-06T13:08:15+00:00"),
    ("2017-04-02T14:32:12z", "2017-04-02T14:32:12+00:00"), ("2016-08-19T23:35-03:00", "2016-08-20T02:35:00+00:00"), ("2016-08-02T07:29:53.920Z", "2016-08-02T07:29:53.920000+00:00"), ("2017-02-19T06:54:34", "2017-02-19T06:54:34+00:00"),
    ("2018-02-19 06:54:34", "2018-02-19T06:54:34+00:00"), ("2016-10-06T01:28:55.908906-03:00", "2016-10-06T04:28:55.908906+00:00"), ("2016-08-10T19:29:00.157379821-03:00", "2016-08-10T22:29:00.157379+00:00"), ("0000-00-00 00:00:00", None),
    ("1484908749760", None), ("1637375984", None), ("Fri, 24 Feb 2023 21:50:17 GMT", None), ("N/A", None), ("30 de fevereiro de 2017", None), ("45/10/2018", None), ("T10:00", None), ("10:00", None), ("2016-08", None), ("2017-02-30", None), ("", None), (None, None),
]


def micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def named(loc: str) -> tuple[int, int]:
    m = re.search(r"/(\d{4})/(\d{2})/(\d{2})_(\d+)\.xml$", loc)
    return (micros(datetime(int(m[1]), int(m[2]), int(m[3]), tzinfo=UTC)), int(m[4])) if m else (0, 0)


def brute(loc: str, lastmod: str | None) -> tuple[int, int]:
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d+))?([zZ]|[+-]\d{2}:?\d{2})?)?", lastmod or "")
    try:
        zone = "+00:00" if m[5] in (None, "z", "Z") else m[5]
        at = datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00'}{m[3] or ':00'}.{(m[4] or '0')[:6].ljust(6, '0')}{zone}")
    except (TypeError, ValueError):
        return named(loc)
    return micros(at), 0


def in_order(pairs):
    return sorted(((loc, *brute(loc, mod)) for loc, mod in pairs), key=lambda r: (-r[1], -r[2], r[0]))


def test_every_notation_takes_part(spark, tmp_path):
    pairs = [(f"https://x/2019/03/{i + 1:02}_{i}.xml", mod) for i, (mod, _) in enumerate(FORMS)] + [("https://x/a.xml", None), ("https://x/b.xml", "N/A")]
    for (loc, mod), (_, at) in zip(pairs, FORMS, strict=False):
        assert brute(loc, mod) == ((micros(datetime.fromisoformat(at)), 0) if at else named(loc))
    spark.createDataFrame(pairs, "sitemap_url string, sitemap_lastmod string").write.parquet(f"{tmp_path}/g1_sitemaps.parquet")
    assert [tuple(r) for r in queries.QUERIES["sitemap_order"](spark, str(tmp_path)).collect()] == in_order(pairs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_no_stored_sitemap_is_left_out(spark):
    stored = [tuple(r) for r in spark.read.parquet(f"{SF}/g1_sitemaps.parquet").select("sitemap_url", "sitemap_lastmod").collect()]
    assert [tuple(r) for r in queries.QUERIES["sitemap_order"](spark, SF).collect()] == in_order(stored)
