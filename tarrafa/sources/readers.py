"""Readers: manifests, zipped exports, candidate lists, sitemaps, documents, byte bodies.

All but unzipping and XML entity handling are built-in scans and expressions. Network access stays outside:
``fetch`` takes the function that gets an address as a parameter.
"""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarrafa.functions.url import last_segment, strip
from tarrafa.schemas import CANDIDATES, EVENT_COLUMNS, RAW_EVENT

#: Fixed value: the addresses of event exports in a manifest.
EXPORT_ADDRESS = r"/gdeltv2/\d{14}\.translation\.export\.CSV\.zip$"


def manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url, file_name) of a manifest's lines of three fields whose third is an export; others are skipped."""
    parts = F.split(strip(F.make_valid_utf8(F.col(column))), r"\s+", 3)
    urls = lines.select(parts.alias("_p")).where(F.size("_p") == 3).select(F.element_at("_p", 3).alias("url"))
    return urls.where(F.col("url").rlike(EXPORT_ADDRESS)).select("url", last_segment(F.col("url")).alias("file_name"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest(spark.read.text(path))


def decompressed(body: bytes) -> bytes:
    """gzip, zlib or raw deflate undone; anything else as it is."""
    if body[:2] == b"\x1f\x8b":
        try:
            return gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            return body
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            return zlib.decompress(body, bits)
        except zlib.error:
            continue
    return body


@F.pandas_udf(T.BinaryType())
def decompress(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in bodies:
        yield b.map(decompressed, na_action="ignore")


def decode_utf8(body: Column) -> Column:
    """Bytes as text, with the replacement character for what isn't UTF-8."""
    return F.make_valid_utf8(body.cast("string"))


def unzipped_lines(files: DataFrame) -> DataFrame:
    """(source_file, line_no, line) of the first member of each zip file of a ``binaryFile`` scan.

    Files are unzipped as streams, one after the other within a task; a broken archive gives no lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = z.namelist()
                        if not members:
                            continue
                        with io.TextIOWrapper(z.open(members[0]), encoding="utf-8", errors="replace", newline="\n") as f:
                            held: list[str] = []
                            first = 0
                            for line in f:
                                held.append(line.rstrip("\r\n"))
                                if len(held) == 10_000:
                                    yield pd.DataFrame({"source_file": name, "line_no": range(first, first + len(held)), "line": held})
                                    first, held = first + len(held), []
                            if held:
                                yield pd.DataFrame({"source_file": name, "line_no": range(first, first + len(held)), "line": held})
                except zipfile.BadZipFile:
                    continue

    return files.select("path", "content").mapInPandas(run, "source_file string, line_no long, line string")


def export_rows(lines: DataFrame) -> DataFrame:
    """The 61 columns of each line, all strings; short rows are padded with '' as doubled quotes are undone."""
    parsed = F.from_csv("line", RAW_EVENT.simpleString()[len("struct<") : -1].replace(":", " "), {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    rows = lines.where(strip(F.col("line")) != "").select("source_file", "line_no", parsed.alias("_r"))
    return rows.select("source_file", "line_no", *[F.coalesce(F.col("_r")[c], F.lit("")).alias(c) for c in EVENT_COLUMNS])


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the zipped exports under a path (a glob works), with source_file and line_no."""
    return export_rows(unzipped_lines(spark.read.format("binaryFile").load(path)))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(title, url) of a headerless list whose titles may be quoted and hold commas."""
    return spark.read.schema(CANDIDATES).csv(path, escape='"', quote='"')


def sitemap_kind(xml: Column) -> Column:
    """The root tag of a sitemap: sitemapindex, urlset, or null."""
    return F.nullif(F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1), F.lit(""))


def _blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{tag}\s*>"), F.lit(1))


def _child(block: Column, tag: str) -> Column:
    from tarrafa.functions.text import unescape_common

    raw = F.regexp_extract(block, rf"(?s)<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:[\w.-]+:)?{tag}\s*>", 1)
    return F.nullif(strip(unescape_common(raw)), F.lit(""))


def sitemap_index(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(loc, lastmod) of the sitemaps an index names, whatever the namespace prefix; those without loc are dropped."""
    rows = df.where(sitemap_kind(F.col(xml)) == "sitemapindex").select(F.explode(_blocks(F.col(xml), "sitemap")).alias("_b"))
    return rows.select(_child(F.col("_b"), "loc").alias("loc"), _child(F.col("_b"), "lastmod").alias("lastmod")).where("loc is not null")


def sitemap_urlset(df: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """(pos, loc, lastmod, image_loc) of the pages a sitemap names, and columns of ``df`` to keep; of several images the last one counts."""
    rows = df.where(sitemap_kind(F.col(xml)) == "urlset").select(*keep, F.posexplode(_blocks(F.col(xml), "url")).alias("pos", "_b"))
    images = F.filter(F.transform(_blocks(F.col("_b"), "image"), lambda b: _child(b, "loc")), lambda x: x.isNotNull())
    bare = F.regexp_replace("_b", r"(?s)<(?:[\w.-]+:)?image(?:\s[^>]*)?>.*?</(?:[\w.-]+:)?image\s*>", "")
    return rows.select(*keep, "pos", _child(bare, "loc").alias("loc"), _child(bare, "lastmod").alias("lastmod"), F.try_element_at(images, F.lit(-1)).alias("image_loc")).where("loc is not null")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): whole sitemap files, decompressed where needed."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_utf8(decompress(F.col("content"))).alias("xml"))


def first_valid(tried: DataFrame) -> DataFrame:
    """Of (pos, url, xml), null where an address failed, the first valid index."""
    return tried.where(sitemap_kind(F.col("xml")).isin("sitemapindex", "urlset")).orderBy("pos").limit(1)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, site, body) of text files of which each begins ``title | site | body``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.split("value", r"[|]", 3)
    return files.select("path", strip(F.get(parts, F.lit(0))).alias("title"), strip(F.get(parts, F.lit(1))).alias("site"), strip(F.get(parts, F.lit(2))).alias("body"))


def fetch(urls: DataFrame, get: Callable[[str], tuple[bytes | None, str | None, int | None, str | None]], column: str = "url") -> DataFrame:
    """(url, body, final_url, http_status, error) of each address, by a function of the caller.

    ``get`` is called once per row within tasks and may keep a session per worker; what it raises becomes the
    row's error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch[column]:
                try:
                    out.append((url, *get(url)))
                except Exception as e:  # noqa: BLE001
                    out.append((url, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "body", "final_url", "http_status", "error"]).astype({"http_status": "Int32"})

    return urls.select(column).mapInPandas(run, "url string, body binary, final_url string, http_status int, error string")
