"""Lines repeated across one site's pages: found by compressed bitmaps of pages per line, then removed.

A line is compared in lower case, with each run of white space (no-break spaces and carriage returns too)
made one space and the ends trimmed. A page is a distinct ``sourceurl``, compared as stored; a site is the
host without user info, port and one leading ``www.`` or ``m.``.

Steps, none of which gathers a site's, a line's or a page's rows in one task:

1. Every text is taken apart once, into a written table of hashes. A line that stands in fewer rows than the threshold
   can't stand on that many pages, so it needs no bitmap; this is exact and leaves few lines.
2. The pages of the lines left are numbered densely within their site (large sites in several buckets), and each stored
   form of a line gets its bitmap of pages, compressed to the words of 64 bits that aren't empty (``bit_or``).
3. The bitmaps of all stored forms of a line are united word by word, and their exact cardinalities (``bit_count``) summed.
4. Every line of every row whose (site, line) reaches the threshold is given out. Lines to be deleted are a bitmap of
   line numbers per document, looked up as the text is put together again.

Where lines are looked up, those that stand in very many rows are broadcast (there can't be many of them), so that a
line or site that holds a third of all rows meets no single task.

Defined results: null or empty texts have no lines; blank lines are none; a null address belongs to the
site '' and counts as one page; doubled rows are one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarrafa.functions.url import site
from tarrafa.session import BROADCAST_BYTES, checkpointed, measured_bytes, written

MIN_PAGES = 6
#: Rows of a site that one numbering task should see.
NUMBERING_ROWS = 1 << 18
#: A line is hot if it stands in more than this part of all rows; so many hot lines there are at most.
HOT_LINES = 50_000


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\s\x1c-\x1f\x{85}\p{Z}]+", " ")))


def text_lines(df: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(_key, _site, _page, line_no, _line, _form): each non-blank line by hashes of 64 bits.

    ``_line`` is the hash of the normalised line, ``_form`` of the stored one, ``_page`` of the address; lines
    are only compared within a site, so that site and line make 128 bits.
    """
    address = F.coalesce(F.col(url), F.lit(""))
    base = df.select(F.col(key).alias("_key"), F.xxhash64(site(address)).alias("_site"), F.xxhash64(address).alias("_page"), F.col(text).alias("_text"))
    lines = base.select("_key", "_site", "_page", F.posexplode(F.split("_text", "\n")).alias("_pos", "_raw"))
    # A blank line's normal form is ''; it is dropped by hash, so that the form is computed once.
    return lines.select("_key", "_site", "_page", (F.col("_pos") + 1).alias("line_no"), F.xxhash64(normalised(F.col("_raw"))).alias("_line"), F.xxhash64("_raw").alias("_form")).where(F.col("_line") != F.xxhash64(F.lit("")))


def looked_up(lines: DataFrame, wanted: DataFrame, limit: int = BROADCAST_BYTES, hot_lines: int = HOT_LINES) -> DataFrame:
    """The rows of ``lines`` whose _site and _line stand in ``wanted``, with its other columns.

    ``wanted`` is a written table with _rows, how many rows of ``lines`` each of its lines has. It is broadcast if that is
    small by measure; else only its hot lines are, at most ``hot_lines``, and the others are met by a shuffle.
    """
    keys = ["_site", "_line"]
    if measured_bytes(wanted) <= limit:
        return lines.join(F.broadcast(wanted), keys)
    bound = (wanted.agg(F.sum("_rows")).first()[0] or 0) / hot_lines
    hot, rest = wanted.where(F.col("_rows") > bound), wanted.where(F.col("_rows") <= bound)
    cold = lines.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return lines.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


def in_many_rows(lines: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(rows of ``text_lines`` whose line stands in at least ``min_pages`` rows of its site, those lines with their _rows)."""
    often = checkpointed(lines.groupBy("_site", "_line").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= min_pages))
    return checkpointed(looked_up(lines, often).drop("_rows")), often


def page_bitmaps(lines: DataFrame) -> DataFrame:
    """(_site, _line, _word, _bits): for each line the united bitmap of its pages, the words that aren't empty."""
    kept = checkpointed(lines.select("_site", "_line", "_form", "_page").distinct())
    # Dense page numbers: a large site is numbered in several buckets at once, and each begins a word of its own.
    pages = kept.select("_site", "_page").distinct()
    large = pages.groupBy("_site").agg((F.floor(F.count("*") / NUMBERING_ROWS) + 1).alias("_buckets")).where("_buckets > 1")
    numbered = pages.join(written(large), "_site", "left").select("_site", "_page", F.pmod("_page", F.coalesce("_buckets", F.lit(1))).alias("_bucket"))
    numbered = numbered.withColumn("_no", F.row_number().over(Window.partitionBy("_site", "_bucket").orderBy("_page")) - 1)
    word = F.col("_bucket") * (1 << 32) + F.floor(F.col("_no") / 64)
    bit = _bit(F.col("_no") % 64)
    forms = kept.join(numbered, ["_site", "_page"]).groupBy("_site", "_line", "_form", word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return forms.groupBy("_site", "_line", "_word").agg(F.bit_or("_bits").alias("_bits"))


def frequent_lines(lines: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_site, _line, pages) of the lines of ``text_lines`` that stand on at least ``min_pages`` pages of their site."""
    return page_bitmaps(lines).groupBy("_site", "_line").agg(F.sum(F.bit_count("_bits")).alias("pages")).where(F.col("pages") >= min_pages)


def repeated_lines(df: DataFrame, key: str = "id", url: str = "sourceurl", text: str = "article_content", min_pages: int = MIN_PAGES) -> DataFrame:
    """(key, line_no, pages) of each line to be removed; ``line_no`` counts from 1, blank lines included."""
    lines, often = in_many_rows(checkpointed(text_lines(df, key, url, text)), min_pages)
    found = checkpointed(frequent_lines(lines, min_pages).join(often, ["_site", "_line"]))
    return looked_up(lines, found).select(F.col("_key").alias(key), "line_no", "pages")


def remove_lines(df: DataFrame, key: str = "id", url: str = "sourceurl", text: str = "article_content", min_pages: int = MIN_PAGES) -> DataFrame:
    """(key, text) of every row, without its repeated lines; null stays null. ``key`` must be unique."""
    gone = repeated_lines(df, key, url, text, min_pages).select(F.col(key).alias("_key"), (F.col("line_no") - 1).alias("_at"))
    words = gone.groupBy("_key", F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(_bit(F.col("_at").bitwiseAND(63))).alias("_bits"))
    bitmap = words.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_gone"))
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(bitmap, "_key", "left")
    set_ = lambda i: F.try_element_at("_gone", F.shiftright(i, 6)).bitwiseAND(_bit(i.bitwiseAND(63)))
    kept = F.array_join(F.filter(F.split("_text", "\n"), lambda x, i: F.coalesce(set_(i), F.lit(0)) == 0), "\n")
    return base.select(F.col("_key").alias(key), F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias(text))
