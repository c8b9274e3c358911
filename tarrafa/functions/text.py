"""Text functions as column expressions; only HTML unescaping needs an Arrow UDF."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarrafa.functions.url import strip

CHUNK_SIZE, CHUNK_OVERLAP = 1024, 256


@F.pandas_udf(T.StringType())
def unescape_html(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every named and numeric character reference replaced; null stays null."""
    for t in texts:
        yield t.map(html.unescape, na_action="ignore")


def unescape_common(text: Column) -> Column:
    """The five references of XML and the no-break space, without leaving the JVM; the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_title(page: Column, all_references: bool = False) -> Column:
    """Content of the first title element: unescaped, then stripped, then white space collapsed; null if blank."""
    raw = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    plain = unescape_html(raw) if all_references else unescape_common(raw)
    return F.nullif(F.regexp_replace(strip(plain), r"(?U)\s+", " "), F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def text_array(value: Column) -> Column:
    """A comma-separated text as trimmed non-empty items; null where nothing is left."""
    items = F.filter(F.transform(F.split(value, ","), strip), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def clean_array(values: Column) -> Column:
    """An array's trimmed non-empty items; null where nothing is left."""
    items = F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(items) > 0, items)


def chunk_count(length: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows over a text: none for an empty one, the last one ending where the text ends."""
    return F.when(length <= 0, 0).when(length <= size, 1).otherwise(F.ceil((length - size) / (size - overlap)) + 1).cast("int")


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of ``size`` characters; the stride is size - overlap."""
    n = chunk_count(F.length(text), size, overlap)
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * (size - overlap) + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


def _printed(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def chunk_header(title: Column, published: Column, excerpt: Column, categories: Column) -> Column:
    """What stands in front of each chunk of an article; excerpt and categories only where there are any."""
    lines = [
        F.concat(F.lit("Título: "), _printed(title), F.lit("\n")),
        F.concat(F.lit("Publicado: "), _printed(published), F.lit("\n")),
        F.when(F.coalesce(F.length(excerpt), F.lit(0)) > 0, F.concat(F.lit("Trecho: "), excerpt, F.lit("\n"))).otherwise(""),
        F.when(F.coalesce(F.size(categories), F.lit(0)) > 0, F.concat(F.lit("Categorias: "), F.array_join(categories, ", ", "None"), F.lit("\n"))).otherwise(""),
        F.lit("\n"),
    ]
    return F.concat(*lines)
