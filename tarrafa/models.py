"""Model stages behind Arrow UDFs, each with a deterministic offline default.

The defaults are not the models that a deployment would plug in: their output is stable and cheap, so that
pipelines run and can be tested anywhere; equal output isn't claimed. A stage is a function from a list of
texts to a list of results, called once per Arrow batch within a task.
"""

from __future__ import annotations

import hashlib
import html.parser
import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embed = Callable[[list[str]], list[list[float]]]
Extract = Callable[[str], list[tuple[str, str]]]

_TOKEN = re.compile(r"\w+")
_NAME = re.compile(r"(?<![\w.])(?:[A-ZÀ-Þ][\wà-ÿ'-]+|[A-Z]{2,})(?:\s+(?:d[aeo]s?\s+|e\s+)?(?:[A-ZÀ-Þ][\wà-ÿ'-]+|[A-Z]{2,}))*")


def hashed_embedding(text: str, dims: int = 768) -> list[float]:
    """Signed feature hashing of words, as a unit vector; zeros for a text without words."""
    v = [0.0] * dims
    for word in _TOKEN.findall(text.lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embed(df: DataFrame, text: str, out: str = "embedding", dims: int = 768, model: Embed | None = None) -> DataFrame:
    """Adds a vector per text; null stays null."""
    run_model = model or (lambda texts: [hashed_embedding(t, dims) for t in texts])

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vectors = iter(run_model(s.dropna().tolist()))
            yield pd.Series([None if missing else next(vectors) for missing in s.isna()], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def proper_names(text: str) -> list[tuple[str, str]]:
    """Runs of capitalised words that don't open a sentence, as (text, label)."""
    out = []
    for m in _NAME.finditer(text):
        opens = m.start() == 0 or text[: m.start()].rstrip()[-1:] in ".!?\n"
        if not (opens and " " not in m.group() and not m.group().isupper()):
            out.append((m.group(), "ORG" if m.group().isupper() else "MISC"))
    return out


def extract_entities(df: DataFrame, url: str, text: str, model: Extract | None = None) -> DataFrame:
    """(url, text, type): one row per mention."""
    find = model or proper_names

    @F.pandas_udf("array<struct<text:string,label:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"text": a, "label": b} for a, b in find(t)] if t else [])

    found = df.where(F.col(text).isNotNull()).select(F.col(url).alias("url"), F.explode(run(F.col(text))).alias("e"))
    return found.select("url", F.col("e.text").alias("text"), F.col("e.label").alias("type"))


def lead_summary(text: Column, sentences: int = 2) -> Column:
    """The first sentences of a text: the offline default of a summary."""
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, sentences), " ")


def title_prompt(title: Column) -> Column:
    return F.concat(F.lit("Reescreva o título: "), title)


def summary_prompt(text: Column) -> Column:
    return F.concat(F.lit("Resuma o texto a seguir: "), text)


def selection_prompt(df: DataFrame, title: str, question: str) -> DataFrame:
    """(prompt): one text that asks which of all titles answers a question; titles in their order.

    Titles are candidates of one search, a few dozen; the caller bounds them.
    """
    titles = df.where(F.col(title).isNotNull()).agg(F.array_sort(F.collect_list(title)).alias("t"))
    return titles.select(F.concat(F.lit(f"{question}\n"), F.array_join("t", "\n")).alias("prompt"))


def apply_text(df: DataFrame, column: str, out: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds what a model of the caller (summary, title rewrite, answer) makes of each text; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            made = iter(model(s.dropna().tolist()))
            yield pd.Series([None if missing else next(made) for missing in s.isna()], dtype=object)

    return df.withColumn(out, run(F.col(column)))


def continuity(similarity: Column, common: Column, least_similarity: float = 0.5, least_common: int = 2) -> Column:
    """'Sim' or 'Não': whether one article goes on where another ends, by a rule instead of a model."""
    return F.when((similarity >= least_similarity) & (common >= least_common), "Sim").otherwise("Não")


class _Body(html.parser.HTMLParser):
    _SKIP = {"script", "style", "noscript", "template", "svg", "nav", "footer", "header", "aside", "form"}
    _BLOCK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "section", "article", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self._SKIP:
            self.depth += 1
        elif tag in self._BLOCK:
            self.parts.append("\n")
        elif tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"])

    def handle_endtag(self, tag):
        if tag in self._SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag in self._BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def page_parts(page: str) -> tuple[str | None, str | None, str | None, str | None]:
    """(title, text, date, author) of an HTML page by the standard parser."""
    p = _Body()
    p.feed(page)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    lines = [" ".join(x.split()) for x in "".join(p.parts).split("\n")]
    tag = " ".join(html.unescape(title.group(1)).split()) if title else ""
    name = p.meta.get("og:title") or ""
    text = "\n".join(x for x in lines if x and x not in (name, tag))
    return name or None, text or None, p.meta.get("article:published_time"), p.meta.get("author")


def json_parts(page: str) -> tuple[str | None, str | None, str | None, str | None]:
    """(title, text, date, author) that a page tells about itself in JSON-LD: the first object with a headline or body."""
    for block in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", page):
        try:
            found = json.loads(block)
        except ValueError:
            continue
        for x in found.get("@graph", [found]) if isinstance(found, dict) else found if isinstance(found, list) else []:
            if isinstance(x, dict) and (x.get("headline") or x.get("articleBody")):
                author = x.get("author")
                author = author.get("name") if isinstance(author, dict) else author
                return tuple(v.strip() or None if isinstance(v, str) else None for v in (x.get("headline"), x.get("articleBody"), x.get("datePublished"), author))
    return None, None, None, None


def extract_pages(df: DataFrame, page: str, out: str = "page", model: Callable | None = None) -> DataFrame:
    """Adds a struct of title, text, date and author; null for a page that is null or can't be parsed."""
    parse = model or page_parts

    @F.pandas_udf("struct<title:string,text:string,date:string,author:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for x in s:
                try:
                    rows.append(parse(x) if x else (None,) * 4)
                except Exception:  # noqa: BLE001 - a page that breaks the parser has no parts
                    rows.append((None,) * 4)
            yield pd.DataFrame(rows, columns=["title", "text", "date", "author"])

    return df.withColumn(out, run(F.col(page)))
