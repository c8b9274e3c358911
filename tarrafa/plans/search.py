"""Semantic search: request checks, the search plan, and a response as the API gives it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarrafa.models import hashed_embedding
from tarrafa.operators.dedup import first_per_key
from tarrafa.operators.knn import in_date_order, literal_vector, search_chunks
from tarrafa.operators.select import searchable_articles


#: Most rows of one page: what the service collects.
MAX_LIMIT = 10_000


@dataclass(frozen=True)
class Request:
    query: str
    top_k: int | None = None
    limit: int = 100
    offset: int = 0
    date_from: str | None = None
    date_to: str | None = None

    @classmethod
    def parse(cls, args: dict[str, str]) -> Request:
        """From request parameters; ValueError for a missing query or a number that isn't one."""
        query = (args.get("query") or "").strip()
        if not query:
            raise ValueError("query is required")
        number = lambda name, default: int(args[name]) if args.get(name) not in (None, "") else default
        limit, offset = number("limit", 100), number("offset", 0)
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        if limit > MAX_LIMIT:
            raise ValueError(f"limit must not be over {MAX_LIMIT}")
        return cls(query, number("top_k", None), limit, offset, args.get("date_from") or None, args.get("date_to") or None)


class SearchService:
    """Search over chunks and articles; ``embed`` turns the query into a vector (the offline default hashes words)."""

    def __init__(self, chunks: DataFrame, articles: DataFrame, embed: Callable[[str], list[float]] | None = None, dims: int = 768):
        self.chunks, self.articles = chunks, articles
        self.embed = embed or (lambda text: hashed_embedding(text, dims))

    def results(self, r: Request) -> DataFrame:
        """The page's chunks in the order they are shown."""
        chosen = searchable_articles(self.articles, date_from=r.date_from, date_to=r.date_to)
        return in_date_order(search_chunks(self.chunks, chosen, literal_vector(self.embed(r.query)), r.limit, r.offset, r.top_k))

    def articles_of(self, results: DataFrame) -> DataFrame:
        """(title, url, date_published): of equal titles the most similar one, by date."""
        first = first_per_key(results, ["title"], -F.col("similarity"), "id")
        return first.select("title", F.col("article").alias("url"), "date_published").orderBy(F.asc_nulls_last("date_published"), "url")

    def search(self, r: Request) -> dict:
        """The response: results, articles, total (rows of this page), limit and offset. At most ``limit`` rows are collected."""
        found = self.results(r).cache()
        try:
            rows = [x.asDict() for x in found.collect()]
            articles = [x.asDict() for x in self.articles_of(found).collect()]
        finally:
            found.unpersist()
        results = [{"article_title": x["title"], "article_url": x["article"], "article_date_published": x["date_published"], "chunk": x["chunk"], "similarity": x["similarity"]} for x in rows]
        return {"results": results, "articles": articles, "total": len(results), "limit": r.limit, "offset": r.offset}


def wsgi(service: SearchService):
    """A WSGI application with ``GET /search``."""
    from urllib.parse import parse_qs

    def app(environ, start_response):
        def answer(status: str, body: dict):
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            start_response(status, [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data)))])
            return [data]

        if environ.get("PATH_INFO") != "/search" or environ.get("REQUEST_METHOD", "GET") != "GET":
            return answer("404 Not Found", {"error": "not found"})
        try:
            request = Request.parse({k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()})
        except ValueError as e:
            return answer("400 Bad Request", {"error": str(e)})
        return answer("200 OK", service.search(request))

    return app
