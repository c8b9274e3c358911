"""A news-search connector as a Python data source over stored tables of results.

The real search service is outside; ``path`` names a JSON-lines file of {title, url, body} rows that stands
for it, or a folder of them, one partition each, which the workers must see. ``query`` gets `` site:<site>`` appended
when ``site`` is given; rows match if they hold all words. ``search_news`` asks the same of a table on any file system.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def search_news(results: DataFrame, query: str, site: str = "", num_results: int = 10) -> DataFrame:
    """The first ``num_results`` of (title, url, body), by address, that hold all words of a query."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    found = results.where(F.contains(F.coalesce("url", F.lit("")), F.lit(site)))
    for word in query.lower().split():
        found = found.where(F.contains(text, F.lit(word)))
    return found.select("title", "url", "body").orderBy("url", "title").limit(num_results)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        path = self.options["path"]
        return [InputPartition(os.path.join(path, n)) for n in sorted(os.listdir(path))] if os.path.isdir(path) else [InputPartition(path)]

    def read(self, partition):
        words = self.options.get("query", "").lower().split()
        site = self.options.get("site", "")
        left = int(self.options.get("num_results", "10"))
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                if left <= 0:
                    return
                row = json.loads(line)
                text = f"{row.get('title') or ''} {row.get('body') or ''}".lower()
                if site in (row.get("url") or "") and all(w in text for w in words):
                    left -= 1
                    yield (row.get("title"), row.get("url"), row.get("body"))


class NewsSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "news_search"

    def schema(self) -> str:
        return "title string, url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NewsSearch)
