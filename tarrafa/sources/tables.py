"""Stored tables: catalogue and JDBC scans, SQL over registered views, empty tables with their schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarrafa import schemas
from tarrafa.operators.upsert import read_snapshot, write_snapshot

TABLES = {
    "gdelt_brazil_events": schemas.EVENTS, "processed_files": schemas.PROCESSED_FILES, "g1_sitemaps": schemas.SITEMAPS, "g1_articles": schemas.ARTICLES,
    "g1_chunks": schemas.CHUNKS, "g1_entities": schemas.ENTITIES, "article_entities": schemas.ARTICLE_ENTITIES,
}


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the catalogue, with the columns it has there."""
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A database table; split by ranges of a numeric key where its bounds are given, so that no task reads it all."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Parquet tables of a directory as temporary views, for SQL."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def create_tables(spark: SparkSession, root: str) -> list[str]:
    """An empty snapshot of each table that isn't there yet; what exists is left alone. Returns what was made."""
    made = []
    for name, schema in TABLES.items():
        if read_snapshot(spark, f"{root}/{name}") is None:
            write_snapshot(spark.createDataFrame([], schema), f"{root}/{name}")
            made.append(name)
    return made


def with_columns(df: DataFrame, schema) -> DataFrame:
    """Columns that a newer schema has and ``df`` lacks, added as nulls; its own stay."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns])
