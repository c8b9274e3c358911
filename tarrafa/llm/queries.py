"""Queries of the training-data operators, by problem number, over the whole tables of a scale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarrafa.llm import boilerplate, linkage, mixture, neighbours, repeated_lines, residue, sentences, splitter, tokens
from tarrafa.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "g1_chunks", "id", "embedding")
    return neighbours.pairs(neighbours.nearest(chunks, "id", "embedding", k=5, dims=768), "id")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's embeddings (64 dimensions), with their own nearest by the same operator."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", k=5, dims=64)


def _furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = boilerplate.furniture(table(spark, sf_dir, "gdelt_brazil_events", "id", "article_content"), "id", "article_content")
    articles = boilerplate.furniture(table(spark, sf_dir, "g1_articles", "url", "text_content"), "url", "text_content")
    events = events.select(F.lit("gdelt_brazil_events").alias("source_table"), F.col("id").cast("string").alias("record_key"), "line_no")
    return events.unionByName(articles.select(F.lit("g1_articles").alias("source_table"), F.col("url").alias("record_key"), "line_no"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _furniture(spark, sf_dir)


def p3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_text(table(spark, sf_dir, "g1_articles", "url", "text_content"), "url", "text_content")


#: Ingests that the stored events are sent through; the rows don't depend on it.
GROUPS = 3


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events through the persisted index, in ``GROUPS`` ingests of whole source files, each against what came before."""
    events = table(spark, sf_dir, "gdelt_brazil_events", "source_file", "id", "sourceurl")
    return linkage.duplicates(events, ["source_file", "id"], groups=GROUPS).select("id")


def p4_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p4_found, in one ingest more."""
    events = table(spark, sf_dir, "gdelt_brazil_events", "source_file", "id", "sourceurl")
    return linkage.duplicates(events, ["source_file", "id"], groups=GROUPS + 1).select("id")


def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, page): each row with the cluster of addresses that lead to its page, one hash per cluster."""
    events = table(spark, sf_dir, "gdelt_brazil_events", "source_file", "id", "sourceurl")
    return linkage.pages(events, ["source_file", "id"], groups=GROUPS).select("id", "page")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "gdelt_brazil_events", "id", "title", "article_content", "sourceurl")).select("id")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, title_fetch_status) of the rows that stay once residue is left out."""
    events = table(spark, sf_dir, "gdelt_brazil_events", "id", "title", "article_content", "sourceurl", "title_fetch_status")
    return events.join(residue.residue(events).select("id"), "id", "left_anti").select("id", "title", "title_fetch_status")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = splitter.split_items(table(spark, sf_dir, "g1_articles", "url", "text_content"), "url", "text_content")
    chunks = splitter.split_items(table(spark, sf_dir, "g1_chunks", "id", "chunk"), "id", "chunk")
    articles = articles.select(F.lit("g1_articles").alias("item_table"), F.col("url").alias("item_key"), "pieces")
    return articles.unionByName(chunks.select(F.lit("g1_chunks").alias("item_table"), F.col("id").cast("string").alias("item_key"), "pieces"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items with a second piece; the filter stands behind the generator, so the work is done once."""
    return _pieces(spark, sf_dir).select("item_table", "item_key", F.inline("pieces")).where("piece_no = 1").select("item_table", "item_key")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the items that had to be cut: item_table, item_key, piece_no, start_pos, end_pos, piece."""
    return _pieces(spark, sf_dir).select("item_table", "item_key", F.inline("pieces")).where("n_pieces > 1").drop("n_pieces")


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item that was cut: whether all its pieces keep the limit, and each begins within the last 256 characters of the one before or at its end."""
    pieces = _pieces(spark, sf_dir).where(F.size("pieces") > 1)
    follows = F.zip_with(F.slice("pieces", F.lit(1), F.size("pieces") - 1), F.slice("pieces", F.lit(2), F.size("pieces") - 1), lambda a, b: b["start_pos"].between(a["end_pos"] - splitter.OVERLAP, a["end_pos"]))
    return pieces.select("item_table", "item_key", F.forall("pieces", lambda p: F.length(p["piece"]).between(1, splitter.LIMIT)).alias("within_limit"), F.forall(follows, lambda x: x).alias("overlapping"))


def p6_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item put together again from its pieces, without their overlaps; must be the item."""
    flat = F.aggregate("pieces", F.struct(F.lit("").alias("t"), F.lit(0).alias("e")), lambda acc, p: F.struct(F.concat(acc["t"], F.substring(p["piece"], acc["e"] - p["start_pos"] + 1, F.length(p["piece"]))).alias("t"), p["end_pos"].alias("e")))
    return _pieces(spark, sf_dir).select("item_table", "item_key", flat["t"].alias("item")).where("item is not null")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "gdelt_brazil_events", "id", "sourceurl", "article_content")
    return repeated_lines.repeated_lines(events).select("id", "line_no")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.remove_lines(table(spark, sf_dir, "gdelt_brazil_events", "id", "sourceurl", "article_content"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode(p8_ids(spark, sf_dir), "doc_id", "ids")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "source_targets"))[1]


def p9_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target_share, has_tokens, reached): whether a source's share is its target's, relative to all that have tokens, within 1/50."""
    report = p9_shares(spark, sf_dir)
    possible = F.sum(F.when(F.col("tokens_available") > 0, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy())
    wanted = F.when(F.col("tokens_available") > 0, F.col("target_share") / possible).otherwise(0.0)
    return report.select("source", "target_share", (F.col("tokens_available") > 0).alias("has_tokens"), (F.abs(F.col("actual_share") - wanted) <= 0.02).alias("reached"))


def p9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with its token ids: shard, slot, source, pass, ids."""
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixture.mixed_ids(documents, mixture.mix(documents, table(spark, sf_dir, "source_targets"))[0])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_neighbours, p3_found, p3_main_text, p4_found, p4_ingested, p4_pages, p5_found, p5_kept, p6_found, p6_pieces, p6_limits, p6_rejoined, p7_found, p7_cleaned, p8_ids, p8_decoded, p9_mix, p9_shares, p9_reached, p9_blocks, p10_found)
}
