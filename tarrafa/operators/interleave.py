"""Fair ordering of a fetch queue by domain, runs of the same domain, and how long to wait."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarrafa.functions.url import host
from tarrafa.session import checkpointed, written


def round_robin(queue: DataFrame, pos: str, url: str = "sourceurl") -> DataFrame:
    """Adds domain, domain_count and place: one address of each domain per round, larger domains first.

    Domains of equal size come in the order of their first address. All places come from range sorts and per-partition
    counts, a domain's turns too, as its rows stand together in one: neither the queue nor a large domain is one task's.
    """
    d = numbered(queue.withColumn("domain", host(F.col(url))), [F.asc_nulls_first("domain"), F.asc(pos)], "_no")
    sizes = written(d.groupBy("domain").agg(F.count("*").alias("domain_count"), F.min(pos).alias("_first"), F.min("_no").alias("_begins")))
    sizes = sizes.withColumnRenamed("domain", "_domain")
    ranked = d.join(sizes, F.col("domain").eqNullSafe(F.col("_domain"))).withColumn("_turn", F.col("_no") - F.col("_begins") + 1).drop("_domain", "_no", "_begins")
    return numbered(ranked, ["_turn", F.desc("domain_count"), "_first"], "place").drop("_turn", "_first")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Numbers rows from 1 in a total order, by one range exchange: offsets of partitions, then ranks within."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ordered.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    tagged = tagged.withColumn("_part", part).withColumn("_in", F.col("_m") - F.shiftleft(part, 33))
    tagged = checkpointed(tagged.drop("_m"))
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition.
    before = written(counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before"))
    return tagged.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_in") + 1).cast("long")).drop("_part", "_in", "_before")


def streaks(df: DataFrame, pos: str, domain: str = "domain", partition: list[str] | None = None, block: int = 1 << 16) -> DataFrame:
    """Adds streak: how many rows in a row, up to this one, share its domain; an empty or null domain is always 1.

    With ``partition`` the order is within each of its groups; without it the order is global over whole
    numbers ``pos``, and is handled in blocks of positions: runs within blocks first, then what each block's first
    run takes over from the blocks before it, from one row per block.
    """
    if partition:
        return _runs(df, pos, domain, partition).drop("_run")
    d = _runs(df.withColumn("_block", F.floor(F.col(pos) / block)), pos, domain, ["_block"])
    name = F.coalesce(F.col(domain), F.lit(""))
    at = lambda pick, value: pick(value, F.col(pos))
    blocks = d.groupBy("_block").agg(at(F.min_by, name).alias("_first"), at(F.max_by, name).alias("_last"), at(F.max_by, F.col("streak")).alias("_tail"), F.max("_run").alias("_runs"))
    over = Window.orderBy("_block")
    blocks = blocks.withColumn("_goes_on", (F.col("_first") != "") & F.col("_first").eqNullSafe(F.lag("_last").over(over)))
    blocks = blocks.withColumn("_chain", F.sum(F.when(F.col("_goes_on") & (F.col("_runs") == 1), 0).otherwise(1)).over(over))
    blocks = blocks.withColumn("_end", F.sum("_tail").over(Window.partitionBy("_chain").orderBy("_block")))
    carried = blocks.select("_block", F.when(F.col("_goes_on"), F.lag("_end").over(over)).otherwise(0).alias("_carry"))
    out = d.join(carried, "_block")
    return out.withColumn("streak", F.col("streak") + F.when(F.col("_run") == 1, F.col("_carry")).otherwise(0)).drop("_block", "_run", "_carry")


def _runs(df: DataFrame, pos: str, domain: str, keys: list[str]) -> DataFrame:
    """Adds streak and _run, the number of the run within the keys."""
    w = Window.partitionBy(*keys).orderBy(pos)
    blank = F.coalesce(F.col(domain), F.lit("")) == ""
    d = df.withColumn("_new", F.when(blank | ~F.lag(domain).over(w).eqNullSafe(F.col(domain)) | (F.row_number().over(w) == 1), 1).otherwise(0))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(pos)).cast("long")).drop("_new")


def cooldown(df: DataFrame, base: float = 1.5, streak_extra: float = 3.0, streak_from: int = 3, heavy_extra: float = 2.0, heavy_from: int = 20) -> DataFrame:
    """Adds cooldown_s from streak, domain and domain_count."""
    named = F.coalesce(F.col("domain"), F.lit("")) != ""
    seconds = F.lit(base) + F.when(F.col("streak") >= streak_from, streak_extra).otherwise(0.0) + F.when(named & (F.col("domain_count") >= heavy_from), heavy_extra).otherwise(0.0)
    return df.withColumn("cooldown_s", seconds)
