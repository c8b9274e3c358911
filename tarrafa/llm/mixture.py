"""Mixing sources to target weights, in tokens of a public tokenizer.

1. Each document's tokens are counted; the documents of a source lie end to end, in several streams (by hash
   of the id) whose number follows the source's size, and are cut into blocks of ``block`` tokens. A source of
   any size is thus numbered by many tasks.
2. The mix has as many blocks as the scarcest source allows with its share and ``max_repeats`` (or as asked
   for, if that is less). Every source's number of blocks is its share of them, by largest remainders.
3. Output shards draw how many blocks they take from each source: multinomial counts, conditioned on the
   totals (multivariate hypergeometric), by a binary tree of draws whose seeds follow from the node, so that
   a shard finds its own counts, and its first index per source, without the others.
4. The n-th block drawn from a source is block ``p(n mod blocks)`` of it, where p is a pseudorandom
   permutation (a Feistel network with cycle walking) of its own for each pass; passes are at most
   ``max_repeats``, so no block, and no document, is used more often than that.
5. Slots are joined with blocks by source and index.

Defined results: null and empty texts have no tokens and no part in it; documents whose source is null or not
named have none either; a named source without tokens reaches a share of 0, and the others keep their
proportions; shares are taken relative to their sum; a source with max_repeats under 1 counts as absent; of
several targets for one source the largest share holds. The last block of a stream is shorter; it is drawn
like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarrafa.llm.tokens import count_tokens, encode
from tarrafa.session import checkpointed, written

BLOCK, SHARD_BLOCKS, SEED = 256, 256, 20240607
#: Tokens of one stream of a source: what one numbering task sees.
STREAM_TOKENS = 1 << 22


def document_tokens(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of named sources that have tokens; tokens counted once."""
    named = targets.where("source is not null").select("source").distinct()
    mine = documents.select("doc_id", "source", "text").where("text is not null and text <> ''").join(named, "source", "left_semi")
    keyed = mine.select(F.struct("doc_id", "source").alias("_k"), "text")
    return count_tokens(keyed, "_k", "text", path).where("n_tokens > 0").select("_k.doc_id", "_k.source", "n_tokens")


def pack(tokens: DataFrame, block: int = BLOCK, stream_tokens: int = STREAM_TOKENS) -> DataFrame:
    """(source, block_no, doc_id, first_token, n_tokens): the segments of documents that make each block.

    Block numbers are dense within a source, from 0. ``tokens`` is read more than once, so it should be written out.
    """
    sizes = tokens.groupBy("source").agg(F.sum("n_tokens").alias("_total")).select("source", F.ceil(F.col("_total") / stream_tokens).alias("_streams"))
    # One row per named source; its size is measured once it is written.
    t = tokens.join(written(sizes), "source").withColumn("_stream", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), "_streams")).drop("_streams")
    order = Window.partitionBy("source", "_stream").orderBy(F.xxhash64("doc_id"), "doc_id")
    t = t.withColumn("_end", F.sum("n_tokens").over(order)).withColumn("_start", F.col("_end") - F.col("n_tokens"))
    # Streams of a source are few (its size over stream_tokens); their block counts are summed up in a small window.
    streams = t.groupBy("source", "_stream").agg(F.ceil(F.max("_end") / block).alias("_blocks"))
    streams = streams.withColumn("_base", F.sum("_blocks").over(Window.partitionBy("source").orderBy("_stream")) - F.col("_blocks"))
    cut = t.join(streams, ["source", "_stream"]).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))))
    first = F.greatest(F.col("_start"), F.col("_b") * block)
    last = F.least(F.col("_end"), (F.col("_b") + 1) * block)
    return cut.select("source", (F.col("_base") + F.col("_b")).cast("long").alias("block_no"), "doc_id", (first - F.col("_start")).cast("long").alias("first_token"), (last - first).cast("long").alias("n_tokens"))


def plan(blocks: dict[str, int], targets: list[tuple[str, float, int]], wanted: int | None = None) -> dict[str, int]:
    """Blocks to draw from each source: shares kept, no source beyond blocks x max_repeats, largest remainders."""
    usable = {s: (w, r) for s, w, r in targets if w and w > 0 and r and r >= 1 and blocks.get(s, 0) > 0}
    if not usable:
        return {}
    weight = sum(w for w, _ in usable.values())
    total = min(math.floor(blocks[s] * r * weight / w) for s, (w, r) in usable.items())
    total = total if wanted is None else min(total, wanted)
    exact = {s: total * w / weight for s, (w, _) in usable.items()}
    counts = {s: min(math.floor(x), blocks[s] * usable[s][1]) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (counts[s] - exact[s], s)):
        if sum(counts.values()) >= total:
            break
        if counts[s] < blocks[s] * usable[s][1]:
            counts[s] += 1
    return counts


def shard_draw(counts: np.ndarray, sizes_total: int, shard: int, shards: int, shard_blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, count) per source of one shard, by splitting the totals down a binary tree of shards."""
    low, high = 0, shards
    start, have = np.zeros_like(counts), counts.copy()
    while high - low > 1:
        mid = (low + high) // 2
        left = min(mid * shard_blocks, sizes_total) - low * shard_blocks
        drawn = drawn_of_each(np.random.default_rng([seed, low, high]), have, left)
        if shard < mid:
            high, have = mid, drawn
        else:
            low, start, have = mid, start + drawn, have - drawn
    return start, have


def drawn_of_each(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n drawn without putting back; counts may be as large as doubles tell apart."""
    out, rest = np.zeros_like(have), int(have.sum())
    for i, good in enumerate(have.tolist()):
        rest -= good
        out[i] = hypergeometric(rng, good, rest, n)
        n -= int(out[i])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn of good + bad.

    Populations that the library's sampler doesn't take (1e9 and more) are drawn by the ratio of uniforms: points under
    the square root of the law's density, in a rectangle known to hold it, are accepted.
    """
    whole = good + bad
    if not good or not n:
        return 0
    if not bad or n == whole:
        return min(good, n)
    if whole < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * good > whole:
        return n - hypergeometric(rng, bad, good, n)
    if 2 * n > whole:
        return good - hypergeometric(rng, good, bad, whole - n)
    mode = (n + 1) * (good + 1) // (whole + 2)
    share = good / whole
    deviation = math.sqrt((whole - n) / (whole - 1) * n * share * (1 - share) + 0.5)
    # Width of the rectangle, 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e), by Stadlober's bound.
    centre, width = n * share + 0.5, 2 * math.sqrt(2 / math.e) * deviation + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        w = centre + width * (v - 0.5) / u
        if not 0 <= w < min(n, good) + 1:
            continue
        k = int(w)
        pairs = ((k, mode), (good - k, good - mode), (n - k, n - mode), (bad - n + k, bad - n + mode))
        if 2 * math.log(u) <= -sum(_log_factorials(x, y) for x, y in pairs):
            return k


def _log_factorials(x: int, y: int) -> float:
    """log x! - log y!, without the cancellation that two large logarithms would suffer."""
    if min(x, y) < 1000:
        return math.lgamma(x + 1) - math.lgamma(y + 1)
    return (y + 0.5) * math.log1p((x - y) / y) + (x - y) * (math.log(x) - 1) + (1 / x - 1 / y) / 12


def permuted(n: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size), at the indices n: four Feistel rounds, walking on until inside."""
    half = max(1, math.ceil(math.log2(max(size, 2)) / 2))
    mask = np.uint64((1 << half) - 1)
    x = n.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            h = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= np.uint64(size)
    return x.astype(np.int64)


def slots(spark, counts: dict[str, int], blocks: dict[str, int], shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, pass, block_no) of every block of the mix."""
    names = sorted(counts)
    totals, sizes = np.array([counts[s] for s in names], dtype=np.int64), [blocks[s] for s in names]
    total = int(totals.sum())
    shards = math.ceil(total / shard_blocks)
    schema = "shard long, slot long, source string, pass long, block_no long"
    if not total:
        return spark.createDataFrame([], schema)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                first, have = shard_draw(totals, total, int(shard), shards, shard_blocks, seed)
                parts = []
                for i, s in enumerate(names):
                    if have[i]:
                        n = np.arange(first[i], first[i] + have[i])
                        turn = n // sizes[i]
                        at = np.empty_like(n)
                        for p in np.unique(turn):
                            at[turn == p] = permuted(n[turn == p] % sizes[i], sizes[i], seed + 1_000_003 * i + int(p))
                        parts.append(pd.DataFrame({"source": s, "pass": turn, "block_no": at}))
                out = pd.concat(parts, ignore_index=True)
                out["shard"], out["slot"] = shard, np.random.default_rng([seed, 7, int(shard)]).permutation(len(out))
                yield out[["shard", "slot", "source", "pass", "block_no"]]

    return spark.range(shards).mapInPandas(draw, schema)


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, wanted_blocks: int | None = None, seed: int = SEED, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, report).

    segments: shard, slot, source, doc_id, first_token, n_tokens, pass - what stands in each slot of the mix.
    report: source, target_share, tokens_available, tokens_used, actual_share, passes, for every named source.
    What is collected to the driver is one row per source.
    """
    spark = documents.sparkSession
    goals = targets.where("source is not null").groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), F.coalesce("target_share", F.lit(0.0))).alias("t")).select("source", F.coalesce("t.target_share", F.lit(0.0)).alias("target_share"), F.coalesce("t.max_repeats", F.lit(0)).alias("max_repeats"))
    packed = checkpointed(pack(checkpointed(document_tokens(documents, goals, path)), block))
    have = {r["source"]: (r["blocks"], r["tokens"]) for r in packed.groupBy("source").agg((F.max("block_no") + 1).alias("blocks"), F.sum("n_tokens").alias("tokens")).collect()}
    blocks = {s: b for s, (b, _) in have.items()}
    counts = plan(blocks, [tuple(r) for r in goals.select("source", "target_share", "max_repeats").collect()], wanted_blocks)
    drawn = slots(spark, counts, blocks, shard_blocks, seed)
    # Both sides grow with the mix: what the optimizer guesses of the drawn one is that of a few shards.
    segments = drawn.join(packed.hint("merge"), ["source", "block_no"]).select("shard", "slot", "source", "doc_id", "first_token", "n_tokens", "pass")
    used = segments.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), (F.max("pass") + 1).alias("passes"))
    available = packed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"))
    report = goals.join(available, "source", "left").join(used, "source", "left")
    whole = F.sum(F.coalesce("tokens_used", F.lit(0))).over(Window.partitionBy())
    report = report.select("source", "target_share", F.coalesce("tokens_available", F.lit(0)).alias("tokens_available"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce(F.try_divide(F.coalesce("tokens_used", F.lit(0)), whole), F.lit(0.0)).alias("actual_share"), F.coalesce("passes", F.lit(0)).alias("passes"))
    return segments, report


def mixed_ids(documents: DataFrame, segments: DataFrame, path: str | None = None) -> DataFrame:
    """(shard, slot, source, pass, ids) of each block of the mix: the token ids of its segments, end to end.

    Ids and segments meet by document; a slot's segments, at most a block's tokens, then meet by shard and slot.
    """
    used = segments.select("doc_id").distinct()
    ids = encode(documents.where("text is not null and text <> ''").select("doc_id", "text").join(used, "doc_id", "left_semi"), "doc_id", "text", path)
    order = F.xxhash64("doc_id")  # documents lie in a stream by this hash, so a block's segments do as well
    part = F.struct(order.alias("h"), "doc_id", "first_token", F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("ids"))
    cut = segments.join(ids.hint("merge"), "doc_id").select("shard", "slot", "source", "pass", part.alias("p"))
    return cut.groupBy("shard", "slot", "source", "pass").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["ids"])).alias("ids"))
