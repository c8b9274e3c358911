"""Draws from very large populations, and the mix's ids."""

import os

import numpy as np
import pytest

from tarrafa.llm import mixture, tokens


def test_large_draws_keep_their_law():
    rng = np.random.default_rng(1)
    for good, bad, n in ((4 * 10**8, 6 * 10**8 + 5, 3 * 10**8), (2 * 10**12, 10**12, 5 * 10**11), (10**12, 30, 20), (40, 10**10, 10**9), (7 * 10**11, 10**12, 16 * 10**11)):
        x = np.array([mixture.hypergeometric(rng, good, bad, n) for _ in range(3000)], dtype=float)
        whole = good + bad
        mean, var = n * good / whole, n * (good / whole) * (bad / whole) * ((whole - n) / (whole - 1))
        assert abs(x.mean() - mean) < 5 * (var / 3000) ** 0.5 + 1e-9
        assert 0.85 < (x.var() + 1e-3) / (var + 1e-3) < 1.15
        assert x.min() >= max(0, n - bad) and x.max() <= min(n, good)


def test_both_samplers_agree():
    good, bad, n = 3_000_000, 5_000_000, 2_000_000

    a = np.array([np.random.default_rng([3, i]).hypergeometric(good, bad, n) for i in range(4000)])
    scale = 1000  # the same share of a population a thousand times as large: the deviations grow by its root
    b = np.array([mixture.hypergeometric(np.random.default_rng([4, i]), good * scale, bad * scale, n * scale) for i in range(4000)])
    z = [np.sort((x - x.mean()) / x.std()) for x in (a, b)]
    assert abs(z[0] - z[1])[100:-100].max() < 0.15


def test_shards_of_two_trillion_blocks():
    counts = np.array([10**12, 9 * 10**11, 10**11, 0, 7], dtype=np.int64)
    total = int(counts.sum())
    shards = -(-total // 256)
    first, have = mixture.shard_draw(counts, total, shards // 2, shards, 256, 1)
    after = mixture.shard_draw(counts, total, shards // 2 + 1, shards, 256, 1)[0]
    assert have.sum() == 256 and (first + have == after).all() and (first >= 0).all() and (after <= counts).all()
    assert mixture.shard_draw(counts, total, 0, shards, 256, 1)[0].sum() == 0
    last = mixture.shard_draw(counts, total, shards - 1, shards, 256, 1)
    assert (last[0] + last[1] == counts).all()
    assert len(np.unique(mixture.permuted(np.arange(10_000), 10**12, 5))) == 10_000


@pytest.mark.skipif(not os.path.exists(tokens.rank_file()), reason="no vocabulary files")
def test_ids_of_the_mix(spark):
    docs = [(i, "ab"[i % 2], f"Texto número {i}: " + "casa " * (i % 90)) for i in range(120)] + [(900, "a", None), (901, "b", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    segments = mixture.mix(df, targets, block=64, shard_blocks=16)[0]
    ids = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "doc_id", "text").collect()}
    want: dict = {}
    for r in segments.collect():
        want.setdefault((r["shard"], r["slot"]), []).extend(ids[r["doc_id"]][r["first_token"] : r["first_token"] + r["n_tokens"]])
    got = {(r["shard"], r["slot"]): r["ids"] for r in mixture.mixed_ids(df, segments).collect()}
    assert set(got) == set(want) and all(sorted(got[k]) == sorted(want[k]) and 0 < len(got[k]) <= 64 for k in want)
    assert mixture.mixed_ids(df.limit(0), segments.limit(0)).count() == 0
