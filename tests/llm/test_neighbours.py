"""Collision counting against brute force: what is verified, hot cells, odd magnitudes, data without cells."""

import time

import numpy as np
from pyspark.sql import functions as F

from tarrafa.llm import neighbours
from tarrafa.session import checkpointed


def clustered(n, dims, clusters, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    return (centres[np.sort(rng.integers(0, clusters, n))] + 0.6 * rng.standard_normal((n, dims))).astype(np.float32)


def nearest(v, k):
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i, row in enumerate(np.argpartition(-s, k, axis=1)[:, :k]) for j in row}


def test_only_rows_over_the_threshold_are_verified():
    v = clustered(4096, 768, 60)
    every, report = np.ones(len(v), bool), {}
    a = neighbours.projections(768)[:, : neighbours.COUNT]
    began = time.perf_counter()
    i, nb, _ = neighbours.search(np.arange(len(v)), v, every, every, a, 5, report)
    took = time.perf_counter() - began
    want = nearest(v, 5)
    assert len(want & set(zip(i.tolist(), nb.tolist()))) >= 0.98 * len(want)
    assert report["queries"] == len(v) and report["verified"] / report["queries"] < len(v) / 15
    assert took < 20  # a runaway, not a race: single runs differ too much to compare


def test_counts_are_those_of_plain_windows():
    rng = np.random.default_rng(3)
    for n, m, q in ((1, 5, 1), (63, 7, 4), (200, 64, 9), (1000, 33, 5)):
        h, centres = rng.standard_normal((m, n)).astype(np.float32), rng.standard_normal((m, q)).astype(np.float32)
        windows = neighbours.Windows(h)
        grain = -(-n // neighbours.GRAINS)
        got = np.unpackbits(windows.colliding(centres, 0.4, m // 3 + 1).view(np.uint8), axis=1, bitorder="little")[:, :n]
        inside = (np.abs(h[:, None, :] - centres[:, :, None]) <= 0.4).sum(axis=0)
        if grain == 1:  # windows begin at most one place too early
            assert (got >= (inside >= m // 3 + 1)).all() and (got <= (inside + m >= m // 3 + 1)).all()
        assert (got[inside >= m // 3 + 1] == 1).all()


def test_lengths_far_apart_and_ties():
    v = np.array([[1, 0], [1e-30, 0], [1e30, 1e29], [0, 1], [0, 2], [-1, 0]], np.float32)
    every = np.ones(6, bool)
    i, nb, s = neighbours.search(np.arange(6), v, every, every, neighbours.projections(2)[:, :64], 2)
    got = {}
    for x, y, z in zip(i.tolist(), nb.tolist(), s.tolist()):
        got.setdefault(x, []).append((y, round(z, 4)))
    assert got[0] == [(1, 1.0), (2, 0.995)] and got[3] == [(4, 1.0), (2, 0.0995)] and got[4][0] == (3, 1.0)


def test_a_hot_cluster_is_split_again_and_again(spark):
    """100,000 vectors alike to a hundredth, in one dense region of its own shape."""
    rng = np.random.default_rng(4)
    base = np.full(16, 1.0) + 1e-2 * rng.standard_normal((400, 16))
    v = (base[np.arange(100_000) % 400] + 1e-3 * rng.standard_normal((100_000, 16))).astype(np.float32)
    df = checkpointed(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "_id long, _e array<float>").repartition(8))
    index = neighbours.Index(df, 16, 5)
    copies = index.routed().select("_id").count() / len(v)
    assert copies < 12, (copies, index.probes, len(index.blocks))
    got = {}
    for r in index.neighbours(5).where("_id % 1000 = 0").collect():
        got.setdefault(r["_id"], set()).add(r["_nb"])
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for i, near in got.items():
        d = -((u - u[i]) ** 2).sum(axis=1)
        d[i] = -9
        hits += len(near & set(np.argpartition(-d, 5)[:5].tolist()))
    assert hits >= 0.9 * 5 * 100


def test_probes_grow_until_neighbours_meet():
    rng = np.random.default_rng(8)
    x, table = neighbours.unit(rng.standard_normal((150, 48))), neighbours.unit(rng.standard_normal((900, 48)))
    near = [neighbours.unit(rng.standard_normal((5, 48))) for _ in x]  # no nearer than any others
    probes, met = neighbours.enough_probes(x, near, table, np.arange(900), 0.9999)
    assert probes > neighbours.PROBES[-1] and met >= 0.9999
    assert neighbours.enough_probes(x, near, table, np.arange(900), 1.1) == (900, 1.0)  # as many as there are: all rows meet
    assert neighbours.enough_probes(x, [x[i : i + 1] for i in range(150)], table, np.arange(900)) == (1, 1.0)


def test_without_cells(spark):
    v = np.random.default_rng(8).standard_normal((3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "_id long, _e array<float>")
    index = neighbours.Index(df, 64, 5, least_rows=1)
    assert index.met >= neighbours.MEET
    got = {(r["_id"], r["_nb"]) for r in index.neighbours(5).where(F.col("_id") % 10 == 0).collect()}
    want = {x for x in nearest(v, 5) if x[0] % 10 == 0}
    assert len(got & want) >= 0.9 * len(want)
