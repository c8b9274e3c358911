"""Most similar vectors for every vector: k nearest neighbours by cosine through collision-counting hashing.

Every hash is a single random projection of the unit vector. Two uses are made of them:

* **Routing.** Rows near in all projections meet in one cell. Cells are the neighbourhoods of leaders: rows of a
  bounded sample that are unlike every leader before them. Rows unlike all leaders are sampled again, for
  a bounded number of rounds, and add leaders of their own. Neighbourhoods of few rows are joined with the
  nearest ones until a cell is worth a task's while. Each row goes to the cells of its ``probes`` nearest
  leaders, so all rows are indexed and all are queries; the number of probes is the least at which some rows
  and their nearest ones, found among all rows by brute force, meet often enough (``MEET``), so it grows where the
  data has no clusters.
* **Collision counting** inside a cell. Each projection has its array of the cell's rows in sorted order; a
  query opens a window around its own value in every array and counts for each row in how many windows it lies.
  Sets of rows are bitmaps (prefixes of a sorted array, at 256 places; a window is the difference of two, rounded
  outward to such places) and counts are bit-sliced, so that counting costs a few word operations per 64 rows; only
  rows that reach the collision threshold are verified, on the stored floats. Virtual rehashing widens all windows
  at once, radius by radius, until the k-th verified distance lies within the radius; at the largest radius the
  whole cell is in the windows, so a query never ends with fewer neighbours than its cell has.

Nothing is dropped to escape skew: leaders with too many rows are replaced by finer ones, again and again, each time by
a new sample of those leaders' rows; a cell that no sample can split (all its rows are as far from each other) is
searched exactly, by pairs of blocks, each a task's work; of more than ``copies`` exact copies of a vector only as many as can be anybody's neighbours (the smallest
ids) are indexed, and the others' neighbours, their copies, are written directly.

Defined results: vectors that are null, of another length, not finite or all zero take no part; equal similarity
is settled by the smaller id; a vector has fewer than k neighbours only where its cells hold no more. Repeated
ids are not supported (ids are unique); repeated vectors are each other's neighbours.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarrafa.session import checkpointed, written

#: Random projections for routing, and how many of them count collisions.
ROUTE, COUNT, SEED = 256, 64, 11
#: Rows of a sample at most (bounds what the driver holds), least similarity to a leader, rounds of sampling.
SAMPLE, ALIKE, ROUNDS, ORPHANS = 40_000, 0.5, 3, 0.02
#: Rows that a cell should have and may have before it is searched in blocks; copies indexed as they are.
LEAST_ROWS, CELL_ROWS, COPIES = 1024, 4096, 64
#: Samples drawn one after the other to split cells with too many rows.
SPLITS = 6
#: Probes to try first (then twice as many, up to all leaders), the share of true neighbours that must meet in a
#: cell, the rows for which it is measured.
PROBES, MEET, TRIALS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64), 0.98, 200
#: Bytes of vectors that a task should search.
PART_BYTES = 32 << 20
#: Similarities with leaders that are held at once.
SIMILARITIES = 4_000_000
#: Half a window is this often the radius; the share of windows that must hold a row; a radius by the one before.
HALF_WINDOW, THRESHOLD, WIDEN = 1.36, 0.71, 1.25
#: Places of a sorted array at which windows begin and end; queries handled at once, and verified at once.
GRAINS, QUERIES, VERIFIED = 256, 128, 32
#: Radius at which windows hold everything (no two unit vectors are farther apart).
WHOLE = 2.0


def projections(dims: int, count: int = ROUTE, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, count)).astype(np.float32)


def usable(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 vectors as stored) of the usable rows of a batch (id, embedding)."""
    e = batch.column(1)
    offsets = np.asarray(e.offsets) if len(e) else np.zeros(1, int)
    ok = (np.diff(offsets) == dims) & ~e.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    if not len(rows):
        return rows, np.zeros((0, dims), np.float32)
    # A slice's values are its part of the whole batch's.
    values = e.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float32()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    v = values[(offsets[rows] - offsets[0])[:, None] + np.arange(dims)]
    with np.errstate(invalid="ignore", over="ignore"):
        top = np.abs(v).max(axis=1)
    fine = np.isfinite(top) & (top > 0)
    return rows[fine], v[fine] + np.float32(0)  # no negative zeros, so that copies are equal in bytes


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Small batches, so that the arrays made of one stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def unit(v: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, as squares of very small or large ones would leave the range of floats.
    x = v / np.abs(v).max(axis=1, keepdims=True, initial=np.finfo(np.float32).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaders(x: np.ndarray, known: np.ndarray, alike: float = ALIKE, block: int = 256) -> np.ndarray:
    """Rows of the sample (unit, projected) unlike all leaders before them; averaged over the rows they lead."""
    out: list[np.ndarray] = list(known)
    table = np.array(out, np.float32) if out else np.zeros((0, x.shape[1]), np.float32)
    for i in range(0, len(x), block):
        b = x[i : i + block]
        if len(table):
            b = b[(b @ table.T).max(axis=1) < alike]
        if len(b):
            while len(b):
                out.append(b[0])
                b = b[1:][(b[1:] @ b[0]) < alike]
            table = np.array(out, np.float32)
    mean = table.copy()
    step = max(16, SIMILARITIES // max(len(table), 1))
    for i in range(0, len(x), step):
        np.add.at(mean, (x[i : i + step] @ table.T).argmax(axis=1), x[i : i + step])
    mean[: len(known)] = known
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def split_leaders(x: np.ndarray, table: np.ndarray, sizes: np.ndarray, most: int, alike: float = ALIKE, depth: int = 20) -> np.ndarray:
    """Leaders with more than ``most`` rows replaced by leaders of their own part of the sample, told apart more finely.

    The likeness asked for comes halfway nearer to 1 per step. What the sample can't split stays whole.
    """
    if not len(table) or not (sizes > most).any():
        return table
    near = nearest_leaders(x, table, 1)[0][:, 0]
    done, todo = [table[sizes <= most]], [(x[near == i], float(sizes[i]), alike) for i in np.flatnonzero(sizes > most)]
    kept = [table[i] for i in np.flatnonzero(sizes > most) if not (near == i).any()]
    for step in range(depth + 1):
        finer = []
        for rows, size, threshold in todo:
            if size <= most or len(rows) < 16 or step == depth:
                mean = rows.mean(axis=0) if len(rows) else None
                if mean is not None:
                    kept.append(mean / max(np.linalg.norm(mean), 1e-12))
                continue
            threshold = 1 - (1 - threshold) / 2
            subs = leaders(rows, np.zeros((0, x.shape[1]), np.float32), threshold)
            own = nearest_leaders(rows, subs, 1)[0][:, 0]
            finer += [(rows[own == j], size * float((own == j).mean()), threshold) for j in range(len(subs)) if (own == j).any()]
        todo = finer
    return np.concatenate([*done, np.array(kept, np.float32).reshape(-1, x.shape[1])]).astype(np.float32)


def route(u: np.ndarray, table: np.ndarray, a: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the nearest leaders, nearest first, and the similarity to the nearest) of unit vectors."""
    h = u @ a
    h /= np.linalg.norm(h, axis=1, keepdims=True)
    return nearest_leaders(h, table, probes)


def nearest_leaders(h: np.ndarray, table: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    probes = min(probes, len(table))
    near, best = np.empty((len(h), probes), np.int32), np.empty(len(h), np.float32)
    step = max(16, SIMILARITIES // max(len(table), 1))
    for i in range(0, len(h), step):
        s = h[i : i + step] @ table.T
        if probes == 1:
            p = s.argmax(axis=1)[:, None]
        else:
            p = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
            p = np.take_along_axis(p, np.argsort(-np.take_along_axis(s, p, axis=1), axis=1, kind="stable"), axis=1)
        near[i : i + step] = p
        best[i : i + step] = np.take_along_axis(s, p[:, :1], axis=1)[:, 0]
    return near, best


def joined_cells(table: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """The cell of each leader: the largest one left takes in its nearest ones left until ``least`` rows are together."""
    cell, left, number = np.full(len(table), -1, np.int32), np.ones(len(table), bool), 0
    for lead in np.argsort(-sizes, kind="stable"):
        if not left[lead]:
            continue
        rest = np.flatnonzero(left)
        order = rest[np.argsort(-(table[rest] @ table[lead]), kind="stable")]
        take = order[: int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1]
        cell[take], left[take] = number, False
        cell[lead], left[lead] = number, False
        number += 1
    return cell


def enough_probes(x: np.ndarray, near: list[np.ndarray], table: np.ndarray, cell: np.ndarray, meet: float = MEET) -> tuple[int, float]:
    """The least number of probes at which rows share a cell with their nearest ones often enough, and how often they do.

    ``near`` has the nearest rows of each row of ``x``, all of them projected. With as many probes as leaders all rows
    share all cells, so a number is always found; where it is a large one, the data has no cells to speak of and the
    search costs what brute force costs.
    """
    if not len(x) or cell.max(initial=0) == 0 or not sum(map(len, near)):
        return 1, 1.0
    tries = [p for p in PROBES if p < len(table)]
    while not tries or tries[-1] < len(table):
        tries.append(min(len(table), 2 * tries[-1] if tries else 1))
    most = 0
    for probes in tries:
        if probes > most:
            most = min(len(table), max(PROBES[-1], probes))
            mine = cell[nearest_leaders(x, table, most)[0]]
            theirs = np.split(cell[nearest_leaders(np.concatenate(near), table, most)[0]], np.cumsum([len(y) for y in near])[:-1])
        share = float(np.concatenate([np.isin(b[:, :probes], a[:probes]).any(axis=1) for a, b in zip(mine, theirs)]).mean())
        if share >= meet:
            break
    return probes, share


class Windows:
    """The sorted arrays of a cell's projections, as bitmaps of their prefixes."""

    def __init__(self, h: np.ndarray):
        m, n = h.shape
        grain = max(1, math.ceil(n / GRAINS))
        order = np.argsort(h, axis=1)
        self.n, self.m = n, m
        self.first = np.take_along_axis(h, order[:, ::grain], axis=1)
        self.sets = np.zeros((m, self.first.shape[1] + 1, math.ceil(n / 64)), np.uint64)
        bits = np.left_shift(np.uint64(1), (order % 64).astype(np.uint64))
        place = np.arange(n) // grain + 1
        for p in range(m):
            np.bitwise_or.at(self.sets[p], (place, order[p] // 64), bits[p])
        np.bitwise_or.accumulate(self.sets, axis=1, out=self.sets)

    def colliding(self, centres: np.ndarray, reach: float, need: int) -> np.ndarray:
        """Bitmaps, one per query, of the rows that lie in at least ``need`` windows of ``centres`` (a row per projection)."""
        shape = (centres.shape[1], self.sets.shape[2])
        total = [np.zeros(shape, np.uint64) for _ in range(self.m.bit_length())]
        waiting: list[np.ndarray | None] = [None] * len(total)
        free: list[np.ndarray] = []
        x1, x2 = np.empty(shape, np.uint64), np.empty(shape, np.uint64)
        for first, sets, centre in zip(self.first, self.sets, centres):
            low = np.maximum(np.searchsorted(first, centre - reach) - 1, 0)
            high = np.searchsorted(first, centre + reach, side="right")
            x = free.pop() if free else np.empty(shape, np.uint64)
            np.take(sets, high, axis=0, out=x, mode="clip")
            np.take(sets, low, axis=0, out=x1, mode="clip")
            x ^= x1
            # Three bitmaps of one weight become one of that weight and one of twice as much.
            level = 0
            while (y := waiting[level]) is not None:
                waiting[level] = None
                np.bitwise_xor(total[level], y, out=x1)
                y &= total[level]
                np.bitwise_and(x1, x, out=x2)
                np.bitwise_xor(x1, x, out=total[level])
                y |= x2
                free.append(x)
                x, level = y, level + 1
            waiting[level] = x
        for level, left in enumerate(waiting):
            for upper in range(level, len(total)) if left is not None else ():
                carry = total[upper] & left
                total[upper] ^= left
                left = carry
        more, same = np.zeros(shape, np.uint64), np.full(shape, ~np.uint64(0))
        for level in reversed(range(len(total))):
            if need >> level & 1:
                same &= total[level]
            else:
                more |= same & total[level]
                same &= ~total[level]
        return more | same


def search(ids: np.ndarray, v: np.ndarray, indexed: np.ndarray, asked: np.ndarray, a: np.ndarray, k: int, report: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, similarity) of the k nearest indexed rows of each asked row of one cell.

    Rows that are alike should stand together, as queries are verified a few at a time. ``report`` is given the number
    of queries and of the rows verified for them.
    """
    xi, xq = np.flatnonzero(indexed), np.flatnonzero(asked)
    if not len(xi) or not len(xq):
        return np.zeros(0, ids.dtype), np.zeros(0, ids.dtype), np.zeros(0)
    u = unit(v)
    ui, idi, n = u[xi], ids[xi], len(xi)
    h = (u @ a).T
    windows = Windows(np.ascontiguousarray(h[:, xi]))
    need = math.ceil(THRESHOLD * len(h))
    # The first radius: what is enough for the luckier ones of a few queries.
    trial = xq[:: max(1, len(xq) // 32)]
    near = np.sort(u[trial] @ ui.T, axis=1)[:, -min(k + 1, n)]
    begin = max(0.05, float(np.quantile(np.sqrt(np.maximum(0, 2 - 2 * near)), 0.2)))
    # Exact: sums of products in double precision, so that copies come out equal.
    norms = np.concatenate([np.sqrt((v[i : i + 1024].astype(np.float64) ** 2).sum(axis=1)) for i in range(0, len(v), 1024)])
    out_a, out_b, out_s, verified = [], [], [], 0
    for at in range(0, len(xq), QUERIES):
        mine = xq[at : at + QUERIES]
        seen = np.zeros((len(mine), windows.sets.shape[2]), np.uint64)
        top = np.full((len(mine), k), -np.inf, np.float32)
        todo, radius, found = np.arange(len(mine)), begin, []
        while len(todo):
            whole = radius >= WHOLE or n <= k
            hit = np.full((len(todo), seen.shape[1]), ~np.uint64(0)) if whole else windows.colliding(h[:, mine[todo]], HALF_WINDOW * radius, need)
            fresh = hit & ~seen[todo]
            seen[todo] |= hit
            fresh = np.unpackbits(fresh.view(np.uint8), axis=1, bitorder="little")[:, :n].view(bool)
            for i in range(0, len(todo), VERIFIED):
                who, rows = todo[i : i + VERIFIED], fresh[i : i + VERIFIED]
                columns = np.flatnonzero(rows.any(axis=0))
                if not len(columns):
                    continue
                rows = rows[:, columns] & (ids[mine[who]][:, None] != idi[columns])
                verified += int(rows.sum())
                s = np.where(rows, u[mine[who]] @ ui[columns].T, -np.inf)
                top[who] = -np.partition(-np.concatenate([top[who], s], axis=1), k - 1, axis=1)[:, :k]
                r, c = np.nonzero(s >= np.maximum(top[who].min(axis=1) - 1e-5, -2)[:, None])
                found.append((who[r], columns[c], s[r, c]))
            kth = top[todo].min(axis=1)
            todo = todo[:0] if whole else todo[np.sqrt(np.maximum(0, 2 - 2 * kth)) > radius]
            radius = min(radius * WIDEN, WHOLE)
        if not found:
            continue
        r, c, s = (np.concatenate(x) for x in zip(*found))
        keep = s >= top.min(axis=1)[r] - 1e-5
        r, c = r[keep], c[keep]
        exact = np.empty(len(r))
        for i in range(0, len(r), 4096):
            x, y = mine[r[i : i + 4096]], xi[c[i : i + 4096]]
            exact[i : i + 4096] = (v[x].astype(np.float64) * v[y]).sum(axis=1) / (norms[x] * norms[y])
        exact = exact.round(13)
        nb = idi[c]
        sort = np.lexsort((nb, -exact, r))
        r, nb, exact = r[sort], nb[sort], exact[sort]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        out_a.append(ids[mine[r[best]]])
        out_b.append(nb[best])
        out_s.append(exact[best])
    if report is not None:
        report["queries"], report["verified"] = report.get("queries", 0) + len(xq), report.get("verified", 0) + verified
    if not out_a:
        return np.zeros(0, ids.dtype), np.zeros(0, ids.dtype), np.zeros(0)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_s)


def _hash(v: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in v], np.uint64).view(np.int64)


def _luck(ids: np.ndarray, turn: int) -> np.ndarray:
    """A number from 0 to 1 per id and turn."""
    x = (ids.astype(np.uint64) + np.uint64(turn + 1) * np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


class Index:
    """Routing tables, fitted on bounded samples of (id, vector)."""

    def __init__(self, vectors: DataFrame, dims: int, k: int = 5, probes: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, least_rows: int = LEAST_ROWS, cell_rows: int = CELL_ROWS, splits: int = SPLITS):
        self.vectors, self.dims, self.cell_rows = vectors, dims, cell_rows
        self.a = projections(dims)
        sc = vectors.sparkSession.sparkContext
        n = vectors.count()
        share = min(1.0, sample / max(n, 1))
        picked = vectors.where(F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
        first = self._projected(picked)
        table = leaders(first, np.zeros((0, ROUTE), np.float32))
        self.table = sc.broadcast(table)
        for turn in range(rounds):
            led, orphans, rows, x = self._survey(sample if turn + 1 < rounds else 0)
            if orphans <= ORPHANS * max(rows, 1) or not len(x):
                break
            table = leaders(x, table)
            self.table = sc.broadcast(table)
        sizes = np.array([led.get(i, 0) for i in range(len(table))], np.int64)
        for turn in range(splits):
            hot = sizes > cell_rows // 2
            if not hot.any():
                break
            x = self._survey(sample, hot, min(1.0, sample / sizes[hot].sum()), turn)[3]
            finer = split_leaders(x, table, sizes, cell_rows // 2)
            if len(finer) == len(table):
                break
            table, self.table = finer, sc.broadcast(finer)
            led = self._survey(0)[0]
            sizes = np.array([led.get(i, 0) for i in range(len(table))], np.int64)
        cell = joined_cells(table, sizes, least_rows)
        self.cell = sc.broadcast(cell)
        self.probes, self.met = (probes, None) if probes else enough_probes(*self._trials(k, n), table, cell)
        if self.probes > PROBES[-1]:
            warnings.warn(f"the vectors fall into no clear cells: {self.probes} cells are searched per vector", stacklevel=2)
        per_cell = np.bincount(cell, weights=sizes, minlength=1)
        # Cells of many rows first, each to the part that has the fewest rows so far.
        self.parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(per_cell.sum() * self.probes * dims * 4 / PART_BYTES))
        part, load = np.zeros(len(per_cell), np.int32), [(0.0, i) for i in range(self.parts)]
        for c in np.argsort(-per_cell, kind="stable"):
            rows, least = heapq.heappop(load)
            part[c] = least
            heapq.heappush(load, (rows + per_cell[c], least))
        self.part = sc.broadcast(part)
        self.blocks = {int(c): math.ceil(per_cell[c] / cell_rows) for c in np.flatnonzero(per_cell > cell_rows)}

    def _projected(self, vectors: DataFrame) -> np.ndarray:
        """The sample's projections, at 2 bytes a value, to the driver; its size is bounded by ``sample``."""
        dims, a = self.dims, self.a

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                _, v = usable(b, dims)
                h = unit(v) @ a
                h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in h.astype(np.float16)], pa.binary())], names=["h"])

        rows = vectors.mapInArrow(run, "h binary").toArrow().column("h").to_pylist()
        return np.frombuffer(b"".join(rows), np.float16).reshape(-1, ROUTE).astype(np.float32)

    def _trials(self, k: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Some rows and, for each, its k nearest among all rows by brute force; all of them projected.

        A stated set of ``TRIALS`` queries at most against every row: each task keeps k rows a query.
        """
        dims, a, sc = self.dims, self.a, self.vectors.sparkSession.sparkContext
        luck = math.ceil(min(1.0, 2 * TRIALS / max(n, 1)) * (1 << 40))
        chosen = self.vectors.where(F.pmod(F.xxhash64(F.lit(SEED + 1), "_id"), F.lit(1 << 40)) < luck)
        batches = chosen.select("_id", "_e").toArrow().combine_chunks().to_batches()
        rows, v = usable(batches[0], dims) if batches else (np.zeros(0, int), np.zeros((0, dims), np.float32))
        asked, v = np.asarray(batches[0].column(0))[rows][:TRIALS] if len(rows) else np.zeros(0, np.int64), v[:TRIALS]
        if not len(v):
            return np.zeros((0, ROUTE), np.float32), []
        queries, ids = sc.broadcast(unit(v)), sc.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = np.full((len(ids.value), k), -np.inf, np.float32)
            held = np.zeros((len(ids.value), k, ROUTE), np.float16)
            for b in slices(batches):
                at, v = usable(b, dims)
                if not len(v):
                    continue
                u = unit(v)
                s = queries.value @ u.T
                s[ids.value[:, None] == np.asarray(b.column(0))[at][None, :]] = -np.inf
                best = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                h = u @ a
                h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
                both = np.concatenate([top, np.take_along_axis(s, best, axis=1)], axis=1)
                keep = np.argpartition(-both, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(both, keep, axis=1)
                held = np.take_along_axis(np.concatenate([held, h[best].astype(np.float16)], axis=1), keep[:, :, None], axis=1)
            q, j = np.nonzero(np.isfinite(top))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(top[q, j]), pa.array([held[x, y].tobytes() for x, y in zip(q, j)], pa.binary())], names=["q", "s", "h"])

        found = self.vectors.mapInArrow(run, "q int, s float, h binary")
        best = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "h")), asc=False), 1, k)["h"].alias("h")).collect()
        near = [np.zeros((0, ROUTE), np.float32)] * len(asked)
        for r in best:
            near[r["q"]] = np.frombuffer(b"".join(r["h"]), np.float16).reshape(-1, ROUTE).astype(np.float32)
        h = unit(v) @ a
        return h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12), near

    def _survey(self, sample: int, hot: np.ndarray | None = None, share: float = 1.0, turn: int = 0) -> tuple[dict[int, int], int, int, np.ndarray]:
        """One pass: rows per leader (summed per task first), rows unlike all leaders, and a sample of those.

        With ``hot`` the sample is a ``share`` of the rows of those leaders instead, by hash, another one per turn.
        """
        dims, a, table = self.dims, self.a, self.table
        parts = max(1, self.vectors.rdd.getNumPartitions())
        per_task = math.ceil(sample / parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(len(table.value), np.int64)
            orphans = rows = 0
            kept: list[bytes] = []
            for b in slices(batches):
                at, v = usable(b, dims)
                if not len(v):
                    continue
                u = unit(v)
                cells, best = route(u, table.value, a, 1)
                count += np.bincount(cells.ravel(), minlength=len(count))
                rows += len(v)
                orphans += int((best < ALIKE).sum())
                if hot is None:
                    chosen = np.flatnonzero(best < ALIKE)[: max(0, per_task - len(kept))]
                else:
                    chosen = np.flatnonzero(hot[cells.ravel()] & (_luck(np.asarray(b.column(0))[at], turn) < share))
                if len(chosen):
                    h = u[chosen] @ a
                    h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
                    kept += [r.tobytes() for r in h]
            full = np.flatnonzero(count)
            cell = [*full.tolist(), -1, -2, *[-3] * len(kept)]
            number = [*count[full].tolist(), orphans, rows, *[0] * len(kept)]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(number, pa.int64()), pa.array([*[None] * (len(full) + 2), *kept], pa.binary())], names=["cell", "n", "h"])

        out = checkpointed(self.vectors.mapInArrow(run, "cell int, n long, h binary"))
        # One row per leader (at most as many as rows were sampled) and the bounded sample come to the driver.
        sums = {r["cell"]: r["n"] for r in out.where("cell >= -2").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        rows, orphans = sums.pop(-2, 0), sums.pop(-1, 0)
        x = out.where("cell = -3").select("h").toArrow().column("h").to_pylist() if sample and (hot is not None or orphans > ORPHANS * max(rows, 1)) else []
        return sums, orphans, rows, np.frombuffer(b"".join(x), np.float32).reshape(-1, ROUTE)

    def routed(self, hashed_only: bool = False) -> DataFrame:
        """(_part, _cell, _index_block, _query_block, _lead, _role, _id, _h, _vector); role 1 is indexed, 2 asked, 3 both."""
        dims, a, table, cell, probes, blocks, part, parts = self.dims, self.a, self.table, self.cell, self.probes, self.blocks, self.part, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows, v = usable(b, dims)
                if not len(rows):
                    continue
                ids = np.asarray(b.column(0))[rows]
                h = _hash(v)
                if hashed_only:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h)], names=["_id", "_h"])
                    continue
                near, _ = route(unit(v), table.value, a, probes)
                payload = [r.tobytes() for r in v]
                out: list[tuple] = []
                for i, cs in enumerate(cell.value[near].tolist()):
                    for c in dict.fromkeys(cs):
                        n = blocks.get(c, 1)
                        if n == 1:
                            out.append((c, 0, 0, 3, i))
                            continue
                        ib, qb = int(h[i] ^ ids[i]) % n, int(ids[i] * 2654435761 >> 7) % n
                        out += [(c, ib, x, 3 if x == qb else 1, i) for x in range(n)]
                        out += [(c, x, qb, 2, i) for x in range(n) if x != ib]
                c, ib, qb, role, i = (list(x) for x in zip(*out))
                # Pairs of blocks of a hot cell are each a task's work.
                at = (part.value[c] + np.array(ib) * 31 + np.array(qb) * 977) % parts
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(c, pa.int32()), pa.array(ib, pa.int32()), pa.array(qb, pa.int32()), pa.array(near[i, 0]), pa.array(role, pa.int8()), pa.array(ids[i]), pa.array(h[i]), pa.array([payload[x] for x in i], pa.binary())], names=["_part", "_cell", "_index_block", "_query_block", "_lead", "_role", "_id", "_h", "_vector"])

        kind = "_id long, _h long" if hashed_only else "_part int, _cell int, _index_block int, _query_block int, _lead int, _role byte, _id long, _h long, _vector binary"
        return self.vectors.mapInArrow(run, kind)

    def neighbours(self, k: int) -> DataFrame:
        """(_id, _nb, _sim): the k nearest of every usable vector."""
        a = self.a[:, :COUNT]
        hashes = self.routed(hashed_only=True)
        groups = hashes.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > COPIES).select("_h")
        many = hashes.join(written(groups), "_h", "left_semi")
        # Of a large group of copies only the k + 1 smallest ids can be among anybody's k nearest.
        # Hot groups are cut down in two steps, so that no task gathers all ids of one.
        salted = many.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(512)))
        ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_h", "_salt").orderBy("_id"))).where(F.col("_r") <= k + 1)
        lowest = written(ranked.groupBy("_h").agg(F.slice(F.array_sort(F.collect_set("_id")), 1, k + 1).alias("_low")))
        last = lowest.select(F.col("_h").alias("_g"), F.array_max("_low").alias("_last"))
        routed = self.routed()
        # Either way of joining leaves the vectors where they are unless there are more large groups than can be broadcast.
        routed = routed.join(last, F.col("_h") == F.col("_g"), "left").where("_last is null or _id <= _last").drop("_last", "_g")
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            at = None

            def flush() -> Iterator[pa.RecordBatch]:
                if held:
                    role = np.concatenate([x[0] for x in held])
                    ids = np.concatenate([x[1] for x in held])
                    v = np.concatenate([x[2] for x in held])
                    i, nb, s = search(ids, v, (role & 1) > 0, (role & 2) > 0, a, k)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(nb), pa.array(s)], names=["_id", "_nb", "_sim"])

            for b in batches:
                if not b.num_rows:
                    continue
                key = np.stack([np.asarray(b.column(j)) for j in range(3)], axis=1)
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
                v = np.frombuffer(b"".join(b.column(6).to_pylist()), np.float32).reshape(-1, dims)
                role, ids = np.asarray(b.column(4)), np.asarray(b.column(5))
                for lo, hi in zip(cuts, cuts[1:]):
                    if at is not None and tuple(key[lo]) != at:
                        yield from flush()
                        held.clear()
                    at = tuple(key[lo])
                    held.append((role[lo:hi].copy(), ids[lo:hi].copy(), v[lo:hi].copy()))
            yield from flush()

        keys = ["_cell", "_index_block", "_query_block"]
        # Within a cell, rows of one leader stand together.
        ordered = routed.select(*keys, "_lead", "_role", "_id", "_vector", "_part").repartitionById(self.parts, F.col("_part")).sortWithinPartitions(*keys, "_lead")
        found = ordered.mapInArrow(run, "_id long, _nb long, _sim double")
        # At most probes x blocks x k rows per vector come together here.
        best = found.groupBy("_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("_sim")).alias("d"), F.col("_nb").alias("nb")))), 1, k).alias("_best"))
        near = best.select("_id", F.explode("_best").alias("b")).select("_id", F.col("b.nb").alias("_nb"), (-F.col("b.d")).alias("_sim"))
        rest = many.join(lowest, "_h").where("_id > array_max(_low)").select("_id", F.explode(F.slice("_low", 1, k)).alias("_nb"), F.lit(1.0).alias("_sim"))
        return near.unionByName(rest)


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, dims: int = 768, **options) -> DataFrame:
    """(key, neighbour, similarity): the k nearest vectors of every usable vector."""
    vectors = df.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_e")).where("_id is not null and _e is not null")
    out = Index(vectors, dims, k, **options).neighbours(k)
    return out.select(F.col("_id").alias(key), F.col("_nb").alias("neighbour"), F.col("_sim").alias("similarity"))


def pairs(neighbours: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b), smaller first, each once, of the pairs of which one is among the other's nearest."""
    return neighbours.select(F.least(key, "neighbour").alias("id_a"), F.greatest(key, "neighbour").alias("id_b")).distinct()
