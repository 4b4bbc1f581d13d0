"""Exact distributed Ward linkage (V4) by rounds of reciprocal-nearest-neighbour merges.

Ward is reducible, so every pair of clusters that are each other's nearest
neighbour can merge in the same round and the dendrogram equals the greedy one
(no ties assumed). The dissimilarity of two unit vectors is 1 - a.b. With the
cross sum ``s = Σ (1 - a.b)²`` over the members of two clusters and each
cluster's within sum ``sw`` (ordered pairs) the Ward distance is

    D²(X, Y) = 2 nX nY / (nX + nY) · ( s/(nX nY) − swX/(2 nX²) − swY/(2 nY²) )

which is exactly what repeated Lance-Williams updates produce.

No table of pairs is kept. A cluster's state is enough to find s: its member
vectors while they are few (``_most``), else its moments S = Σa and M = Σaaᵀ, as

    s = nX nY − 2 S_X·S_Y + ⟨M_X, M_Y⟩.

A nearest neighbour is a search over blocks of states. A block is one row, so
all pairs of blocks are a cross join of two short tables: no state is copied
into a shuffle, two bounded blocks are in a task at a time, and only the nearest
leaves it. The mean of squares is at least the square of the mean, so with the
mean vectors of two clusters

    s / (nX nY) >= (1 − x̄·ȳ)²,

and one product of means, in single precision with its rounding taken off, bounds
the distance from below. Sums s are taken, in double precision, only of pairs whose
bound is not above the nearest distance found so far: a few for each cluster.

Reducibility also says that a nearest neighbour stays the nearest until one of the
two is merged, so a round searches only for clusters that merged or whose
neighbour did. The written tables of a round are the states, their blocks and the
neighbours: O(clusters).

When few enough clusters are left that their states fit in one task, it goes on by
the same rule and the same search, without jobs; the last of them keep their sums
in a matrix.

Duplicate points enter as one point with a weight: their internal merges are at
height 0 and never change a cut. States are written to the shared checkpoint
folder every round, so lineage stays one round long and a lost executor only
repeats the current round; the states of the round before are then deleted.
"""

from __future__ import annotations

import functools
import logging
import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxpop.operators.ordering import numbered
from voxpop.session import drop_scratch, scratch_path

log = logging.getLogger(__name__)

#: Clusters in a block of those searched for, in a block of all, numbers that a block's states may hold, and products of members or numbers of moments in memory at once.
QUERY_BLOCK, STATE_BLOCK, BLOCK_NUMBERS, PRODUCTS = 1024, 2048, 1 << 22, 1 << 22
#: Clusters that one task finishes, the numbers that their states may hold, and the clusters whose sums it keeps in a matrix.
TAIL, TAIL_NUMBERS, MATRIX = 32_768, 1 << 23, 1024
#: Rows and columns of bounds at once, of a size that stays in a core's cache; products of members at once.
TILE, COLUMNS, PAIRS = 256, 2048, 1 << 15

MERGE_SCHEMA = "child long, parent long, height double, size double, round int"
#: k members ``mem`` (k vectors one after the other) with weights ``mw``, or the sum ``s`` and the packed moments ``m``.
STATE_SCHEMA = "cid long, n double, sw double, k int, mem array<double>, mw array<double>, s array<double>, m array<double>"
STATE = ["cid", "n", "sw", "k", "mem", "mw", "s", "m"]
#: A block of states as one row: the arrays of :class:`States`.
ARRAYS = {"cid": "i8", "n": "f8", "sw": "f8", "small": "?", "k": "i8", "w": "f8", "vecs": "f8", "s": "f8", "m": "f8", "mean": "f4"}
BLOCK_SCHEMA = "side int, block int, " + ", ".join(f"{c} binary" for c in ARRAYS)
NEAR_SCHEMA = "c long, n double, d double, o long, s double"
#: Beside a state: whether its nearest is asked for, else the nearest, how near it is and the cross sum.
NEAR = ["asked", "o", "d", "cross"]


def _most(d: int) -> int:
    """Most members that a state holds as vectors: beyond that the moments are fewer numbers."""
    return max(8, d // 2)


@functools.cache
def _triangle(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the upper triangle of a matrix laid out in one row, and their weights."""
    i, j = np.triu_indices(d)
    return i * d + j, np.where(i == j, 1.0, math.sqrt(2.0))


def _packed(vecs: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Σ w a aᵀ as a vector whose dot products are those of the matrices."""
    moments = (vecs * w[:, None]).T @ vecs
    at, weights = _triangle(vecs.shape[1])
    return moments.ravel()[at] * weights


def _numbers(d: int) -> int:
    """How many numbers the moments of a cluster are, with its size."""
    return 1 + d + d * (d + 1) // 2


class States:
    """Cluster states of one block, in the order of their ids."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("cid")
        small = pdf["mem"].notna().to_numpy()
        few, many = pdf[small], pdf[~small]
        none = np.empty(0)
        self._hold({
            "cid": pdf["cid"].to_numpy(np.int64), "n": pdf["n"].to_numpy(np.float64), "sw": pdf["sw"].to_numpy(np.float64),
            "small": small, "k": few["k"].to_numpy(np.int64),
            "w": np.concatenate(few["mw"].to_list()) if len(few) else none, "vecs": np.concatenate(few["mem"].to_list()) if len(few) else none,
            "s": np.concatenate(many["s"].to_list()) if len(many) else none, "m": np.concatenate(many["m"].to_list()) if len(many) else none})

    @classmethod
    def of_table(cls, t: pa.Table) -> States:
        """From rows of states, in the order of their ids."""
        out = cls.__new__(cls)
        column = lambda c, kind: t[c].combine_chunks().to_numpy(zero_copy_only=False).astype(kind, copy=False)
        flat = lambda c: pc.list_flatten(t[c].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        small = t["mem"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        out._hold({"cid": column("cid", np.int64), "n": column("n", np.float64), "sw": column("sw", np.float64), "small": small,
                   "k": column("k", np.int64)[small], "w": flat("mw"), "vecs": flat("mem"), "s": flat("s"), "m": flat("m")})
        return out

    @classmethod
    def of_row(cls, columns: dict[str, pa.Array], at: int) -> States:
        """From one row of a table of blocks."""
        out = cls.__new__(cls)
        out._hold({c: np.frombuffer(columns[c][at].as_buffer(), kind) for c, kind in ARRAYS.items()})
        return out

    def _hold(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        self.cid, self.n, self.sw, self.small, self.k, self.w = (arrays[c] for c in ("cid", "n", "sw", "small", "k", "w"))
        self.starts = np.r_[0, np.cumsum(self.k)]
        self.vecs = arrays["vecs"].reshape(len(self.w), -1) if len(self.w) else np.empty((0, 0))
        n_many = len(self.cid) - len(self.k)
        self._s, self._m = (arrays[c].reshape(n_many, -1) if n_many else None for c in ("s", "m"))
        self.d = self.vecs.shape[1] if len(self.w) else self._s.shape[1]
        self._place = np.where(self.small, np.cumsum(self.small), np.cumsum(~self.small)) - 1  # among the small ones, or the others
        self._features: np.ndarray | None = None
        self._rows: dict[int, np.ndarray] = {}
        if "mean" not in arrays:
            total = np.empty((len(self.cid), self.d))
            if len(self.k):
                total[self.small] = np.add.reduceat(self.vecs * self.w[:, None], self.starts[:-1], axis=0)
            if n_many:
                total[~self.small] = self._s
            arrays["mean"] = (total / self.n[:, None]).astype(np.float32).ravel()
        self.mean = arrays["mean"].reshape(len(self.cid), self.d)
        self.within = self.sw / (2.0 * self.n**2)

    def feature(self, row: int) -> np.ndarray:
        """n, S and M of one cluster; kept, for the few that are asked for again and again."""
        if (found := self._rows.get(row)) is None:
            at, out = self._place[row], np.empty(_numbers(self.d))
            out[0] = self.n[row]
            if self.small[row]:
                a, b = self.starts[at], self.starts[at + 1]
                out[1 : self.d + 1], out[self.d + 1 :] = self.w[a:b] @ self.vecs[a:b], _packed(self.vecs[a:b], self.w[a:b])
            else:
                out[1 : self.d + 1], out[self.d + 1 :] = self._s[at], self._m[at]
            if (len(self._rows) + 1) * len(out) > PRODUCTS:
                self._rows.clear()
            self._rows[row] = found = out
        return found

    def merged(self, i: np.ndarray, j: np.ndarray, cross: np.ndarray) -> States:
        """With the clusters ``j`` merged into ``i``, whose cross sums are ``cross``."""
        gone, changed = np.zeros(len(self.cid), bool), np.zeros(len(self.cid), bool)
        gone[j], changed[i] = True, True
        n, sw, target = self.n.copy(), self.sw.copy(), np.arange(len(self.cid))
        n[i] += n[j]
        sw[i] += sw[j] + 2.0 * cross
        target[j] = i
        owner = target[np.repeat(np.flatnonzero(self.small), self.k)]
        k = np.bincount(owner, minlength=len(self.cid))
        many = ~self.small
        many[i] |= many[j] | (k[i] > _most(self.d))
        held = np.flatnonzero(~many[owner])
        order = held[np.argsort(owner[held], kind="stable")]
        small = ~many & ~gone
        of = np.full(len(self.cid), -1)
        of[i] = j
        rows = np.flatnonzero(many & ~gone)
        s, m = np.empty((len(rows), self.d)), np.empty((len(rows), _numbers(self.d) - 1 - self.d))
        kept = ~changed[rows]
        if kept.any():
            s[kept], m[kept] = self._s[self._place[rows[kept]]], self._m[self._place[rows[kept]]]
        for at in np.flatnonzero(~kept).tolist():
            total = self.feature(rows[at]) + self.feature(of[rows[at]])
            s[at], m[at] = total[1 : self.d + 1], total[self.d + 1 :]
        out = type(self).__new__(type(self))
        out._hold({"cid": self.cid[~gone], "n": n[~gone], "sw": sw[~gone], "small": small[~gone], "k": k[small],
                   "w": self.w[order], "vecs": self.vecs[order].ravel(), "s": s.ravel(), "m": m.ravel()})
        return out

    def features(self, rows: np.ndarray) -> np.ndarray:
        """n, S and M of these clusters, one in a row; those of a block that is no wider than PRODUCTS are kept."""
        if self._features is not None:
            return self._features[rows]
        whole = len(self.cid) * _numbers(self.d) <= PRODUCTS
        of = np.arange(len(self.cid)) if whole else rows
        out = np.empty((len(of), _numbers(self.d)))
        out[:, 0] = self.n[of]
        for row, x in enumerate(of):
            at = self._place[x]
            if self.small[x]:
                a, b = self.starts[at], self.starts[at + 1]
                out[row, 1 : self.d + 1], out[row, self.d + 1 :] = self.w[a:b] @ self.vecs[a:b], _packed(self.vecs[a:b], self.w[a:b])
            else:
                out[row, 1 : self.d + 1], out[row, self.d + 1 :] = self._s[at], self._m[at]
        if whole:
            self._features = out
            return out[rows]
        return out


def cross_sums(x: States, y: States) -> np.ndarray:
    """s for every cluster of ``x`` (rows) with every one of ``y``."""
    out = np.zeros((len(x.cid), len(y.cid)))
    if x.small.any() and y.small.any():
        rows, cols = np.flatnonzero(x.small), np.flatnonzero(y.small)
        step = max(1, PRODUCTS // max(1, len(y.w) * int(x.k.max())))
        single = len(x.w) == len(x.k) and len(y.w) == len(y.k)
        weighted = (x.w != 1).any() or (y.w != 1).any()
        for a in range(0, len(rows), step):
            b = min(a + step, len(rows))
            part = slice(x.starts[a], x.starts[b])
            d2 = x.vecs[part] @ y.vecs.T
            np.subtract(1.0, d2, out=d2)
            np.maximum(0.0, d2, out=d2)
            np.square(d2, out=d2)
            if weighted:
                d2 *= x.w[part, None]
                d2 *= y.w[None, :]
            if not single:
                d2 = np.add.reduceat(np.add.reduceat(d2, y.starts[:-1], axis=1), x.starts[a:b] - x.starts[a], axis=0)
            out[np.ix_(rows[a:b], cols)] = d2
    for of_x, of_y in ((~x.small, np.ones(len(y.cid), bool)), (x.small, ~y.small)):
        rows, cols = np.flatnonzero(of_x), np.flatnonzero(of_y)
        step = max(1, PRODUCTS // _numbers(x.d))
        for c in range(0, len(cols) if len(rows) else 0, step):
            right = y.features(cols[c : c + step])
            right[:, 1 : y.d + 1] *= -2.0
            for r in range(0, len(rows), step):
                out[np.ix_(rows[r : r + step], cols[c : c + step])] = np.maximum(0.0, x.features(rows[r : r + step]) @ right.T)
    return out


def ward_distances(s: np.ndarray, x: States, y: States) -> np.ndarray:
    nx, ny = x.n[:, None], y.n[None, :]
    d2 = (2.0 * nx * ny / (nx + ny)) * (s / (nx * ny) - (x.sw / (2.0 * x.n**2))[:, None] - (y.sw / (2.0 * y.n**2))[None, :])
    d = np.sqrt(np.maximum(d2, 0.0))
    d[x.cid[:, None] == y.cid[None, :]] = np.inf
    return d


def pair_sums(x: States, p: np.ndarray, y: States, q: np.ndarray) -> np.ndarray:
    """s for each cluster ``p`` of ``x`` with the cluster ``q`` of ``y`` that stands beside it."""
    out = np.empty(len(p))
    members = x.small[p] & y.small[q]
    px, py = x._place[p], y._place[q]
    each = np.zeros(len(p), np.int64)
    each[members] = x.k[px[members]] * y.k[py[members]]
    few = np.flatnonzero(members & (each <= 16))
    part = (np.cumsum(each[few]) - each[few]) // PAIRS
    for at in np.split(few, np.flatnonzero(np.diff(part)) + 1) if len(few) else []:
        first = np.cumsum(each[at]) - each[at]
        pair = np.repeat(at, each[at])
        pos = np.arange(len(pair)) - np.repeat(first, each[at])
        ky = y.k[py[pair]]
        left, right = x.starts[px[pair]] + pos // ky, y.starts[py[pair]] + pos % ky
        d2 = np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x.vecs[left], y.vecs[right])) ** 2 * x.w[left] * y.w[right]
        out[at] = np.add.reduceat(d2, first)
    for r in np.flatnonzero(members & (each > 16)).tolist():
        a, b = slice(*x.starts[px[r] : px[r] + 2]), slice(*y.starts[py[r] : py[r] + 2])
        d2 = 1.0 - x.vecs[a] @ y.vecs[b].T
        np.maximum(0.0, d2, out=d2)
        np.square(d2, out=d2)
        out[r] = x.w[a] @ d2 @ y.w[b]
    for r in np.flatnonzero(~members).tolist():
        f, g = x.feature(int(p[r])), y.feature(int(q[r]))
        out[r] = max(0.0, f @ g - 3.0 * (f[1 : x.d + 1] @ g[1 : x.d + 1]))
    return out


class Nearest:
    """The nearest found so far for the clusters of ``x``, ties to the smaller id."""

    def __init__(self, x: States):
        self.x = x
        self.d, self.o, self.s = np.full(len(x.cid), np.inf), np.zeros(len(x.cid), np.int64), np.zeros(len(x.cid))

    def _take(self, p: np.ndarray, y: States, q: np.ndarray) -> None:
        """Compares the nearest of the clusters ``p`` with the clusters ``q`` of ``y`` that stand beside them."""
        x = self.x
        s = pair_sums(x, p, y, q)
        nx, ny = x.n[p], y.n[q]
        d = np.sqrt(np.maximum((2.0 * nx * ny / (nx + ny)) * (s / (nx * ny) - x.within[p] - y.within[q]), 0.0))
        order = np.lexsort((y.cid[q], d, p))
        order = order[np.r_[True, np.diff(p[order]) > 0]]
        p, d, o, s = p[order], d[order], y.cid[q[order]], s[order]
        new = (d < self.d[p]) | (d == self.d[p]) & (o < self.o[p])
        self.d[p[new]], self.o[p[new]], self.s[p[new]] = d[new], o[new], s[new]

    def search(self, y: States, rows: np.ndarray | None = None) -> None:
        """Looks for nearer ones among the clusters of ``y``, for the clusters ``rows`` or all."""
        x = self.x
        rows = np.arange(len(x.cid)) if rows is None else rows
        # what rounding in single precision can add to a bound: 1 - x.y is at most 2
        slack = 4.0 * (x.d + 8) * 2.0**-24 + 2e-6
        within, part = (x.within + slack).astype(np.float32), (0.5 / x.n).astype(np.float32)
        within_y, part_y = y.within.astype(np.float32), (0.5 / y.n).astype(np.float32)
        ones = not x.within.any() and not y.within.any() and (x.n == 1).all() and (y.n == 1).all()
        columns = max(1, min(COLUMNS, PRODUCTS))
        step = max(1, min(TILE, PRODUCTS // min(len(y.cid), columns)))
        for c in range(0, len(y.cid), columns):
            cols = slice(c, min(c + columns, len(y.cid)))
            right = np.ascontiguousarray(y.mean[cols].T)
            for r in range(0, len(rows), step):
                at = rows[r : r + step]
                low = x.mean[at] @ right
                np.subtract(1.0, low, out=low)
                np.multiply(low, low, out=low)
                low -= within[at, None]
                if not ones:
                    low -= within_y[None, cols]
                    low /= part[at, None] + part_y[None, cols]
                same, end = (np.searchsorted(y.cid[cols], x.cid[at], side) for side in ("left", "right"))
                for k in range(int((end - same).max())):  # itself
                    own = np.flatnonzero(same + k < end)
                    low[own, same[own] + k] = np.inf
                first = low.argmin(1)
                least = low[np.arange(len(at)), first]
                ask = np.flatnonzero((least <= self.d[at] ** 2) & np.isfinite(least))
                if not len(ask):
                    continue
                self._take(at[ask], y, first[ask] + c)
                low[ask, first[ask]] = np.inf
                of, q = np.nonzero(low[ask] <= (self.d[at[ask]] ** 2)[:, None])
                for a in range(0, len(of), PAIRS):
                    self._take(at[ask[of[a : a + PAIRS]]], y, q[a : a + PAIRS] + c)


def _to_block(table: pa.Table) -> pa.Table:
    x = States.of_table(table.sort_by("cid"))
    row = {c: pa.array([table[c][0].as_py()], pa.int32()) for c in ("side", "block")}
    return pa.table(row | {c: pa.array([x.arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in ARRAYS.items()})


def state_blocks(states: DataFrame, n_asked: int, size: tuple[int, int]) -> DataFrame:
    """Blocks of ``states`` as rows: on side 0 the ``n_asked`` that are ``asked`` for their nearest, on side 1 all.

    ``size``: the clusters and the numbers that their states hold.
    """
    wide = math.ceil(size[1] / BLOCK_NUMBERS)
    block = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int").alias("block")
    # large blocks are sent seldom; as many tasks as run at once get one, if it is not too small for its task
    busy = min(states.sparkSession.sparkContext.defaultParallelism, math.ceil(4 * n_asked / QUERY_BLOCK))
    left = states.where("asked").select(F.lit(0).alias("side"), block(max(1, busy, math.ceil(n_asked / QUERY_BLOCK), math.ceil(wide * n_asked / size[0]))), *STATE)
    right = states.select(F.lit(1).alias("side"), block(max(math.ceil(size[0] / STATE_BLOCK), wide)), *STATE)
    return left.unionByName(right).groupBy("side", "block").applyInArrow(_to_block, BLOCK_SCHEMA)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest for the clusters of a left block, over the right blocks that stand beside it one after the other."""
    at, best = None, None

    def done() -> Iterator[pa.RecordBatch]:
        if at is not None and (found := np.isfinite(best.d)).any():
            rows = {"c": best.x.cid, "n": best.x.n, "d": best.d, "o": best.o, "s": best.s}
            yield pa.RecordBatch.from_pydict({c: pa.array(v[found]) for c, v in rows.items()})

    for batch in batches:
        left = {c: batch.column(c) for c in ARRAYS}
        right = {c: batch.column(f"{c}2") for c in ARRAYS}
        for row, block in enumerate(batch.column("block").to_pylist()):
            if block != at:
                yield from done()
                at, best = block, Nearest(States.of_row(left, row))
            best.search(States.of_row(right, row))
    yield from done()


def nearest_clusters(blocks: DataFrame, numbers: int | None = None) -> DataFrame:
    """(c, n, o, d, s): for every cluster on side 0 of ``blocks`` its nearest other one on side 1, ties to the smaller id.

    ``blocks`` is a written table: the cross join reads the blocks on the right once for each task of the left.
    ``numbers``: what all states hold; a task has at most about BLOCK_NUMBERS of the right in memory, or one block.
    """
    left = blocks.where("side = 0").select("block", *ARRAYS)
    right = blocks.where("side = 1").select(*[F.col(c).alias(f"{c}2") for c in ARRAYS])
    if numbers is not None:
        right = right.coalesce(max(1, math.ceil(numbers / BLOCK_NUMBERS)))
    dealt = left.repartitionByRange(max(1, left.count()), "block")
    found = dealt.crossJoin(right).mapInArrow(_nearest, NEAR_SCHEMA)
    return found.groupBy("c").agg(F.min(F.struct("d", "o", "s", "n")).alias("x")).select("c", "x.n", "x.o", "x.d", "x.s")


def _joined_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state of a merged cluster from those of its two parts: members, or moments when they get many."""
    for f in batches:
        out = []
        for r in f.itertuples(index=False):
            mem = mw = total = moments = None
            k = r.k + r.k2
            vecs, weights, sums, packed = [], [], [], []
            for v, w, s, m in ((r.mem, r.mw, r.s, r.m), (r.mem2, r.mw2, r.s2, r.m2)):
                if v is not None:
                    vecs.append(np.asarray(v).reshape(len(w), -1))
                    weights.append(np.asarray(w))
                else:
                    sums.append(np.asarray(s))
                    packed.append(np.asarray(m))
            if not sums and k <= _most(vecs[0].shape[1]):
                mem, mw = np.concatenate(vecs).ravel(), np.concatenate(weights)
            else:
                total = sum([w @ v for v, w in zip(vecs, weights, strict=True)] + sums)
                moments = sum([_packed(v, w) for v, w in zip(vecs, weights, strict=True)] + packed)
            out.append((r.cid, r.n + r.n2, r.sw + r.sw2 + 2.0 * r.cross, k, mem, mw, total, moments))
        yield pd.DataFrame(out, columns=STATE)


def _tail_task(round0: int):
    """Finish the last (bounded) clusters in one task by the same rule: first by the same search, then, when
    few are left, with a matrix of cross sums, which add up where clusters merge."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        x, out, rnd = States.of_table(table), [], round0
        names, x.cid = x.cid, np.arange(len(x.cid))  # an id may come twice
        near = Nearest(x)
        known = ~table["asked"].combine_chunks().to_numpy(zero_copy_only=False)
        for mine, c in ((near.d, "d"), (near.o, "o"), (near.s, "cross")):
            mine[known] = table[c].combine_chunks().filter(pa.array(known)).to_numpy(zero_copy_only=False)
        near.o[known] = np.searchsorted(names, near.o[known])
        while len(x.cid) > max(1, MATRIX):
            rnd += 1
            near.search(x, np.flatnonzero(~np.isfinite(near.d)))
            at = np.searchsorted(x.cid, near.o)
            i = np.flatnonzero((near.o[at] == x.cid) & (x.cid < near.o))
            if not len(i):  # cannot happen for finite distances
                raise ValueError("no two clusters are the nearest of each other")
            j = at[i]
            out.append((x.cid[j], x.cid[i], near.d[i], x.n[i] + x.n[j], np.full(len(i), rnd)))
            ends = np.zeros(len(x.cid), bool)
            ends[i] = ends[j] = True
            still, left = ~(ends | ends[at]), np.ones(len(x.cid), bool)
            left[j] = False
            x = x.merged(i, j, near.s[i])
            was, near = near, Nearest(x)
            for now, old in ((near.d, was.d), (near.o, was.o), (near.s, was.s)):
                now[still[left]] = old[left & still]
        s, n, sw = cross_sums(x, x), x.n.copy(), x.sw.copy()
        alive = np.ones(len(n), dtype=bool)
        while alive.sum() > 1:
            rnd += 1
            at = np.flatnonzero(alive)
            nx, ny = n[at][:, None], n[at][None, :]
            within = sw[at] / (2.0 * n[at] ** 2)
            d = np.sqrt(np.maximum((2.0 * nx * ny / (nx + ny)) * (s[np.ix_(at, at)] / (nx * ny) - within[:, None] - within[None, :]), 0.0))
            np.fill_diagonal(d, np.inf)
            near = d.argmin(1)  # ties: the smaller id
            i = np.flatnonzero((near[near] == np.arange(len(at))) & (np.arange(len(at)) < near))
            a, b = at[i], at[near[i]]
            out.append((x.cid[b], x.cid[a], d[i, near[i]], n[a] + n[b], np.full(len(i), rnd)))
            for a, b in zip(a, b, strict=True):
                sw[a] += sw[b] + 2.0 * s[a, b]
                s[a, :] += s[b, :]
                s[:, a] += s[:, b]
                n[a] += n[b]
                alive[b] = False
        kinds = (("child", "i8"), ("parent", "i8"), ("height", "f8"), ("size", "f8"), ("round", "i4"))
        rows = {c: np.concatenate([part[k] for part in out]).astype(kind) for k, (c, kind) in enumerate(kinds)}
        return pa.table(rows | {c: names[rows[c]] for c in ("child", "parent")})

    return run


def ward_merges(points: DataFrame, tail_clusters: int = TAIL) -> DataFrame:
    """V4. ``points(id, w, unit)``: distinct points with multiplicity and unit vectors of one length.

    Returns the merge table ``(child, parent, height, size, round)``: ``child`` is
    absorbed into ``parent`` (the smaller id, so a cluster's id is always its
    smallest member id); ``size`` counts weighted rows of the merged cluster.

    Rounds run as DataFrame jobs while more than ``tail_clusters`` clusters are
    left, or the states of the rest are too wide for one task; the bounded rest (a
    constant that does not grow with the data) is finished by the same rule in
    one NumPy task.
    """
    spark = points.sparkSession
    none = F.lit(None).cast("array<double>")
    first = points.select(F.col("id").cast("long").alias("cid"), F.col("w").cast("double").alias("n"), F.lit(0.0).alias("sw"), F.lit(1).alias("k"),
                          F.col("unit").cast("array<double>").alias("mem"), F.array(F.col("w").cast("double")).alias("mw"), none.alias("s"), none.alias("m"))

    fresh = [F.lit(True).alias("asked"), F.lit(None).cast("long").alias("o"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("cross")]
    states, states_path = _kept(first.select(*STATE, *fresh), "ward-states")
    d = (states.select(F.size("mem").alias("d")).first() or [0])[0]
    # members up to _most(d), moments beyond
    held = F.when(F.col("k") <= _most(d), F.col("k").cast("long") * d).otherwise(F.lit(_numbers(d)))
    sizes = [F.count(F.lit(1)), F.sum(held), F.count_if("asked")]
    *size, n_asked = states.agg(*sizes).first()
    parts: list[DataFrame] = []
    rnd = 0
    while size[0] > max(1, tail_clusters) or size[0] > 1 and size[1] > TAIL_NUMBERS:
        rnd += 1
        t_round = time.time()
        blocks, blocks_path = _kept(state_blocks(states, n_asked, size), "ward-blocks")
        known = states.where(~F.col("asked")).select(F.col("cid").alias("c"), "n", "d", "o", F.col("cross").alias("s"))
        found = nearest_clusters(blocks, size[1]).select("c", "n", "d", "o", "s")
        now, now_path = _kept(known.unionByName(found), "ward-near")
        a, b = now.alias("a"), now.alias("b")
        mutual = (a.join(b, (F.col("a.o") == F.col("b.c")) & (F.col("b.o") == F.col("a.c"))).where(F.col("a.c") < F.col("b.c"))
                  .select(F.col("b.c").alias("child"), F.col("a.c").alias("parent"), F.col("a.d").alias("height"),
                          (F.col("a.n") + F.col("b.n")).alias("size"), F.lit(rnd).alias("round"), F.col("a.s").alias("cross")))
        record, _ = _kept(mutual, "ward-merges")
        n_merge = record.count()
        if n_merge == 0:  # cannot happen for finite distances: the global closest pair is mutual
            break
        parts.append(record.drop("cross"))
        # what becomes of each cluster: the pair it merges in, or its nearest if that stays
        gone = record.select(F.explode(F.array("child", "parent")).alias("c"), "parent", F.col("cross").alias("sum"))
        fate = (now.join(gone, "c", "left").join(gone.select(F.col("c").alias("o"), F.lit(True).alias("lost")), "o", "left")
                .select(F.col("c").alias("cid"), "parent", "sum", F.coalesce("lost", F.lit(False)).alias("asked"), "o", "d", F.col("s").alias("cross")))
        dealt, dealt_path = _kept(states.select(*STATE).join(fate, "cid"), "ward-dealt")
        alone = dealt.where(F.col("parent").isNull()).select(*STATE, *NEAR)
        up = dealt.where(F.col("parent") == F.col("cid")).select(*STATE, F.col("sum").alias("cross"))
        down = dealt.where(F.col("parent") != F.col("cid")).select(F.col("parent").alias("cid"), *[F.col(c).alias(f"{c}2") for c in STATE[1:]])
        merged = up.join(down, "cid").mapInPandas(_joined_states, STATE_SCHEMA).select(*STATE, *fresh)
        nxt, nxt_path = _kept(alone.unionByName(merged), "ward-states")
        drop_scratch(spark, states_path, blocks_path, now_path, dealt_path)
        states, states_path = nxt, nxt_path
        searched = n_asked
        *size, n_asked = states.agg(*sizes).first()
        log.info("ward round %d: %d searched, %d merges, %d clusters left, %.1fs", rnd, searched, n_merge, size[0], time.time() - t_round)
    if size[0] > 1:
        tail = states.groupBy(F.lit(0).alias("g")).applyInArrow(_tail_task(rnd), MERGE_SCHEMA)
        parts.append(_kept(tail, "ward-tail")[0])
    drop_scratch(spark, states_path)
    if not parts:
        return spark.createDataFrame([], MERGE_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


CUT_BLOCK = 65_536  # leaves whose clusters one task finds at once


def leaf_order(points: DataFrame, merges: DataFrame) -> DataFrame:
    """``(id, height, leaf)``: the leaves of the dendrogram, numbered from 1 so that every cluster is an
    interval of them, each with the height at which the cluster it gives its name to is absorbed (null: never).

    A cluster's name is its smallest member, and an absorbed cluster is laid behind what its parent
    held before, so the member that names a cluster opens its interval. A leaf's place is the sum of
    the offsets on its path to the root, found by pointer doubling: a path is at most as long as there
    are rounds, and leaves that have arrived are not joined again.
    """
    n_rounds = merges.agg(F.max("round")).first()[0] or 0
    pts = points.select(F.col("id").cast("long").alias("id"), F.col("w").cast("double").alias("w"))
    # one merge of a parent a round: the rows of its window are its merges, not its members
    mine = Window.partitionBy("parent").orderBy("round")
    par = (merges.withColumn("held", F.lag("size").over(mine)).join(pts.select(F.col("id").alias("parent"), "w"), "parent")
           .select(F.col("child").alias("id"), F.col("parent").alias("to"), F.coalesce("held", "w").alias("place"), "height"))
    start = pts.select("id").join(par, "id", "left")
    walk, path = _kept(start.select("id", F.coalesce("to", "id").alias("to"), F.coalesce("place", F.lit(0.0)).alias("place"),
                                    "height", F.col("to").isNull().alias("arrived")), "cut-walk")
    for _ in range(math.ceil(math.log2(max(n_rounds, 1))) + 1):
        ahead = walk.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("place").alias("place2"), F.col("arrived").alias("arrived2"))
        moved = walk.where(~F.col("arrived")).join(ahead, "to").select(
            "id", F.col("to2").alias("to"), (F.col("place") + F.col("place2")).alias("place"), "height", F.col("arrived2").alias("arrived"))
        walk, now = _kept(walk.where("arrived").unionByName(moved), "cut-walk")
        drop_scratch(points.sparkSession, path)
        path = now
    return numbered(walk, [], [F.col("to").asc(), F.col("place").asc()], "leaf").select("id", "height", "leaf")


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def flat_clusters(points: DataFrame, merges: DataFrame, cuts: DataFrame) -> DataFrame:
    """V5 for many cuts at once: ``points(id, w)``, ``cuts(th, t)`` -> ``(th, id, rep)``.

    Heights grow along every path (Ward is monotone), so at cut t a leaf opens a cluster
    if what it names is absorbed above t, and a leaf's cluster is the last one opened up
    to it in leaf order: one sorted pass for all cuts. Blocks of leaves run alone; the
    cluster that is open where a block begins comes from a table of one row per block.
    """
    grid = [(float(r.th), float(r.t)) for r in cuts.collect()]  # the small, fixed threshold grid
    leaves = leaf_order(points, merges).withColumn("block", F.floor((F.col("leaf") - 1) / CUT_BLOCK))
    opened = [F.when(F.col("height").isNull() | (F.col("height") > t), F.col("id")) for _, t in grid]
    so_far = Window.partitionBy("block").orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)
    inner = leaves.select("id", "block", *[F.last(o, ignorenulls=True).over(so_far).alias(f"r{i}") for i, o in enumerate(opened)])
    blocks = leaves.groupBy("block").agg(*[F.max_by(o, F.when(o.isNotNull(), F.col("leaf"))).alias(f"e{i}") for i, o in enumerate(opened)])
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over blocks, not leaves
    carried = blocks.select("block", *[F.last(f"e{i}", ignorenulls=True).over(before).alias(f"c{i}") for i in range(len(grid))])
    reps = [F.struct(F.lit(th).alias("th"), F.coalesce(f"r{i}", f"c{i}").alias("rep")) for i, (th, _) in enumerate(grid)]
    return inner.join(carried, "block").select("id", F.explode(F.array(*reps)).alias("x")).select("x.th", "id", "x.rep")
