import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.ward_numpy import cut, greedy_ward
from voxpop.operators import vectors as V
from voxpop.operators import ward as WD


def _load(spark, n):
    e = (spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where(F.col("vec_id") < n)
         .select(F.col("vec_id").alias("id"), "embedding"))
    rows = sorted(e.collect(), key=lambda r: r.id)
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(1 - x @ x.T, 0)
    np.fill_diagonal(d, 0)
    return e, d


def _spark_cut(merges, n, t):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in sorted(merges, key=lambda r: r.round):
        if r.height <= t:
            parent[r.child] = r.parent
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), set()).add(i)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("tail", [1, 40, 256])
def test_ward_equals_greedy(spark, monkeypatch, tail):
    n = 120
    e, d = _load(spark, n)
    monkeypatch.setattr(WD, "QUERY_BLOCK", 32)
    monkeypatch.setattr(WD, "STATE_BLOCK", 50)
    pts = V.normalize(e, "embedding", "unit").select("id", F.lit(1).alias("w"), "unit")
    merges = WD.ward_merges(pts, tail_clusters=tail).collect()
    ref = greedy_ward(d)
    assert len(merges) == n - 1
    hs = sorted(r.height for r in merges)
    hr = sorted(h for _, _, h in ref)
    assert np.allclose(hs, hr, rtol=1e-9, atol=1e-12)
    # monotone along every path: a parent's later merge is never lower
    for t in np.quantile(hr, [0.2, 0.5, 0.8, 0.95]):
        assert _spark_cut(merges, n, t) == cut(n, ref, t)


def test_ward_weights_equal_duplicates(spark):
    """A point with weight 2 behaves like two identical points."""
    n = 40
    e, d = _load(spark, n)
    w = np.ones(n)
    w[3] = 2
    pts = V.normalize(e, "embedding", "unit").select("id", F.when(F.col("id") == 3, 2).otherwise(1).alias("w"), "unit")
    merges = WD.ward_merges(pts, tail_clusters=1).collect()
    # duplicate row 3 as row n
    d2 = np.zeros((n + 1, n + 1))
    d2[:n, :n] = d
    d2[n, :n] = d[3]
    d2[:n, n] = d[3]
    ref = [m for m in greedy_ward(d2) if m[2] > 0]
    hs = sorted(r.height for r in merges)
    hr = sorted(h for _, _, h in ref)
    assert np.allclose(hs, hr, rtol=1e-9, atol=1e-12)


def _states(rng, sizes, d, small):
    rows, members = [], []
    for i, k in enumerate(sizes):
        v = rng.normal(size=(k, d))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        w = rng.integers(1, 4, k).astype(float)
        within = (w[:, None] * w[None, :] * (1 - v @ v.T) ** 2).sum()
        held = (v.ravel(), w, None, None) if small(i) else (None, None, w @ v, WD._packed(v, w))
        rows.append((i, w.sum(), within, k, *held))
        members.append((v, w))
    return WD.States(pd.DataFrame(rows, columns=WD.STATE)), members


@pytest.mark.parametrize("small", [lambda i: True, lambda i: False, lambda i: i % 3 > 0])
def test_cross_sums_of_members_and_moments(small):
    rng = np.random.default_rng(5)
    x, left = _states(rng, [1, 4, 2, 9, 1, 3], 7, small)
    y, right = _states(rng, [2, 1, 5, 1], 7, lambda i: not small(i) or i == 0)
    brute = [[(w[:, None] * u[None, :] * (1 - a @ b.T) ** 2).sum() for b, u in right] for a, w in left]
    assert np.allclose(WD.cross_sums(x, y), brute, rtol=1e-12, atol=1e-12)


def test_no_table_of_a_round_outgrows_the_clusters(spark, monkeypatch):
    """What a round writes: one row per cluster in the states and the neighbours, one per merge."""
    e, _ = _load(spark, 90)
    pts = V.normalize(e, "embedding", "unit").select("id", F.lit(1).alias("w"), "unit")
    rows = []
    write = type(pts.write).parquet

    def counted(self, path, *a, **k):
        write(self, path, *a, **k)
        rows.append(spark.read.parquet(path).count())

    monkeypatch.setattr(type(pts.write), "parquet", counted)
    assert WD.ward_merges(pts, tail_clusters=1).count() == 89
    assert max(rows) == 90


def test_no_state_is_copied_into_a_shuffle(spark):
    """All pairs of blocks are a cross join; grouping by pairs of blocks wrote each state once for every block."""
    rng = np.random.default_rng(0)
    rows = [(i, 1.0, 0.0, 1, v.tolist(), [1.0], None, None, i % 2 == 0) for i, v in enumerate(rng.normal(size=(90, 4)))]
    states = spark.createDataFrame(rows, WD.STATE_SCHEMA + ", asked boolean")
    blocks, _ = WD._kept(WD.state_blocks(states, 45, (90, 90 * 4)), "blocks")
    found = WD.nearest_clusters(blocks)
    assert sorted(r.c for r in found.collect()) == [i for i in range(90) if i % 2 == 0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    assert "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan


@pytest.mark.parametrize(("numbers", "products"), [(64, 100), (1 << 22, 1 << 22)])
def test_wide_states_are_dealt_to_small_blocks(spark, monkeypatch, numbers, products):
    """Blocks and the last task are bounded by what the states hold, not by clusters alone."""
    n = 60
    e, d = _load(spark, n)
    monkeypatch.setattr(WD, "BLOCK_NUMBERS", 1 << 12 if numbers == 64 else numbers)
    monkeypatch.setattr(WD, "TAIL_NUMBERS", numbers)
    monkeypatch.setattr(WD, "PRODUCTS", products)
    pts = V.normalize(e, "embedding", "unit").select("id", F.lit(1).alias("w"), "unit")
    merges = WD.ward_merges(pts, tail_clusters=1000).collect()
    assert np.allclose(sorted(r.height for r in merges), sorted(h for _, _, h in greedy_ward(d)), rtol=1e-9, atol=1e-12)


def test_cuts_by_intervals_equal_paths(spark, monkeypatch):
    """Blocks of a few leaves, weights, and roots of several trees."""
    monkeypatch.setattr(WD, "CUT_BLOCK", 7)
    n = 90
    e, _ = _load(spark, n)
    pts = V.normalize(e, "embedding", "unit").select("id", (1 + F.col("id") % 3).alias("w"), "unit").cache()
    merges = WD.ward_merges(pts, tail_clusters=30)
    rows = merges.collect()
    heights = sorted(r.height for r in rows)
    top = max(r.round for r in rows)
    for some in (rows, [r for r in rows if r.round < top - 1], []):
        table = spark.createDataFrame([tuple(r) for r in some], WD.MERGE_SCHEMA)
        leaves = WD.leaf_order(pts, table).collect()
        assert sorted(r.leaf for r in leaves) == list(range(1, n + 1))
        ts = [-1.0, heights[20], heights[60], heights[-1]]
        cuts = spark.createDataFrame([(float(i), float(t)) for i, t in enumerate(ts)], "th double, t double")
        got = WD.flat_clusters(pts, table, cuts).collect()
        assert len(got) == n * len(ts)
        for i, t in enumerate(ts):
            groups = {}
            for r in got:
                if r.th == i:
                    groups.setdefault(r.rep, set()).add(r.id)
            assert sorted(sorted(g) for g in groups.values()) == _spark_cut(some, n, t)
            assert all(rep == min(g) for rep, g in groups.items())


def _random_points(spark, n, d=8):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, d)) + 1.5 * rng.normal(size=(6, d))[rng.integers(0, 6, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, n)
    pts = spark.createDataFrame([(i, int(w[i]), x[i].tolist()) for i in range(n)], "id long, w int, unit array<double>")
    dist = np.maximum(1 - x @ x.T, 0)
    np.fill_diagonal(dist, 0)
    return pts, dist * np.sqrt(2.0 * np.outer(w, w) / (w[:, None] + w[None, :])), w  # Ward's distance of groups of copies


@pytest.mark.parametrize(("n", "matrix"), [(1100, 1024), (150, 8)])
def test_last_clusters_need_no_rounds_of_jobs(spark, monkeypatch, n, matrix):
    """Far more clusters than a matrix of sums holds are searched in one task; 1,100 took rounds of jobs before."""
    monkeypatch.setattr(WD, "MATRIX", matrix)
    monkeypatch.setattr(WD, "state_blocks", None)
    pts, dist, w = _random_points(spark, n)
    merges = WD.ward_merges(pts).collect()
    ref = greedy_ward(dist, w)
    assert np.allclose(sorted(r.height for r in merges), sorted(h for _, _, h in ref), rtol=1e-9, atol=1e-12)
    for t in np.quantile([h for _, _, h in ref], [0.2, 0.5, 0.8, 0.95]) + 1e-9:  # beside a height
        assert _spark_cut(merges, n, t) == cut(n, ref, t)


def test_tail_goes_on_from_the_rounds(spark, monkeypatch):
    """Neighbours known from the rounds are not searched again; rounds and merges are those of one task."""
    monkeypatch.setattr(WD, "MATRIX", 8)
    pts, _, _ = _random_points(spark, 150)
    plain = lambda m: sorted((r.child, r.parent, round(r.height, 9), r.size, r.round) for r in m.collect())
    whole = plain(WD.ward_merges(pts))
    assert plain(WD.ward_merges(pts, tail_clusters=70)) == whole


@pytest.mark.parametrize("small", [lambda i: True, lambda i: False, lambda i: i % 3 > 0])
def test_nearest_by_bounds_takes_few_sums(small, monkeypatch):
    """The nearest of all sums, of which only those within reach of the bounds are taken."""
    rng = np.random.default_rng(6)
    x, _ = _states(rng, [1 + i % 7 for i in range(200)], 24, small)
    s = WD.cross_sums(x, x)
    d = WD.ward_distances(s, x, x)
    taken, sums = [], WD.pair_sums
    monkeypatch.setattr(WD, "pair_sums", lambda x, p, y, q: taken.append(len(p)) or sums(x, p, y, q))
    near = WD.Nearest(x)
    near.search(x)
    assert np.array_equal(near.o, x.cid[d.argmin(1)])
    assert np.allclose(near.d, d.min(1), rtol=1e-9) and np.allclose(near.s, s[np.arange(200), d.argmin(1)], rtol=1e-9)
    assert sum(taken) < 0.25 * 200 * 200
