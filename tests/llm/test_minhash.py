import random

import numpy as np
import pytest

from voxpop.llm import minhash as M
from voxpop.llm.common import connected_components

SCHEMA = "doc_id long, text string, component_id string, bands int"


def brute(rows, size, percent):
    """Component (smallest id) of each id, comparing all pairs of sets."""
    sets = {i: M.shingle_set(t, size) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n, words, edits):
    """Near copies of one text, some of which resemble each other without linking."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("size", "percent"), [(2, 80), (5, 80)])
def test_components_against_brute_force(spark, size, percent):
    rng = random.Random(size)
    texts = family(rng, 120, 100, 14) + family(rng, 40, 60, 3) + family(rng, 60, 200, 40)
    texts += [None, "", " \t\n\x0b", "one", "ONE", "one two", "one\x0btwo", "É é", "é É", "a b c d", "A B C D", "x " * 30_000]
    texts += texts[:40] + ["copy of one text"] * 90
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t, "c", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=size, percent=percent).collect()}
    want = brute(rows, size, percent)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_edge_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert M.near_duplicates(df([])).count() == 0
    rows = [(None, "a b c d e f", "", 0), (None, "a b c d e f", "", 0), (4, "a b c d e f", "", 0), (4, "a b c d e f", "", 0), (5, "a b c d e f", "", 0)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in M.near_duplicates(df(rows)).collect())
    assert got == [("4", "4", True), ("4", "4", True), ("5", "4", False), ("None", "None", True), ("None", "None", True)]
    kept = M.keep_one(df(rows))
    assert kept.columns == ["doc_id", "text", "component_id", "bands"] and kept.count() == 4


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(0)
    a, b = M._params(M.FINE_SAMPLES)
    common = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    limit = M.most_flips(80, M.FINE_SAMPLES, M.FINE_BITS, 5.5)
    flips = {}
    for share in (0.6, 0.7, 0.8, 0.9):
        own = int(len(common) * (1 - share) / (2 * share))
        x = np.concatenate([common, rng.integers(0, 2**63, own, dtype=np.uint64)])
        y = np.concatenate([common, rng.integers(0, 2**63, own, dtype=np.uint64)])
        sx, sy = (M.odd_sketch(M.minhash(v, a, b), M.FINE_BITS).view(np.uint64) for v in (x, y))
        flips[share] = int(np.bitwise_count(sx ^ sy).sum())
        differ = np.log(1 - 2 * flips[share] / M.FINE_BITS) / np.log(1 - 2 / M.FINE_BITS) / 2
        assert abs(1 - differ / M.FINE_SAMPLES - share) < 0.04
    assert flips[0.9] < flips[0.8] <= limit < flips[0.7] < flips[0.6]


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200) * 11, rng.randrange(200) * 11) for _ in range(150)] + [(i, i + 1) for i in range(5000, 5060)] + [(9, 9)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        changed = False
        for a, b in edges:
            lo = min(root[a], root[b])
            changed |= root[a] != lo or root[b] != lo
            root[a] = root[b] = lo
        if not changed:
            break
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


@pytest.mark.parametrize("turned", [False, True])
def test_repeated_id_with_two_texts_keeps_both_links(spark, turned):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, "nothing of it")]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(docs, size=2).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert sorted(r.doc_id for r in M.keep_one(docs, size=2).collect()) == [1, 1, 4]


def test_component_is_called_by_its_smallest_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(90 - 7 * i, text + f" end{i}") for i in range(8)] + [(5, "alone here"), (2, "alone there")]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == {**{90 - 7 * i: 41 for i in range(8)}, 5: 5, 2: 2}
