"""Communities are connected, and splitting unconnected ones never lowers Q."""

import random

from voxpop.operators import network as NW


def _parts(edges, comm):
    """Connected parts inside each community, by plain union-find."""
    up = {n: n for n in comm}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b, _ in edges:
        if comm[a] == comm[b]:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {n: find(n) for n in comm}


def _graph(seed, n, m):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)}
    return [(f"n{a:02d}", f"n{b:02d}", rnd.randrange(1, 5)) for a, b in sorted(pairs)]


def test_connected_parts_equal_union_find(spark):
    edges = _graph(1, 40, 45) + [(f"p{i:02d}", f"p{i + 1:02d}", 1) for i in range(20)]  # and a long path
    nodes = sorted({n for a, b, _ in edges for n in (a, b)} | {"alone"})
    comm = {n: f"c{sum(map(ord, n)) % 3 if n[0] == 'n' else 9}" for n in nodes}
    table = spark.createDataFrame(sorted(comm.items()), "node string, community string")
    e = spark.createDataFrame(edges, "a string, b string, weight long")
    got = {r.node: r.community for r in NW.connected_parts(e, table).collect()}
    assert got == _parts(edges, comm)
    split = spark.createDataFrame(sorted((n, c) for n, c in got.items() if n != "alone"), "node string, community string")
    assert NW.modularity(e, split) >= NW.modularity(e, table) - 1e-12


def test_communities_are_connected(spark):
    edges = _graph(4, 24, 40)
    e = spark.createDataFrame(edges, "a string, b string, weight long")
    comm, levels = NW.community_levels(e)
    got = {r.node: r.community for r in comm.collect()}
    parts = _parts(edges, got)
    assert len(set(parts.values())) == len(set(got.values()))
    assert levels == sorted(levels) and levels[-1] > 0
