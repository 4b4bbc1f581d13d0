"""Plain greedy Ward with the Lance-Williams update, as a brute-force check (n small)."""

import numpy as np


def greedy_ward(d: np.ndarray, w: np.ndarray | None = None):
    """Merge the globally closest pair each step. Returns [(set_a, set_b, height)]."""
    n = d.shape[0]
    w = np.ones(n) if w is None else w.astype(float)
    D = d.astype(float).copy()
    np.fill_diagonal(D, np.inf)
    size = w.copy()
    members = {i: {i} for i in range(n)}
    alive = list(range(n))
    out = []
    while len(alive) > 1:
        sub = D[np.ix_(alive, alive)]
        k = np.argmin(sub)
        ia, ib = divmod(k, len(alive))
        a, b = alive[ia], alive[ib]
        h = D[a, b]
        out.append((frozenset(members[a]), frozenset(members[b]), h))
        for c in alive:
            if c in (a, b):
                continue
            t = size[a] + size[b] + size[c]
            v = ((size[a] + size[c]) * D[a, c] ** 2 + (size[b] + size[c]) * D[b, c] ** 2 - size[c] * D[a, b] ** 2) / t
            D[a, c] = D[c, a] = np.sqrt(max(v, 0.0))
        size[a] += size[b]
        members[a] |= members[b]
        alive.remove(b)
        D[b, :] = np.inf
        D[:, b] = np.inf
    return out


def cut(n: int, merges, t: float):
    """Flat clusters: union of merges with height <= t (as frozensets)."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, h in merges:
        if h <= t:
            ra, rb = find(min(a)), find(min(b))
            parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), set()).add(i)
    return sorted(sorted(g) for g in groups.values())
