import numpy as np
import pytest

from voxpop.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, n string, cell int"


def brute(rows, cosine):
    good = [(i, np.asarray(v, np.float64)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, *_ in rows}
    root = {i: i for i, *_ in rows}
    for n, (a, x) in enumerate(good):
        for b, y in good[n + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                ra, rb = root[a], root[b]
                if ra != rb:
                    root = {k: min(ra, rb) if r in (ra, rb) else r for k, r in root.items()}
    return {i: (links[i], root[i], i == root[i]) for i in links}


def planted(rng, dim):
    out = [rng.normal(size=dim) for _ in range(150)]
    for spread in (0.02, 0.25, 0.42, 0.5):
        base = rng.normal(size=dim)
        out += [base + spread * rng.normal(size=dim) * (np.linalg.norm(base) / np.sqrt(dim)) for _ in range(60)]
    return out + [out[0]] * 40 + [out[1] * 3]


@pytest.mark.parametrize(("dim", "cosine", "chunk"), [(64, 0.9, 4096), (64, 0.9, 50), (10, 0.95, 40), (3, 0.999, 64)])
def test_links_against_brute_force(spark, monkeypatch, dim, cosine, chunk):
    monkeypatch.setattr(V, "CHUNK", chunk)
    monkeypatch.setattr(V, "_TILE", 32)
    rng = np.random.default_rng(dim)
    vecs = [v.astype(np.float32).tolist() for v in planted(rng, dim)]
    vecs += [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [None] + [1.0] * (dim - 1), [1.0], [2.0]]
    rows = [((i * 13) % 1009, v, 1, "x", 0) for i, v in enumerate(vecs)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_vectors(spark.createDataFrame(rows, SCHEMA), cosine=cosine).collect()}
    assert got == brute(rows, cosine)


def test_edge_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert V.near_vectors(df([])).count() == 0
    rows = [(None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1e300, -0.0])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in V.near_vectors(df(rows)).collect())
    assert got == [("2", 2, "2"), ("3", 2, "2"), ("3", 2, "2"), ("None", 0, "None"), ("None", 0, "None")]


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    for _ in range(50):
        link = rng.random((9, 11)) < 0.12
        rows, cols = V.forest(link)
        for i, j in zip(*link.nonzero(), strict=True):
            assert rows[i] == cols[j]
        assert all(c == -1 or link[:, j].any() for j, c in enumerate(cols)) and (cols[~link.any(axis=0)] == -1).all()
