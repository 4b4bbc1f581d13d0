"""Embedding near-duplicates by a subspace pigeonhole join (operator 8).

Unit vectors of cosine t or more are at most 2 - 2t apart in squared distance.
A fixed random rotation spreads that distance over all coordinates; the
rotated vector is split into ``SUBSPACES`` blocks, and two such vectors must be
within the block's proportional share of the budget in at least one of them
(else the shares would add up to more). So the union of the block-wise range
joins holds every link, and candidates are verified on the whole vectors in
double precision.

The range joins run blocked. Vectors go to the cell of their nearest pivot
(a bounded sample), large cells are split into chunks, and two cells meet only
if in some subspace the balls around their pivots come within that subspace's
radius. One task joins two chunks of at most about ``CHUNK`` rows: it holds no
more than that, whatever the size of a group. A task sends back counts and a
spanning forest of the links it finds, never the pairs, so groups of
thousands of copies cost rows in proportion to their size. Equal vectors are
collapsed before and counted by weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxpop.llm.common import connected_components, written
from voxpop.session import ship_package

SUBSPACES = 4
CHUNK = 16384
#: Most pivots; cells that are too large for them are split into chunks.
PIVOTS = 256
_TILE = 1024


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(20240502).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def budgets(dim: int, cosine: float) -> list[float]:
    """Squared distance allowed in each block: its share of 2 - 2 * cosine, and some room for rounding."""
    total = max(0.0, 2 - 2 * cosine)
    return [total * (b.stop - b.start) / dim * (1 + 1e-4) + 1e-5 for b in blocks(dim)]


def units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def candidates(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rotated rows are within the budget of some block."""
    out = np.zeros((len(a), len(b)), bool)
    for cut, budget in zip(blocks(a.shape[1]), budgets(a.shape[1], cosine), strict=True):
        x, y = np.ascontiguousarray(a[:, cut]), np.ascontiguousarray(b[:, cut])
        # |x|^2 + |y|^2 - 2xy <= budget
        dots = x @ y.T
        dots -= 0.5 * (x * x).sum(axis=1, keepdims=True)
        out |= dots >= 0.5 * ((y * y).sum(axis=1) - budget)
    return out


def linked(ua: np.ndarray, ub: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles (rows of a, rows of b, which of them link), verified in double precision; a row never links with itself."""
    q = rotation(ua.shape[1])
    ra, rb = (ua @ q).astype(np.float32), (ub @ q).astype(np.float32)
    for at in range(0, len(ua), _TILE):
        near = candidates(ra[at : at + _TILE], rb, cosine)
        if same:
            i = np.arange(len(near))
            near[i, at + i] = False
        rows, cols = near.any(axis=1).nonzero()[0], near.any(axis=0).nonzero()[0]
        if len(rows):
            link = near[np.ix_(rows, cols)]
            link &= ua[at + rows] @ ub[cols].T >= cosine
            yield at + rows, cols, link


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component label (smallest row index) of the rows and columns of a bipartite graph; rows without links keep their index, columns get -1."""
    n = len(link)
    rows, some = np.arange(n), link.any(axis=0)
    while True:
        cols = np.where(link, rows[:, None], n).min(axis=0, initial=n)
        new = np.minimum(rows, np.where(link, cols[None, :], n).min(axis=1, initial=n))
        if (new == rows).all():
            return rows, np.where(some, cols, -1)
        rows = new


def _joined(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One pair of chunks: (id, n_links, to) rows of counts (to null) and of forest edges (n_links 0)."""
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    same = not len(right)
    if not len(left):
        return pd.DataFrame({"id": [], "n_links": [], "to": []})
    right = left if same else right
    ia, ib = left["id"].to_numpy(), right["id"].to_numpy()
    na, nb = left["n"].to_numpy(), right["n"].to_numpy()
    ua = units(left["vec"])
    ub = ua if same else units(right["vec"])
    ca, cb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    edges = []
    for rows, cols, link in linked(ua, ub, cosine, same):
        ca[rows] += link @ nb[cols]
        if not same:
            cb[cols] += na[rows] @ link
        r, c = forest(link)
        edges.append(np.column_stack([ia[rows], ia[rows][r]]))
        edges.append(np.column_stack([ib[cols], ia[rows][c]])[c >= 0])
    edges = np.unique(np.concatenate(edges), axis=0) if edges else np.empty((0, 2), np.int64)
    edges = edges[edges[:, 0] != edges[:, 1]]
    ids, counts = (ia, ca) if same else (np.r_[ia, ib], np.r_[ca, cb])
    some = counts > 0
    return pd.DataFrame({
        "id": np.r_[ids[some], edges[:, 0]],
        "n_links": np.r_[counts[some], np.zeros(len(edges), np.int64)],
        "to": pd.array([*[None] * int(some.sum()), *edges[:, 1].tolist()], dtype="Int64"),
    })


def _links(spark: SparkSession, vecs: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(id, n_links, to) over distinct vectors (id, n, vec) of one length."""
    n = vecs.count()
    wanted = min(PIVOTS, max(1, n // (CHUNK // 2)))
    pivots = units(vecs.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()["vec"])
    q, cuts = rotation(dim), blocks(dim)
    shared = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for f in frames:
            if len(f):
                u = units(f["vec"])
                cell = (u @ p.T).argmax(axis=1)
                gap = (u - p[cell]) @ q
                far = np.stack([(gap[:, c] ** 2).sum(axis=1) for c in cuts], axis=1)
                yield f.assign(cell=cell.astype(np.int32), far=list(np.sqrt(far)))

    kind = vecs.schema["vec"].dataType.simpleString()
    placed, _ = written(vecs.mapInPandas(cells, f"id long, n long, vec {kind}, cell int, far array<double>"), "cells")
    # one row a cell, at most PIVOTS
    seen = placed.groupBy("cell").agg(F.count("*").alias("n"), *[F.max(F.col("far")[j]).alias(f"r{j}") for j in range(len(cuts))]).toPandas()
    cell, size = seen["cell"].to_numpy(), np.ceil(seen["n"].to_numpy() / CHUNK).astype(int)
    radius, centre = seen[[f"r{j}" for j in range(len(cuts))]].to_numpy(), pivots[cell] @ q
    meet = np.zeros((len(cell), len(cell)), bool)
    for j, (c, budget) in enumerate(zip(cuts, budgets(dim, cosine), strict=True)):
        apart = np.sqrt(((centre[:, None, c] - centre[None, :, c]) ** 2).sum(axis=2))
        meet |= apart <= radius[:, j, None] + radius[None, :, j] + budget**0.5 + 1e-6
    chunks = spark.createDataFrame([(int(c), int(s)) for c, s in zip(cell, size, strict=True)], "cell int, chunks int")
    pairs = spark.createDataFrame(
        [(int(cell[i]), int(cell[j]), int(size[i]), int(size[j])) for i, j in zip(*np.triu(meet).nonzero(), strict=True)],
        "p int, q int, np int, nq int",
    )
    tasks = (
        pairs.select("p", "q", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("i"), "nq")
        .select("p", "q", "i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"))
        .where("p <> q or i <= j")
    )
    key = ["p", "i", "q", "j"]
    sides = tasks.select(*key, F.col("p").alias("cell"), F.col("i").alias("chunk"), F.lit(0).alias("side")).unionByName(
        tasks.where("p <> q or i <> j").select(*key, F.col("q").alias("cell"), F.col("j").alias("chunk"), F.lit(1).alias("side"))
    )
    rows = placed.select("id", "n", "vec", "cell").join(F.broadcast(chunks), "cell")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")).drop("chunks")
    return (
        rows.join(sides, ["cell", "chunk"])
        .select(*key, "side", "id", "n", "vec")
        .groupBy(*key)
        .applyInPandas(lambda f: _joined(f, cosine), "id long, n_links long, to long")
    )


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, cosine: float = 0.9) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link when their cosine in double precision reaches ``cosine``;
    ``n_links`` counts the other rows linked directly, equal vectors included,
    ``component_id`` is the smallest id reachable, ``kept`` whether it is the
    own id. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, nor do rows with a null id (kept, component
    null) or vectors of different lengths with each other. Rows that repeat an
    id and a vector count as copies. Other columns are not read. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    good = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # 128 bits name a vector; -0 and 0 are one number
    same = F.transform("vec", lambda x: x + F.lit(0.0).cast("float"))
    rows = rows.withColumn("k1", F.when(F.col("good"), F.xxhash64(same))).withColumn("k2", F.when(F.col("good"), F.xxhash64(F.lit(1), same)))
    valid = rows.where("good")
    copies = valid.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    distinct, _ = written(
        valid.join(copies, ["k1", "k2"]).where("id = rep").select("k1", "k2", "id", "n", "vec").dropDuplicates(["k1", "k2"]),
        "vectors",
    )
    found = None
    for (dim,) in distinct.select(F.size("vec")).distinct().collect():  # the lengths that occur: as a rule one
        part = _links(spark, distinct.where(F.size("vec") == dim).select("id", "n", "vec"), dim, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "id long, n_links long, to long")
    found, _ = written(found, "links")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("links"))
    comps = connected_components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    classes = (
        distinct.select("k1", "k2", "id", "n").join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = rows.where("good").join(classes, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
