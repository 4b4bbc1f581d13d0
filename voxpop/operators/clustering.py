"""Threshold-swept Ward clustering.

``cluster_texts`` is the whole sweep as one call: distinct texts (weighted) ->
exact Ward merges (computed once, no pair table) -> all cuts of the threshold
grid at once -> valid clusters (size > 1), valid thresholds (>= 2 valid
clusters) -> silhouette per valid threshold -> best threshold (first best wins)
-> assignment table for every input row. Cluster ids are the smallest member
key (the reference's numbering is arbitrary).
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.operators import vectors as V
from voxpop.operators import ward as WD
from voxpop.session import materialize


log = logging.getLogger(__name__)


def threshold_grid(init: float = S.SWEEP_INIT_THRESHOLD, points: int = S.SWEEP_POINTS) -> list[float]:
    """V6: ``points`` even steps from max(.6, init-.1) to min(.9, init+.1)."""
    return [float(x) for x in np.linspace(max(0.6, init - 0.1), min(0.9, init + 0.1), points)]


@dataclass
class ClusterResult:
    assignments: DataFrame  # (key, text?, cluster_id, cluster_size) at the best threshold
    merges: DataFrame  # (child, parent, height, size, round)
    sweep: DataFrame  # (th, t, n_clusters, n_valid, silhouette)
    best_threshold: float | None
    best_score: float | None
    cuts: DataFrame  # (th, id, rep) for every distinct point and threshold


def _distinct_points(df: DataFrame, key: str, vec_col: str, dedupe_col: str | None, vectors: DataFrame | None = None) -> DataFrame:
    """Collapse duplicates: one point per distinct ``dedupe_col`` with weight = copies."""
    if vectors is not None:
        g = df.groupBy(dedupe_col).agg(F.min(F.col(key).cast("long")).alias("id"), F.count(F.lit(1)).alias("w"))
        return g.join(vectors, dedupe_col).select("id", F.col(vec_col).alias("vec"), "w", F.col(dedupe_col).alias("_dk"))
    if dedupe_col is None:
        return df.select(F.col(key).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.lit(1).alias("w"))
    g = df.groupBy(dedupe_col).agg(F.min(F.struct(F.col(key).cast("long").alias("id"), F.col(vec_col).alias("vec"))).alias("m"),
                                   F.count(F.lit(1)).alias("w"))
    return g.select(F.col("m.id").alias("id"), F.col("m.vec").alias("vec"), "w", F.col(dedupe_col).alias("_dk"))


def _seen_columns(points: DataFrame) -> DataFrame:
    """The unit vectors without the columns that are zero in all of them, which no product sees."""
    held = materialize(points, "unit-vectors")
    if held.isEmpty():
        return held
    found = held.select(Summarizer.metrics("numNonZeros").summary(V.array_to_vector("unit")).alias("s")).select(
        V.vector_to_array("s.numNonZeros").alias("n")).first()
    seen = [i for i, n in enumerate(found.n) if n > 0]
    if 2 * len(seen) > len(found.n):
        return held
    return held.withColumn("unit", F.transform(F.lit(seen), lambda i: F.get("unit", i)))


def rows_to_cluster(df: DataFrame, vec_col: str = "embedding", dedupe_col: str | None = "text") -> DataFrame:
    """P10: the rows that have a vector and, where equal texts count once, a text."""
    rows = df.where(F.col(vec_col).isNotNull())
    return rows if dedupe_col is None else rows.where(F.col(dedupe_col).isNotNull())


def cluster_texts(df: DataFrame, key: str = "row_id", vec_col: str = "embedding", dedupe_col: str | None = "text",
                  thresholds: list[float] | None = None, block_rows: int = 1024, vectors: DataFrame | None = None) -> ClusterResult:
    """V12. ``df(key, vec_col[, dedupe_col])``; rows with a null vector are dropped (P10).

    ``vectors``: ``(dedupe_col, vec_col)``, one row for each distinct value, where the rows of ``df`` do not
    carry theirs; so no wide row is sorted or shuffled for every copy of a text.
    """
    spark = df.sparkSession
    rows = df.where(F.col(dedupe_col).isNotNull()) if vectors is not None else rows_to_cluster(df, vec_col, dedupe_col)
    pts = materialize(_seen_columns(V.normalize(_distinct_points(rows, key, vec_col, dedupe_col, vectors), "vec", "unit")).drop("vec"), "sweep-points")
    n = pts.count()
    ths = thresholds if thresholds is not None else threshold_grid()
    if n < 2:
        empty = spark.createDataFrame([], "th double, t double, n_clusters long, n_valid long, silhouette double")
        return ClusterResult(rows.drop(vec_col).limit(0), spark.createDataFrame([], "child long, parent long, height double, size double, round int"),
                             empty, None, None, spark.createDataFrame([], "th double, id long, rep long"))
    t0 = time.time()
    merges = materialize(WD.ward_merges(pts.select("id", "w", "unit")), "sweep-merges")
    zmax = merges.agg(F.max("height")).first()[0] or 0.0
    log.info("sweep: merges of %d points %.1fs", n, time.time() - t0)
    cuts = spark.createDataFrame([(float(th), float((1 - th) * zmax * 0.7)) for th in ths], "th double, t double")
    reps = materialize(WD.flat_clusters(pts.select("id", "w"), merges, cuts), "sweep-cuts")
    sized = reps.join(pts.select("id", "w"), "id")
    csize = sized.groupBy("th", "rep").agg(F.sum("w").alias("size"))
    per_th = csize.groupBy("th").agg(F.count(F.lit(1)).alias("n_clusters"),
                                     F.count(F.when(F.col("size") > 1, 1)).alias("n_valid"))
    stats = {r.th: (r.n_clusters, r.n_valid) for r in per_th.collect()}  # one row per threshold
    log.info("sweep: cuts %.1fs", time.time() - t0)
    valid_rows = (sized.join(csize.where("size > 1"), ["th", "rep"], "left_semi")
                  .join(pts.select("id", "unit"), "id"))
    valid_rows = materialize(valid_rows, "sweep-valid")
    valid_ths = [float(th) for th in ths if stats.get(float(th), (0, 0))[1] >= 2]
    scores = {}
    if valid_ths:  # all valid thresholds in one distributed job
        sil = V.silhouettes(valid_rows.where(F.col("th").isin(*valid_ths)), "unit", "rep", "w", by="th",
                            block_rows=block_rows)
        scores = {float(r.g): float(r.silhouette) for r in sil.collect()}  # one row per threshold
    sweep_rows, best_th, best = [], None, -1.0
    for th in ths:  # T10: strict '>' from -1 in grid order, the first best wins
        th = float(th)
        nc, nv = stats.get(th, (0, 0))
        score = scores.get(th)
        if score is not None and score > best:
            best, best_th = score, th
        sweep_rows.append((th, float((1 - th) * zmax * 0.7), int(nc), int(nv), score))
    log.info("sweep: silhouettes %.1fs", time.time() - t0)
    sweep = spark.createDataFrame(sweep_rows, "th double, t double, n_clusters long, n_valid long, silhouette double")
    if best_th is None:
        assign = (rows.drop(vec_col).limit(0).withColumn("cluster_id", F.lit(None).cast("long"))
                  .withColumn("cluster_size", F.lit(None).cast("long")))
        return ClusterResult(assign, merges, sweep, None, None, reps)
    at_best = reps.where(F.col("th") == best_th).select("id", F.col("rep").alias("cluster_id"))
    if dedupe_col is not None:
        link = pts.select("id", "_dk").join(at_best, "id").select(F.col("_dk").alias(dedupe_col), "cluster_id")
        # rows without a direction (zero vector) stay, without a cluster; the vector may be the dedupe key itself
        assign = rows.join(link, dedupe_col, "left").drop(vec_col)
    else:
        assign = rows.drop(vec_col).join(at_best.withColumnRenamed("id", key), key, "left")
    assign = with_cluster_size(assign)
    return ClusterResult(assign, merges, sweep, best_th, best, reps)


def cluster_sizes(assign: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Size per cluster id, ascending id."""
    return assign.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("cluster_size")).orderBy(cluster_col)


def with_cluster_size(assign: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """J4 as a join with the A12 aggregate (partial aggregation, no per-cluster window)."""
    return assign.join(cluster_sizes(assign.where(F.col(cluster_col).isNotNull()), cluster_col), cluster_col, "left")


def valid_rows(assign: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """J5 + A13: rows of clusters with more than one member (left-semi join)."""
    sizes = cluster_sizes(assign, cluster_col).where("cluster_size > 1")
    return assign.join(sizes, cluster_col, "left_semi")


def cluster_bisecting(df: DataFrame, key: str = "row_id", vec_col: str = "embedding", ks: list[int] | None = None,
                      seed: int = 7) -> ClusterResult:
    """The scale-out alternative to exact Ward: ``BisectingKMeans``
    with cosine distance for each k of a grid, scored by the same silhouette over
    clusters with more than one row; the first best k wins. It answers the same
    question (variance-based hierarchy, silhouette-chosen cut) with another
    partition, at O(n k) per level instead of O(n^2) pairs."""
    from pyspark.ml.clustering import BisectingKMeans

    spark = df.sparkSession
    pts = materialize(V.normalize(df.select(F.col(key).cast("long").alias("id"), F.col(vec_col).alias("vec")), "vec", "unit")
                      .select("id", F.col("unit").alias("vec"), V.array_to_vector("unit").alias("features")), "bisect-points")
    if ks is None:  # powers of two up to the square root of the rows
        ks = [2**i for i in range(1, max(1, int(np.log2(max(4, pts.count())) / 2)) + 1)]
    labelled = None
    for k in ks:
        model = BisectingKMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features",
                                predictionCol="c").fit(pts)
        part = model.transform(pts).select(F.lit(float(k)).alias("th"), "id", F.col("c").cast("long").alias("rep"), "vec")
        labelled = part if labelled is None else labelled.unionByName(part)
    labelled = materialize(labelled, "bisect-labels")
    csize = labelled.groupBy("th", "rep").agg(F.count(F.lit(1)).alias("size"))
    per_th = {r.th: (r.n_clusters, r.n_valid) for r in csize.groupBy("th").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.count(F.when(F.col("size") > 1, 1)).alias("n_valid")).collect()}
    valid = labelled.join(csize.where("size > 1"), ["th", "rep"], "left_semi")
    scores = {float(r.g): float(r.silhouette) for r in V.silhouettes(valid, "vec", "rep", by="th").collect()}
    rows_, best_k, best = [], None, -1.0
    for k in ks:
        nc, nv = per_th.get(float(k), (0, 0))
        score = scores.get(float(k)) if nv >= 2 else None
        if score is not None and score > best:
            best, best_k = score, float(k)
        rows_.append((float(k), None, int(nc), int(nv), score))
    sweep = spark.createDataFrame(rows_, "th double, t double, n_clusters long, n_valid long, silhouette double")
    empty = spark.createDataFrame([], "child long, parent long, height double, size double, round int")
    if best_k is None:
        return ClusterResult(df.limit(0), empty, sweep, None, None, labelled.select("th", "id", "rep"))
    assign = labelled.where(F.col("th") == best_k).select(F.col("id").alias(key), F.col("rep").alias("cluster_id"))
    return ClusterResult(with_cluster_size(assign), empty, sweep, best_k, best, labelled.select("th", "id", "rep"))
