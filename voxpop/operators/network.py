"""Theme network (G1-G4): co-occurrence edges, communities, ranking and priority.

The reference describes these without code, so the definitions are ours:

* G1 edge weight = number of rows in which both themes occur (themes distinct
  per row, rows whose first factor is a sentinel skipped). Pairs are generated
  inside each row's (short, capped) factor list with array functions, then
  aggregated with map-side combine.
* G2 communities = synchronous local moving by modularity gain on the edge
  DataFrame; to avoid two nodes swapping forever, even rounds only accept moves
  to a smaller community id and odd rounds to a larger one. Modularity Q is
  reported; node order differs from sequential Louvain, so compare Q.
* G3 rank = themes by frequency desc, theme asc; sentiment = majority label of
  the theme's rows, ties to the larger code.
* G4 priority = negative share x frequency, desc.
Ranked reports are top-k (``orderBy().limit(k)`` = distributed partial top-k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop.functions import reply as R
from voxpop.operators.factors import counted_factors
from voxpop.operators.ordering import numbered
from voxpop.session import materialize


def theme_rows(df: DataFrame, key: str = "row_id") -> DataFrame:
    """``(row_id, sentiment, theme)``: distinct themes per row, sentinel rows skipped."""
    return df.select(key, "sentiment", F.explode(F.array_distinct(counted_factors())).alias("theme"))


def cooccurrence(df: DataFrame, key: str = "row_id") -> DataFrame:
    """G1: ``(a, b, weight)`` with a < b."""
    staged = df.select(F.array_sort(F.array_distinct(counted_factors())).alias("arr"))
    arr = F.col("arr")
    pairs = F.flatten(F.transform(arr, lambda x, i: F.transform(F.slice(arr, i + 2, F.greatest(F.size(arr) - i - 1, F.lit(0))),
                                                              lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return (staged.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")))


def modularity(edges: DataFrame, comm: DataFrame) -> float:
    """Q = Σ_c [ L_c / m − (D_c / 2m)² ] for an undirected weighted graph."""
    m = edges.agg(F.sum("weight")).first()[0] or 0
    if m == 0:
        return 0.0
    c = comm.select("node", "community")
    ea = (edges.join(c.withColumnRenamed("node", "a").withColumnRenamed("community", "ca"), "a")
          .join(c.withColumnRenamed("node", "b").withColumnRenamed("community", "cb"), "b"))
    internal = ea.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("L"))
    deg = _degrees(edges).join(c, "node").groupBy("community").agg(F.sum("k").alias("D"))
    q = (deg.join(internal, "community", "left").select(
        F.sum(F.coalesce("L", F.lit(0)) / F.lit(float(m)) - F.pow(F.col("D") / F.lit(2.0 * m), 2)).alias("q")).first()[0])
    return float(q or 0.0)


def _degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    return both.groupBy("node").agg(F.sum("weight").alias("k"))


def communities(edges: DataFrame) -> DataFrame:
    """``(node, community)``; community id = a member node's name (string).

    Levels of local moving by modularity gain: after each, a community that fell
    apart (its nodes move at the same time) is split into its connected parts,
    which never lowers Q, and the parts become the nodes of a smaller graph
    (inner weight as loops), until no level moves anything. So every community is
    connected; its id is its smallest part's.
    """
    return community_levels(edges)[0]


def community_levels(edges: DataFrame) -> tuple[DataFrame, list[float]]:
    """The communities and the modularity Q after each level."""
    edges = materialize(edges.select("a", "b", "weight"), "net-level")
    m = float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    comm = _degrees(edges).select("node", F.col("node").alias("community"))
    if m == 0:
        return comm, []
    graph, loops = edges, edges.select(F.col("a").alias("node"), "weight").limit(0)
    levels: list[float] = []
    while True:
        moved = materialize(connected_parts(graph, _moved(graph, loops, m)), "net-moved")
        if moved.where("node <> community").isEmpty():
            return comm, levels
        up = moved.select(F.col("node").alias("community"), F.col("community").alias("_up"))
        comm = materialize(comm.join(up, "community", "left").select("node", F.coalesce("_up", "community").alias("community")), "net-comm")
        levels.append(modularity(edges, comm))
        to = lambda c: moved.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
        merged = graph.join(to("a"), "a").join(to("b"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "weight")
        merged = materialize(merged.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "net-level")
        inner = merged.where("a = b").select(F.col("a").alias("node"), "weight").unionByName(
            loops.join(moved, "node").select(F.col("community").alias("node"), "weight"))
        loops = materialize(inner.groupBy("node").agg(F.sum("weight").alias("weight")), "net-loops")
        graph = merged.where("a <> b")


def connected_parts(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """``(node, community)`` with every community split into its connected parts, named by their smallest node.

    Each round a node takes the smallest label around it and then its label's label, so labels
    run along paths in doubling steps; only edges inside communities are kept.
    """
    comm = materialize(comm.select("node", "community"), "net-parts")
    to = lambda c: comm.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    inner = edges.join(to("a"), "a").join(to("b"), "b").where((F.col("ca") == F.col("cb")) & (F.col("a") != F.col("b"))).select("a", "b")
    inner = materialize(inner.unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b"))), "net-inner")
    label = comm.select("node", F.col("node").alias("part"))
    while True:
        around = inner.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("seen"))
        low = materialize(label.join(around, "node", "left").select("node", F.col("part").alias("old"), F.least("part", "seen").alias("low")), "net-parts")
        ahead = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        label = materialize(low.join(ahead, "low").select("node", "old", F.least("low", "next").alias("part")), "net-parts")
        if label.where("old <> part").isEmpty():
            return label.select("node", F.col("part").alias("community"))
        label = label.select("node", "part")


def _quality(edges: DataFrame, deg: DataFrame, comm: DataFrame, m: float) -> float:
    """Modularity of a level's graph but for the share of its loops, which no move changes."""
    to = lambda c: comm.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    inner = edges.join(to("a"), "a").join(to("b"), "b").where("ca = cb").agg(F.sum("weight")).first()[0] or 0.0
    spread = deg.join(comm, "node").groupBy("community").agg(F.sum("k").alias("d")).agg(F.sum(F.pow(F.col("d") / (2.0 * m), 2))).first()[0] or 0.0
    return float(inner) / m - float(spread)


def _moved(edges: DataFrame, loops: DataFrame, m: float) -> DataFrame:
    """One level: ``(node, community)``. Rounds go on until no node moves in either direction, or
    until a round in each direction no longer raises the modularity of the level's graph."""
    both = _degrees(edges).unionByName(loops.select("node", (2 * F.col("weight")).alias("k")))
    deg = materialize(both.groupBy("node").agg(F.sum("k").alias("k")), "net-degrees")
    comm = deg.select("node", F.col("node").alias("community"))
    und = materialize(edges.select("a", "b", "weight").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "net-edges")
    idle, rnd, best_q = 0, -1, -2.0
    while True:
        rnd += 1
        comm = materialize(comm, "net-comm")
        if rnd and rnd % 2 == 0:
            q = _quality(edges, deg, comm, m)
            if q <= best_q + 1e-12:
                break
            best_q = q
        tot = (comm.join(deg, "node").groupBy("community").agg(F.sum("k").alias("tot")))
        # weight from each node to each neighbouring community
        kin = (und.join(comm.withColumnRenamed("node", "b").withColumnRenamed("community", "cb"), "b")
               .where(F.col("a") != F.col("b"))
               .groupBy("a", "cb").agg(F.sum("weight").alias("kin")))
        me = comm.withColumnRenamed("node", "a").withColumnRenamed("community", "own").join(
            deg.withColumnRenamed("node", "a"), "a")
        cand = (kin.join(me, "a").join(tot.withColumnRenamed("community", "cb"), "cb")
                .withColumn("tot_wo", F.when(F.col("cb") == F.col("own"), F.col("tot") - F.col("k")).otherwise(F.col("tot")))
                .withColumn("gain", F.col("kin") - F.col("tot_wo") * F.col("k") / F.lit(2.0 * m)))
        own_gain = (me.join(tot.withColumnRenamed("community", "own"), "own")
                    .join(kin.withColumnRenamed("cb", "own"), ["a", "own"], "left")
                    .select("a", (F.coalesce("kin", F.lit(0.0)) - (F.col("tot") - F.col("k")) * F.col("k") / F.lit(2.0 * m))
                            .alias("g_own")))
        direction = (F.col("cb") < F.col("own")) if rnd % 2 == 0 else (F.col("cb") > F.col("own"))
        best = (cand.where(direction).groupBy("a")
                .agg(F.max(F.struct(F.col("gain"), F.col("cb"))).alias("bst"))
                .join(own_gain, "a")
                .where(F.col("bst.gain") > F.col("g_own") + 1e-12)
                .select(F.col("a").alias("node"), F.col("bst.cb").alias("new")))
        best = materialize(best, "net-moves")
        if best.count() == 0:
            idle += 1
            if idle >= 2:  # neither direction moves anything: converged
                break
            continue
        idle = 0
        comm = comm.join(best, "node", "left").select("node", F.coalesce("new", "community").alias("community"))
    return comm


def theme_table(df: DataFrame, key: str = "row_id", themes: DataFrame | None = None) -> DataFrame:
    """Per theme: frequency (rows), negative rows and majority sentiment (ties -> larger code).

    Themes are a row's factors, or with ``themes(key, theme)`` e.g. the names of its clusters.
    """
    if themes is None:
        tr = theme_rows(df, key)
    else:
        tr = df.select(key, "sentiment").join(themes.select(key, "theme").distinct(), key)
    tr = tr.withColumn("code", R.sentiment_code("sentiment", 0))
    per = tr.groupBy("theme", "sentiment", "code").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("theme").agg(
        F.sum("n").alias("frequency"),
        F.sum(F.when(F.col("sentiment") == "负面", F.col("n")).otherwise(0)).alias("n_negative"),
        F.max(F.struct("n", "code", "sentiment")).alias("_maj")).select(
        "theme", F.col("frequency").cast("long").alias("frequency"), F.col("n_negative").cast("long").alias("n_negative"),
        F.col("_maj.sentiment").alias("sentiment"))


def theme_ranking(df: DataFrame, k: int | None = None, key: str = "row_id", themes: DataFrame | None = None) -> DataFrame:
    """Themes ``(rank, theme, frequency, sentiment)``, all of them or the top k."""
    top = materialize(theme_table(df, key, themes), "themes")  # sampled for the ranks: computed once
    top = top.orderBy(F.desc("frequency"), F.asc("theme")).limit(k) if k else top
    return numbered(top, [], [F.desc("frequency"), F.asc("theme")], "rank").select("rank", "theme", "frequency", "sentiment")


def theme_priority(df: DataFrame, k: int | None = None, key: str = "row_id", themes: DataFrame | None = None) -> DataFrame:
    """Themes (all, or the top k) by negative share x frequency (= negative rows), ties by frequency desc, theme asc."""
    t = materialize(theme_table(df, key, themes), "themes").withColumn("negative_share", F.col("n_negative") / F.col("frequency")) \
        .withColumn("priority", F.col("negative_share") * F.col("frequency"))
    top = t.orderBy(F.desc("priority"), F.desc("frequency"), F.asc("theme")).limit(k) if k else t
    return numbered(top, [], [F.desc("priority"), F.desc("frequency"), F.asc("theme")], "rank").select(
        "rank", "theme", "frequency", "n_negative", F.round("negative_share", 6).alias("negative_share"),
        F.round("priority", 6).alias("priority"))
