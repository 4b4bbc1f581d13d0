"""Cluster naming and samples.

Built-in name: the most frequent factor among a cluster's texts (the naming
prompt asks for the most frequent core word), ties to the first seen; a cluster
without any factor gets the reference's fallback ``【自动生成】`` + first text[:50]
+ ``...``. Both are aggregations with map-side partial aggregation (``max`` of a
struct), so a cluster holding a third of all rows is never one task.

A pluggable namer gets prompts built by Spark from bounded ranges of the cluster's
distinct texts (with their counts), then prompts built from the names of the
ranges, until one is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import reply as R
from voxpop.functions import text as X
from voxpop.operators import ordering as O
from voxpop.operators.factors import first_seen_key
from voxpop.operators import scoring as SC
from voxpop.session import materialize


def fallback_name(first_text) -> object:
    """``'【自动生成】' + text[:50] + '...'`` (dots always added)."""
    return F.concat(F.lit(S.NAME_FALLBACK_PREFIX), F.substring(first_text, 1, S.FALLBACK_NAME_LIMIT), F.lit("..."))


def first_texts(df: DataFrame, cluster_col: str = "cluster_id", key: str = "row_id", text_col: str = "text") -> DataFrame:
    """Per cluster: size and first text in input order (A15 + the fallback's input).

    Sizes and smallest keys are a hash aggregate; only one text per cluster is fetched.
    """
    heads = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("cluster_size"), F.min(key).alias(key))
    return heads.join(df.select(cluster_col, key, text_col), [cluster_col, key]).select(
        cluster_col, "cluster_size", F.col(text_col).alias("first_text"))


def top_factor_names(df: DataFrame, cluster_col: str = "cluster_id", key: str = "row_id", text_col: str = "text",
                     split: bool = True) -> DataFrame:
    """U5 built-in: ``(cluster_id, cluster_size, top_factor, top_n, name)``.

    ``split=True``: a text is a '，'-joined factor list (the reference clusters
    joined factor strings); each factor counts once per occurrence.
    """
    items = F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), "，", ","), ",") if split else F.array(F.col(text_col))
    occ = (df.select(cluster_col, key, F.posexplode(items).alias("pos", "f"))
           .withColumn("f", X.py_strip("f")).where(F.col("f") != ""))
    counts = occ.groupBy(cluster_col, "f").agg(F.count(F.lit(1)).alias("n"),
                                               F.min(first_seen_key(F.col(key), F.col("pos"))).alias("fk"))
    # most frequent, then first seen: a max over (n, -first) per cluster (partial aggregation, no window)
    best = counts.groupBy(cluster_col).agg(F.max(F.struct(F.col("n"), (-F.col("fk")).alias("nfk"), F.col("f"))).alias("b"))
    heads = first_texts(df, cluster_col, key, text_col)
    return (heads.join(best, cluster_col, "left")
            .select(cluster_col, "cluster_size", F.col("b.f").alias("top_factor"), F.col("b.n").alias("top_n"),
                    F.coalesce(F.col("b.f"), fallback_name(F.col("first_text"))).alias("name"), "first_text"))


def samples(df: DataFrame, cluster_col: str = "cluster_id", key: str = "row_id", text_col: str = "text",
            k: int = 5) -> DataFrame:
    """T4 + T5: the first ``k`` texts per cluster in input order, numbered 1..k."""
    return O.top_k_within(df.select(cluster_col, key, text_col), [cluster_col], [F.col(key).asc()], k, key,
                          rank_col="pos")


def cluster_report(df: DataFrame, cluster_col: str = "cluster_id", key: str = "row_id", text_col: str = "text",
                   k: int = 5, names: DataFrame | None = None) -> DataFrame:
    """K5 rows: cluster id, size, standard phrase, up to ``k`` samples (ARRAY in order).

    ``names``: (cluster, cluster_size, name) of another namer than the built-in one.
    """
    names = top_factor_names(df, cluster_col, key, text_col) if names is None else names
    smp = (samples(df, cluster_col, key, text_col, k).groupBy(cluster_col)
           .agg(F.sort_array(F.collect_list(F.struct("pos", text_col))).alias("_s")))  # at most k per cluster
    return (names.join(smp, cluster_col)
            .select(F.col(cluster_col).alias("cluster_id"), "cluster_size", "name",
                    F.transform("_s", lambda x: x[text_col]).alias("samples"))
            .orderBy("cluster_id"))


#: Most lines in one prompt of a namer, and characters after which a prompt takes no further line.
PROMPT_LINES, PROMPT_CHARS = 200, 100_000


def _prompts(lines: DataFrame, chars: int | None) -> DataFrame:
    """``lines(cluster, text, n, first, head, error)``, one per distinct text, as prompt bodies of bounded ranges of each cluster's lines.

    A range has at most ``PROMPT_LINES`` lines in the order of ``first``; with
    ``chars`` it is cut again where that many characters are full. Inside a
    prompt the most frequent text comes first.
    """
    line = F.format_string("%s (x%d)", F.col("text"), F.col("n"))
    placed = O.number_within(lines, ["cluster"], "first", out_col="pos")
    placed = placed.withColumn("part", F.floor((F.col("pos") - 1) / PROMPT_LINES)).withColumn("cut", F.lit(0).cast("long"))
    if chars is not None:  # over the few lines of one range
        w = Window.partitionBy("cluster", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("cut", F.floor(F.coalesce(F.sum(F.length(line)).over(w), F.lit(0)) / chars))
    item = F.struct((-F.col("n")).alias("rk"), "first", line.alias("line"))
    ranges = placed.groupBy("cluster", "part", "cut").agg(
        F.sort_array(F.collect_list(item)).alias("_l"), F.sum("n").alias("n"), F.min("first").alias("first"),
        F.min_by("head", "first").alias("head"), F.min("error").alias("error"))
    return ranges.select("cluster", "n", "first", "head", "error", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("body"))


def name_with_scorer(df: DataFrame, scorer: SC.Scorer, cluster_col: str = "cluster_id", key: str = "row_id",
                     text_col: str = "text", template: str = "{}", max_lines: int | None = None) -> DataFrame:
    """U5 with a pluggable namer: prompts made of the cluster's distinct texts as ``text (xN)``
    lines, most frequent first (all of them, or ``max_lines`` where the caller wants fewer);
    the reply is stripped of quotes, spaces and newlines (F2).

    ``key`` is an integer. A cluster of at most ``PROMPT_LINES`` texts and about
    ``PROMPT_CHARS`` characters is one prompt. A larger one is cut into ranges of
    that size; each range gets a name, and the names, with the rows they stand
    for as N, are the lines of the next round, until one prompt is left. Each
    round runs at once and its replies are written, so no prompt is asked twice.

    A failure gives the fallback name of the cluster. A range that fails stands
    in the next round with the fallback name of its first text, and its error
    stays in ``score_error`` beside the cluster's name.
    """
    heads = first_texts(df, cluster_col, key, text_col)
    lines = df.groupBy(F.col(cluster_col).alias("cluster"), F.col(text_col).alias("text")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    if max_lines is not None:
        lines = O.top_k_within(lines, ["cluster"], [F.desc("n"), F.asc("first")], max_lines, "text").drop("rank")
    lines = lines.withColumn("head", fallback_name(F.col("text"))).withColumn("error", F.lit(None).cast("string"))
    lines, chars, done = materialize(lines, "name-lines"), PROMPT_CHARS, []
    while True:
        scored = SC.score_replies(_prompts(lines, chars), scorer, X.fill_template(template, "body", None)).drop("body")
        scored = materialize(scored, "name-replies")
        reply = F.when(F.col("score_error").isNull() & F.col("_reply").isNotNull(),
                       X.strip_chars(R.reply_content("_reply"), "\"' \n"))
        scored = scored.withColumn("_name", reply).withColumn("error", F.coalesce("score_error", "error"))
        scored = scored.join(scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("_prompts")), "cluster")
        done.append(scored.where("_prompts = 1").select(F.col("cluster").alias(cluster_col), "_name", F.col("error").alias("score_error")))
        rest = scored.where("_prompts > 1")
        if rest.isEmpty():
            break
        lines = rest.groupBy("cluster", F.coalesce("_name", "head").alias("text")).agg(
            F.sum("n").alias("n"), F.min_by("head", "first").alias("head"), F.min("first").alias("first"), F.min("error").alias("error"))
        lines = materialize(lines, "name-lines")
        chars = None  # replies are short; a range of them always has fewer lines than it replaces
    return heads.join(reduce(DataFrame.unionByName, done), cluster_col).select(
        cluster_col, "cluster_size", F.coalesce("_name", fallback_name(F.col("first_text"))).alias("name"), "score_error")
