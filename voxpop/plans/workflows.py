"""The reference's three workflows as composable DataFrame plans.

1. ``label_and_evaluate``: posts -> demand and sentiment labels -> distributions
   -> optional evaluation against a truth table keyed by ``row_id``.
2. ``mine_factors``: labelled posts -> factor lists -> row table, counts, top-k,
   JSON-shaped group stats.
3. ``cluster_and_name``: factor texts -> vectors (built-in or user encoder) ->
   exact Ward sweep -> assignments -> names, samples and the cluster report.

Stages hand DataFrames to each other; ``write_outputs`` is the only place that
writes files (K1, K3, K5, K6).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import reply as R
from voxpop.functions import text as X
from voxpop.operators import clustering as CL
from voxpop.operators import distribution as D
from voxpop.operators import evaluation as E
from voxpop.operators import factors as FA
from voxpop.operators import naming as NM
from voxpop.operators import scoring as SC
from voxpop.operators import vectors as V
from voxpop.session import materialize
from voxpop.sinks import files as K


@dataclass
class Labelled:
    posts: DataFrame  # row_id, text, demand, sentiment, sentiment_code, is_blank
    demand_stats: DataFrame
    sentiment_stats: DataFrame
    n_blank: DataFrame  # one row: rows, n_blank
    demand_eval: DataFrame | None
    sentiment_eval: DataFrame | None


def label_and_evaluate(posts: DataFrame, demand: S.Taxonomy | None = None, sentiment: S.Taxonomy | None = None,
                       demand_truth: DataFrame | None = None, sentiment_truth: DataFrame | None = None,
                       demand_scorer: SC.Scorer | None = None, sentiment_scorer: SC.Scorer | None = None,
                       require_same_rows: bool = False, demand_template: str = "{}",
                       sentiment_template: str = "{}") -> Labelled:
    """Workflow 1. Truth tables are ``(row_id, truth)``; evaluation is skipped when absent.

    A scorer runs once per post: its labels are written before anything reads
    them. ``demand_error`` and ``sentiment_error`` keep why a row has no reply.
    With ``require_same_rows`` posts and truth tables are counted before any scorer runs.
    """
    if require_same_rows:
        for truth in (demand_truth, sentiment_truth):
            if truth is not None:
                E.require_equal_rows(posts, truth)
    demand = demand or S.demand_taxonomy()
    sentiment = sentiment or S.sentiment_taxonomy()
    if demand_scorer is None:
        lab = SC.label_with_rules(posts, demand, "text", "demand")
    else:
        lab = SC.label_with_scorer(posts, demand_scorer, demand, "text", "demand", demand_template, match="exact")
        lab = materialize(lab.withColumnRenamed("score_error", "demand_error"), "demand")
    if sentiment_scorer is None:
        lab = SC.label_with_rules(lab.drop("is_blank"), sentiment, "text", "sentiment")
    else:
        lab = SC.label_with_scorer(lab.drop("is_blank"), sentiment_scorer, sentiment, "text", "sentiment",
                                   sentiment_template, match="contains")
        lab = materialize(lab.withColumnRenamed("score_error", "sentiment_error"), "sentiment")
    lab = lab.withColumn("sentiment_code", R.sentiment_code("sentiment"))
    d_eval = s_eval = None
    if demand_truth is not None:
        d_eval = E.evaluation_report(E.align(lab, demand_truth, "row_id", "demand", "truth"), None, 4)
    if sentiment_truth is not None:
        s_eval = E.evaluation_report(E.align(lab, sentiment_truth, "row_id", "sentiment", "truth"),
                                     S.SENTIMENT_LABELS, None)
    return Labelled(lab, D.label_distribution(lab, demand, "demand", order="count"),
                    D.label_distribution(lab, sentiment, "sentiment", order="category"), D.blank_rows(lab), d_eval, s_eval)


@dataclass
class Mined:
    rows: DataFrame
    counts: DataFrame
    top: DataFrame
    stats: DataFrame
    table: DataFrame  # labelled posts with factors


def mine_factors(labelled: DataFrame, cues: list[tuple[str, str]] | None = None, scorer: SC.Scorer | None = None,
                 k: int = 10, template: str = "{}", demands: list[str] | None = None,
                 sentiments: list[str] | None = None) -> Mined:
    """Workflow 2. The template may hold ``{text}``, ``{demand}`` and ``{sentiment}``; a scorer runs once per post.

    ``demands`` and ``sentiments`` keep posts with one of these labels (None: all), before any scorer sees them.
    """
    for column, labels in (("demand", demands), ("sentiment", sentiments)):
        if labels is not None:
            labelled = labelled.where(F.col(column).isin(list(labels)))
    slots = {"demand": "demand", "sentiment": "sentiment"}
    table = SC.extract_factors(labelled, "text", cues, scorer, template, slots=slots)
    if scorer is not None:
        table = materialize(table, "factors")
    counts = FA.factor_counts(table)
    top = FA.top_factors(counts, k)
    return Mined(FA.factor_rows(table), counts, top, FA.stats_json(top), table)


@dataclass
class Clustered:
    result: CL.ClusterResult
    report: DataFrame | None


def cluster_and_name(factor_table: DataFrame, text_col: str = "factors_text", thresholds: list[float] | None = None,
                     encoder_vectors: DataFrame | None = None, exclude_sentinels: bool = False,
                     namer: SC.Scorer | None = None, name_template: str = "{}") -> Clustered:
    """Workflow 3 over the joined factor strings (the reference's unit of clustering).

    ``namer``: a scorer from a cluster's texts to its standard phrase; the
    built-in one takes the most frequent factor.

    ``encoder_vectors``: optional ``(row_id, embedding)`` from a user encoder;
    default is the built-in hashed character n-gram TF-IDF.
    """
    texts = factor_table.select("row_id", (X.join_factors("factors") if "factors" in factor_table.columns
                                           else F.col(text_col)).alias("text")).where(F.col("text").isNotNull())
    if exclude_sentinels:
        texts = texts.where(~F.col("text").isin(*S.FACTOR_SENTINELS))
    if encoder_vectors is not None:
        res = CL.cluster_texts(texts.join(encoder_vectors, "row_id"), "row_id", "embedding", dedupe_col="text", thresholds=thresholds)
    else:  # equal texts have equal vectors: one for each text, and rows by id as in the join above
        texts = materialize(texts, "cluster-texts")
        vecs = V.text_vectors(texts, "text", "text", of=texts.select("text").distinct())
        rows = texts.join(texts.select("row_id"), "row_id")
        res = CL.cluster_texts(rows, "row_id", "embedding", dedupe_col="text", thresholds=thresholds, vectors=vecs)
    report = None
    if res.best_threshold is not None:
        placed = res.assignments.where(F.col("cluster_id").isNotNull())
        names = None
        if namer is not None:
            names = materialize(NM.name_with_scorer(placed, namer, "cluster_id", "row_id", "text", name_template), "names")
        report = NM.cluster_report(placed, "cluster_id", "row_id", "text", names=names)
    return Clustered(res, report)


def write_outputs(base: str, labelled: Labelled | None = None, mined: Mined | None = None,
                  clustered: Clustered | None = None) -> dict[str, str]:
    """K1, K3, K5, K6: result tables as CSV (export names) and Parquet, stats JSON, cluster report."""
    out: dict[str, str] = {}
    if labelled is not None:
        out["labels"] = K.write_parquet(labelled.posts, f"{base}/labels")
        out["labels_csv"] = K.write_csv(labelled.posts.select("text", "demand", "sentiment", "sentiment_code"),
                                        f"{base}/labels_csv", export_names=True)
        for name, stats in (("demand_stats", labelled.demand_stats), ("sentiment_stats", labelled.sentiment_stats)):
            out[name] = K.write_csv(stats.select("label", "n", "share_pct"), f"{base}/{name}", export_names=True)
        for name, ev in (("demand_eval", labelled.demand_eval), ("sentiment_eval", labelled.sentiment_eval)):
            if ev is not None:
                out[name] = K.write_csv(ev.drop("is_total"), f"{base}/{name}", export_names=True)
    if mined is not None:
        out["factor_rows"] = K.write_csv(mined.rows, f"{base}/factor_rows", export_names=True)
        out["factor_stats"] = K.write_stats_object(mined.stats, f"{base}/factor_stats")
    if clustered is not None:
        out["clusters"] = K.write_csv(clustered.result.assignments, f"{base}/clusters", export_names=True)
        out["sweep"] = K.write_csv(clustered.result.sweep, f"{base}/sweep")
        members = clustered.result.assignments.where(F.col("cluster_id").isNotNull())
        if "text" in members.columns:
            out["listing"] = K.write_listing(K.listing_lines(members), f"{base}/listing")
        if clustered.report is not None:
            out["report"] = K.write_cluster_report(clustered.report, f"{base}/report")
    return out
