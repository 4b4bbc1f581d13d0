"""Registered queries over the driver's tables, and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables.
Column names are aliased identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import reply as R
from voxpop.functions import text as X
from voxpop.operators import distribution as D
from voxpop.operators import evaluation as E
from voxpop.operators import factors as FA
from voxpop.operators import scoring as SC
from voxpop.plans import sqlgen as G
from voxpop.plans import tables as TB

PROMPT_TEMPLATE = 'Which need level does this passenger post show? Reply with one level name.\nPost: "{}"\nLevel:'

# ----------------------------------------------------------------------------- shared plans


def labelled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with demand and sentiment labels (rule scorers; one narrow pass)."""
    p = TB.posts(spark, sf_dir)
    p = SC.label_with_rules(p, TB.demo_demand(), "text", "demand")
    return SC.label_with_rules(p.drop("is_blank"), TB.demo_sentiment(), "text", "sentiment")


def factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.extract_factors(labelled_posts(spark, sf_dir), "text", TB.DEMO_FACTOR_CUES)


# ----------------------------------------------------------------------------- text & labels


def q_text_normalize(spark, sf_dir):
    p = TB.posts(spark, sf_dir)
    norm = X.normalized("text")
    return p.select(
        "row_id",
        (F.col("row_id") + 1).cast("long").alias("ordinal"),
        F.length(norm).cast("long").alias("n_chars_stripped"),
        (norm == "").alias("is_blank"),
        F.length(X.truncate(norm)).cast("long").alias("n_chars_scored"),
        X.preview("text").alias("preview"),
    )


def q_prompt_build(spark, sf_dir):
    p = TB.posts(spark, sf_dir)
    return p.select("row_id", X.fill_template(PROMPT_TEMPLATE, X.normalized("text")).alias("prompt"))


def q_demand_labels(spark, sf_dir):
    lab = SC.label_with_rules(TB.posts(spark, sf_dir), TB.demo_demand(), "text", "demand")
    return lab.select("row_id", "demand", "is_blank")


def q_demand_distribution(spark, sf_dir):
    lab = SC.label_with_rules(TB.posts(spark, sf_dir), TB.demo_demand(), "text", "demand")
    d = D.label_distribution(lab, TB.demo_demand(), "demand", order="count")
    return d.withColumn("share", F.round("share", 6))


def q_sentiment_labels(spark, sf_dir):
    lab = SC.label_with_rules(TB.turns(spark, sf_dir), TB.demo_sentiment(), "text", "sentiment")
    return lab.select("conv_id", "turn", "sentiment", R.sentiment_code("sentiment", 0).alias("sentiment_code"))


def q_sentiment_distribution(spark, sf_dir):
    lab = SC.label_with_rules(TB.turns(spark, sf_dir), TB.demo_sentiment(), "text", "sentiment")
    d = D.label_distribution(lab, TB.demo_sentiment(), "sentiment", order="category")
    return d.withColumn("share", F.round("share", 6))


def q_reply_json_extract(spark, sf_dir):
    ev = TB.load(spark, sf_dir, "events")
    return ev.select("event_id",
                     R.reply_content("props", "$.k").alias("content"),
                     R.exact_label("event_type", ["click", "view"], "other").alias("type_label"))


# ----------------------------------------------------------------------------- evaluation


def quality_pairs(spark, sf_dir):
    pred = SC.label_with_rules(TB.posts(spark, sf_dir), TB.demo_quality(), "text", "pred")
    return E.align(pred, TB.quality_truth(spark, sf_dir), "row_id", "pred", "truth")


def q_confusion_matrix(spark, sf_dir):
    return E.confusion_long(quality_pairs(spark, sf_dir))


def q_confusion_crosstab(spark, sf_dir):
    t = TB.quality_truth(spark, sf_dir).select("truth", F.col("toxic_label").alias("pred"))
    return E.crosstab(t)


def q_class_metrics(spark, sf_dir):
    return E.class_metrics(quality_pairs(spark, sf_dir), round_to=4)


def q_evaluation_report(spark, sf_dir):
    r = E.evaluation_report(quality_pairs(spark, sf_dir), round_to=4)
    return r.withColumn("accuracy", F.round("accuracy", 6))


# ----------------------------------------------------------------------------- factors


def q_factor_rows(spark, sf_dir):
    return FA.factor_rows(factor_table(spark, sf_dir))


def q_factor_counts(spark, sf_dir):
    c = FA.factor_counts(factor_table(spark, sf_dir))
    return c.select("demand", "sentiment", "factor", "n", "group_total", "first_row",
                    F.col("first_pos").cast("long").alias("first_pos"))


def _top(spark, sf_dir, k):
    t = FA.top_factors(FA.factor_counts(factor_table(spark, sf_dir)), k)
    return t.select("demand", "sentiment", F.col("rank").cast("long").alias("rank"), "factor", "n", "group_total")


def q_factor_top10(spark, sf_dir):
    return _top(spark, sf_dir, 10)


def q_factor_top5(spark, sf_dir):
    return _top(spark, sf_dir, 5)


def q_factor_stats_json(spark, sf_dir):
    from voxpop.sinks import files as K

    top = FA.top_factors(FA.factor_counts(factor_table(spark, sf_dir)), 10)
    stats = FA.stats_json(top)
    path = K.write_stats_json(stats)
    back = spark.read.schema(K.STATS_JSON_SCHEMA).json(path)
    return back.select("group_key", F.col("total").cast("long").alias("total"),
                       F.posexplode("top_factors").alias("pos", "f")).select(
        "group_key", "total", (F.col("pos") + 1).cast("long").alias("rank"),
        F.col("f.factor").alias("factor"), F.col("f.n").cast("long").alias("n"))


def q_demand_sentiment_cube(spark, sf_dir):
    return D.demand_sentiment_table(labelled_posts(spark, sf_dir), with_totals=True)


# ============================================================================= oracle SQL


def _posts_labelled_sql() -> str:
    return (f"SELECT doc_id AS row_id, text, {G.labelled_case(TB.demo_demand())} AS demand, "
            f"{G.labelled_case(TB.demo_sentiment())} AS sentiment FROM documents")


def _factor_sql() -> str:
    pattern = S.literal_alternation([c for c, _ in TB.DEMO_FACTOR_CUES])
    return f"""
    WITH base AS ({_posts_labelled_sql()}),
    m AS (SELECT *, list_transform(regexp_extract_all(text, {G.q(pattern)}), lambda x: {G.map_case('x', TB.DEMO_FACTOR_CUES)}) AS names FROM base),
    d AS (SELECT *, list_filter(names, lambda x, i: NOT list_contains(names[1:i-1], x)) AS uniq FROM m),
    f AS (SELECT *, list_filter(uniq, lambda x: length(x) BETWEEN 2 AND 5) AS kept FROM d),
    g AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE ['无法提取'] END AS factors FROM f)
    """


def _factor_counts_sql() -> str:
    return _factor_sql() + """,
    e AS (SELECT row_id, demand, sentiment, unnest(factors) AS factor, generate_subscripts(factors, 1) - 1 AS pos
          FROM g WHERE factors[1] NOT IN ('无法提取', 'API错误')),
    c AS (SELECT demand, sentiment, factor, count(*) AS n, min({'r': row_id, 'p': pos}) AS fs FROM e GROUP BY ALL),
    c2 AS (SELECT demand, sentiment, factor, n, sum(n) OVER (PARTITION BY demand, sentiment) AS group_total,
           fs.r AS first_row, fs.p AS first_pos FROM c)
    """


def _top_sql(k: int) -> str:
    return _factor_counts_sql() + f""",
    t AS (SELECT *, row_number() OVER (PARTITION BY demand, sentiment ORDER BY n DESC, first_row, first_pos) AS rank FROM c2)
    SELECT demand, sentiment, rank, factor, n, CAST(group_total AS BIGINT) AS group_total FROM t WHERE rank <= {k}
    """


def _quality_pairs_sql() -> str:
    return f"""
    WITH pred AS (SELECT doc_id AS row_id, {G.labelled_case(TB.demo_quality())} AS pred FROM documents),
    truth AS (SELECT doc_id AS row_id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS truth FROM labels),
    p AS (SELECT truth, pred FROM pred JOIN truth USING (row_id)),
    labs AS (SELECT truth AS label FROM p UNION SELECT pred FROM p)
    """


def _dist_sql(t: S.Taxonomy, label_sql: str, table: str) -> str:
    return f"""
    WITH lab AS (SELECT {label_sql} AS label, {G.norm('text')} = '' AS is_blank FROM {table}),
    c AS (SELECT label, count(*) FILTER (WHERE NOT is_blank) AS n FROM lab GROUP BY label),
    tot AS (SELECT count(*) AS n_total FROM lab),
    dim AS {G.values_dim(t)}
    SELECT dim.label, dim.ordinal, CAST(coalesce(c.n, 0) AS BIGINT) AS n, tot.n_total,
           round(CASE WHEN tot.n_total > 0 THEN coalesce(c.n, 0) / tot.n_total ELSE 0 END, 6) AS share,
           printf('%.2f%%', (CASE WHEN tot.n_total > 0 THEN coalesce(c.n, 0) / tot.n_total ELSE 0 END) * 100.0) AS share_pct
    FROM dim LEFT JOIN c ON c.label = dim.label CROSS JOIN tot
    """


def _class_metrics_sql() -> str:
    return _quality_pairs_sql() + """,
    s AS (SELECT l.label,
            count(*) FILTER (WHERE p.truth = l.label AND p.pred = l.label) AS tp,
            count(*) FILTER (WHERE p.truth <> l.label AND p.pred = l.label) AS fp,
            count(*) FILTER (WHERE p.truth = l.label AND p.pred <> l.label) AS fn
          FROM labs l LEFT JOIN p ON p.truth = l.label OR p.pred = l.label GROUP BY l.label),
    m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM s)
    """


def oracle() -> dict[str, str]:
    n = G.norm("text")
    return {
        "text_normalize": f"""
            SELECT doc_id AS row_id, doc_id + 1 AS ordinal, CAST(length({n}) AS BIGINT) AS n_chars_stripped,
                   {n} = '' AS is_blank, CAST(length(substring({n}, 1, 500)) AS BIGINT) AS n_chars_scored,
                   CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
            FROM documents""",
        "prompt_build": f"""
            SELECT doc_id AS row_id, {G.q(PROMPT_TEMPLATE.split('{}')[0])} || substring({n}, 1, 500) || {G.q(PROMPT_TEMPLATE.split('{}')[1])} AS prompt
            FROM documents""",
        "demand_labels": f"""
            SELECT doc_id AS row_id, {G.labelled_case(TB.demo_demand())} AS demand, {n} = '' AS is_blank FROM documents""",
        "demand_distribution": _dist_sql(TB.demo_demand(), G.labelled_case(TB.demo_demand()), "documents"),
        "sentiment_labels": f"""
            WITH s AS (SELECT conv_id, turn, {G.labelled_case(TB.demo_sentiment())} AS sentiment FROM conversations)
            SELECT conv_id, turn, sentiment,
                   CAST(CASE sentiment WHEN '正面' THEN 1 WHEN '中性' THEN 0 WHEN '负面' THEN -1 ELSE 0 END AS INTEGER) AS sentiment_code
            FROM s""",
        "sentiment_distribution": _dist_sql(TB.demo_sentiment(), G.labelled_case(TB.demo_sentiment()), "conversations"),
        "reply_json_extract": """
            SELECT event_id, coalesce(json_extract_string(props, '$.k'), props) AS content,
                   CASE WHEN trim(event_type) IN ('click', 'view') THEN trim(event_type) ELSE 'other' END AS type_label
            FROM events""",
        "confusion_matrix": _quality_pairs_sql() + """,
            c AS (SELECT truth, pred, count(*) AS n FROM p GROUP BY ALL)
            SELECT a.label AS truth, b.label AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
            FROM labs a CROSS JOIN labs b LEFT JOIN c ON c.truth = a.label AND c.pred = b.label""",
        "confusion_crosstab": """
            SELECT CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS truth,
                   count(*) FILTER (WHERE toxic <> 1) AS clean, count(*) FILTER (WHERE toxic = 1) AS toxic
            FROM labels GROUP BY 1""",
        "class_metrics": _class_metrics_sql() + """
            SELECT label, tp, fp, fn, CAST(printf('%.4f', pr) AS DOUBLE) AS precision, CAST(printf('%.4f', rc) AS DOUBLE) AS recall,
                   CAST(printf('%.4f', CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) AS DOUBLE) AS f1,
                   tp + fn AS support
            FROM m""",
        "evaluation_report": _class_metrics_sql() + """
            SELECT label, CAST(printf('%.4f', pr) AS DOUBLE) AS precision, CAST(printf('%.4f', rc) AS DOUBLE) AS recall,
                   CAST(printf('%.4f', CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) AS DOUBLE) AS f1,
                   tp + fn AS support, CAST(NULL AS DOUBLE) AS accuracy, false AS is_total FROM m
            UNION ALL
            SELECT '总体', NULL, NULL, NULL, count(*), round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6), true FROM p""",
        "factor_rows": _factor_sql() + """
            SELECT row_id, row_id + 1 AS ordinal, demand, sentiment,
                   CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview,
                   array_to_string(factors, '，') AS factors_text, CAST(len(factors) AS BIGINT) AS n_factors,
                   CAST(NULL AS VARCHAR) AS error
            FROM g""",
        "factor_counts": _factor_counts_sql() + """
            SELECT demand, sentiment, factor, n, CAST(group_total AS BIGINT) AS group_total, first_row,
                   CAST(first_pos AS BIGINT) AS first_pos FROM c2""",
        "factor_top10": _top_sql(10),
        "factor_top5": _top_sql(5),
        "factor_stats_json": _top_sql(10).replace(
            "SELECT demand, sentiment, rank, factor, n, CAST(group_total AS BIGINT) AS group_total FROM t WHERE rank <= 10",
            "SELECT demand || '-' || sentiment AS group_key, CAST(group_total AS BIGINT) AS total, rank, factor, n "
            "FROM t WHERE rank <= 10"),
        "demand_sentiment_cube": f"""
            WITH b AS ({_posts_labelled_sql()})
            SELECT demand, sentiment, count(*) AS n FROM b GROUP BY CUBE (demand, sentiment)""",
    }


def registry() -> dict:
    return {
        "text_normalize": q_text_normalize,
        "prompt_build": q_prompt_build,
        "demand_labels": q_demand_labels,
        "demand_distribution": q_demand_distribution,
        "sentiment_labels": q_sentiment_labels,
        "sentiment_distribution": q_sentiment_distribution,
        "reply_json_extract": q_reply_json_extract,
        "confusion_matrix": q_confusion_matrix,
        "confusion_crosstab": q_confusion_crosstab,
        "class_metrics": q_class_metrics,
        "evaluation_report": q_evaluation_report,
        "factor_rows": q_factor_rows,
        "factor_counts": q_factor_counts,
        "factor_top10": q_factor_top10,
        "factor_top5": q_factor_top5,
        "factor_stats_json": q_factor_stats_json,
        "demand_sentiment_cube": q_demand_sentiment_cube,
    }


# ============================================================================= vectors, clusters, themes

from voxpop.operators import clustering as CL  # noqa: E402
from voxpop.operators import naming as NM  # noqa: E402
from voxpop.operators import network as NW  # noqa: E402
from voxpop.operators import ordering as OR  # noqa: E402
from voxpop.operators import vectors as V  # noqa: E402



def _emb(spark, sf_dir):
    return TB.load(spark, sf_dir, "embeddings")


def q_cosine_pairs(spark, sf_dir):
    p = V.cosine_pairs(_emb(spark, sf_dir), "vec_id", "embedding", block_rows=1024)
    return p.select("i", "j", F.round("sim", 6).alias("sim"), F.round("dist", 6).alias("dist"))


def q_silhouette_by_label(spark, sf_dir):
    e = _emb(spark, sf_dir)
    sil = V.silhouettes(e, "embedding", "label")
    stats = e.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label").alias("n_clusters"))
    return sil.select(F.round("silhouette", 6).alias("silhouette")).join(stats, how="inner")


def _label_clusters(spark, sf_dir):
    return _emb(spark, sf_dir).select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("cluster_id"))


def q_cluster_sizes(spark, sf_dir):
    return CL.cluster_sizes(_label_clusters(spark, sf_dir)).withColumn("cluster_size", F.col("cluster_size").cast("long"))


def q_cluster_members(spark, sf_dir):
    m = OR.number_within(_label_clusters(spark, sf_dir), ["cluster_id"], "row_id", out_col="pos")
    return CL.with_cluster_size(m).select("cluster_id", "pos", "row_id", "cluster_size")


def _cluster_docs(spark, sf_dir):
    docs = TB.posts(spark, sf_dir).select("row_id", "text")
    return _label_clusters(spark, sf_dir).join(docs, "row_id")


def q_cluster_samples(spark, sf_dir):
    s = NM.samples(_cluster_docs(spark, sf_dir), "cluster_id", "row_id", "text", k=5)
    return s.select("cluster_id", F.col("pos").cast("long").alias("pos"), "row_id", X.preview("text").alias("preview"))


def q_cluster_fallback_name(spark, sf_dir):
    h = NM.first_texts(_cluster_docs(spark, sf_dir), "cluster_id", "row_id", "text")
    return h.select("cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"),
                    NM.fallback_name(F.col("first_text")).alias("name"))


def q_cluster_top_factor(spark, sf_dir):
    ft = factor_table(spark, sf_dir).select("row_id", X.join_factors("factors").alias("factors_text"))
    mem = _label_clusters(spark, sf_dir).join(ft, "row_id")
    n = NM.top_factor_names(mem, "cluster_id", "row_id", "factors_text")
    return n.select("cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"), "top_factor",
                    F.col("top_n").cast("long").alias("top_n"), "name")


def document_clusters(spark, sf_dir):
    """A cluster for every document: (row_id, cluster_id), from its labels, 4 without any."""
    lab = TB.load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), (F.col("quality") * 2 + F.col("toxic")).cast("long").alias("c"))
    return TB.posts(spark, sf_dir).select("row_id").join(lab, "row_id", "left").select(
        "row_id", F.coalesce("c", F.lit(4)).cast("long").alias("cluster_id"))


def _all_docs(spark, sf_dir):
    return document_clusters(spark, sf_dir).join(TB.posts(spark, sf_dir).select("row_id", "text"), "row_id")


def q_document_samples(spark, sf_dir):
    """cluster_samples over all documents, each of which has a cluster."""
    s = NM.samples(_all_docs(spark, sf_dir), "cluster_id", "row_id", "text", k=5)
    return s.select("cluster_id", F.col("pos").cast("long").alias("pos"), "row_id", X.preview("text").alias("preview"))


def q_document_fallback_name(spark, sf_dir):
    """cluster_fallback_name over all documents."""
    h = NM.first_texts(_all_docs(spark, sf_dir), "cluster_id", "row_id", "text")
    return h.select("cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"),
                    NM.fallback_name(F.col("first_text")).alias("name"))


def q_document_top_factor(spark, sf_dir):
    """cluster_top_factor over all documents."""
    ft = factor_table(spark, sf_dir).select("row_id", X.join_factors("factors").alias("factors_text"))
    n = NM.top_factor_names(document_clusters(spark, sf_dir).join(ft, "row_id"), "cluster_id", "row_id", "factors_text")
    return n.select("cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"), "top_factor",
                    F.col("top_n").cast("long").alias("top_n"), "name")


def _ward(spark, sf_dir):
    e = _emb(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "embedding")
    return CL.cluster_texts(e, "row_id", "embedding", dedupe_col="embedding")


def q_ward_clusters(spark, sf_dir):
    r = _ward(spark, sf_dir)
    return r.assignments.select("row_id", "cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"))


def q_threshold_sweep(spark, sf_dir):
    r = _ward(spark, sf_dir)
    return r.sweep.select(F.round("th", 6).alias("th"), F.round("t", 6).alias("t"), "n_clusters", "n_valid",
                          F.round("silhouette", 6).alias("silhouette"))


def q_ward_merges(spark, sf_dir):
    return _ward(spark, sf_dir).merges.withColumn("height", F.round("height", 6))


def q_pca_abs(spark, sf_dir):
    """V11 without the signs of the axes, which are arbitrary."""
    p = V.pca_2d(_emb(spark, sf_dir), "embedding", "vec_id")
    return p.select("vec_id", F.round(F.abs("pc1"), 5).alias("pc1"), F.round(F.abs("pc2"), 5).alias("pc2"))


def q_pca_2d(spark, sf_dir):
    p = V.pca_2d(_emb(spark, sf_dir), "embedding", "vec_id")
    return p.select("vec_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


def q_text_vectors(spark, sf_dir):
    return V.text_vectors(TB.posts(spark, sf_dir), "text", "row_id")


def q_theme_cooccurrence(spark, sf_dir):
    return NW.cooccurrence(factor_table(spark, sf_dir))


def q_theme_communities(spark, sf_dir):
    return NW.communities(NW.cooccurrence(factor_table(spark, sf_dir)))


def q_theme_ranking(spark, sf_dir):
    return NW.theme_ranking(factor_table(spark, sf_dir))


def q_theme_priority(spark, sf_dir):
    return NW.theme_priority(factor_table(spark, sf_dir))


def _members_sql() -> str:
    return "mem AS (SELECT e.label::BIGINT AS cluster_id, d.doc_id AS row_id, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"


def document_clusters_sql() -> str:
    return """mem AS (SELECT coalesce(l.quality * 2 + l.toxic, 4)::BIGINT AS cluster_id, d.doc_id AS row_id, d.text
                            FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _theme_sql() -> str:
    return _factor_sql() + """,
    tr AS (SELECT DISTINCT row_id, sentiment, unnest(list_distinct(factors)) AS theme FROM g
           WHERE factors[1] NOT IN ('无法提取', 'API错误')),
    per AS (SELECT theme, sentiment, CASE sentiment WHEN '正面' THEN 1 WHEN '负面' THEN -1 ELSE 0 END AS code, count(*) AS n
            FROM tr GROUP BY ALL),
    maj AS (SELECT theme, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n DESC, code DESC) AS r FROM per) WHERE r = 1),
    tt AS (SELECT theme, sum(n)::BIGINT AS frequency, sum(CASE WHEN sentiment = '负面' THEN n ELSE 0 END)::BIGINT AS n_negative
           FROM per GROUP BY theme)
    """


# Ward by recursion: all reciprocal nearest neighbours merge in each step, as in any reducible linkage.
WARD_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p0 AS (SELECT a.vec_id AS a, b.vec_id AS b, pow(greatest(0.0, 1 - list_cosine_similarity(a.e, b.e)), 2) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id),
r(it, a, b, s, na, nb, wa, wb) AS (
  SELECT 0, a, b, s, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM p0
  UNION ALL
  SELECT x.it + 1, x.a, x.b, x.s, x.na, x.nb, x.wa, x.wb FROM (
    WITH d AS (SELECT *, 2 * na * nb / (na + nb) * (s / (na * nb) - wa / (na * na) - wb / (nb * nb)) AS h FROM r),
    o AS (SELECT a AS x, b AS y, h FROM d UNION ALL SELECT b, a, h FROM d),
    nn AS (SELECT x, arg_min(y, h) AS y FROM o GROUP BY x),
    m AS (SELECT f.x AS keep, f.y AS gone FROM nn f JOIN nn g ON f.x = g.y AND f.y = g.x WHERE f.x < f.y),
    st AS (SELECT keep, gone, na + nb AS n, wa + wb + s AS w FROM m JOIN d ON a = keep AND b = gone),
    q AS (
      SELECT d.it, coalesce(ga.keep, d.a) AS a, coalesce(gb.keep, d.b) AS b, d.s,
             coalesce(ga.n, ka.n, d.na) AS na, coalesce(gb.n, kb.n, d.nb) AS nb,
             coalesce(ga.w, ka.w, d.wa) AS wa, coalesce(gb.w, kb.w, d.wb) AS wb
      FROM d LEFT JOIN st ga ON ga.gone = d.a LEFT JOIN st gb ON gb.gone = d.b
             LEFT JOIN st ka ON ka.keep = d.a LEFT JOIN st kb ON kb.keep = d.b)
    SELECT max(it) AS it, least(a, b) AS a, greatest(a, b) AS b, sum(s) AS s,
           any_value(CASE WHEN a < b THEN na ELSE nb END) AS na, any_value(CASE WHEN a < b THEN nb ELSE na END) AS nb,
           any_value(CASE WHEN a < b THEN wa ELSE wb END) AS wa, any_value(CASE WHEN a < b THEN wb ELSE wa END) AS wb
    FROM q WHERE a <> b GROUP BY least(a, b), greatest(a, b)) x),
d AS (SELECT *, 2 * na * nb / (na + nb) * (s / (na * nb) - wa / (na * na) - wb / (nb * nb)) AS h FROM r),
o AS (SELECT it, a AS x, b AS y, h FROM d UNION ALL SELECT it, b, a, h FROM d),
nn AS (SELECT it, x, arg_min(y, h) AS y FROM o GROUP BY it, x),
m AS (SELECT f.it, f.x AS keep, f.y AS gone FROM nn f JOIN nn g ON f.it = g.it AND f.x = g.y AND f.y = g.x WHERE f.x < f.y),
t AS (SELECT m.it, gone AS child, keep AS parent, sqrt(greatest(0.0, h)) AS height, na + nb AS size FROM m JOIN d ON d.it = m.it AND a = keep AND b = gone)"""

SWEEP_SQL = WARD_SQL + """,
cut AS (SELECT th, (1 - th) * (SELECT max(height) FROM t) * 0.7 AS t
        FROM (SELECT 0.67 + (0.87 - 0.67) * unnest(range(15)) / 14.0 AS th)),
path(th, t, id, rep) AS (
  SELECT th, t, vec_id, vec_id FROM cut, v
  UNION ALL SELECT path.th, path.t, path.id, t.parent FROM path JOIN t ON t.child = path.rep AND t.height <= path.t),
flat AS (SELECT th, id, min(rep) AS rep FROM path GROUP BY th, id),
size AS (SELECT th, rep, count(*) AS size FROM flat GROUP BY th, rep),
per AS (SELECT th, count(*) AS n_clusters, count(*) FILTER (size > 1) AS n_valid FROM size GROUP BY th),
ok AS (SELECT flat.th, id, flat.rep FROM flat JOIN size ON size.th = flat.th AND size.rep = flat.rep JOIN per ON per.th = flat.th
       WHERE size > 1 AND n_valid >= 2),
dist AS (SELECT a, b, sqrt(s) AS d FROM p0 UNION ALL SELECT b, a, sqrt(s) FROM p0),
mean AS (SELECT x.th, x.id, x.rep, y.rep AS other, avg(d) AS md FROM ok x JOIN ok y ON x.th = y.th AND x.id <> y.id
         JOIN dist ON dist.a = x.id AND dist.b = y.id GROUP BY ALL),
own AS (SELECT th, id, max(CASE WHEN other = rep THEN md END) AS a, min(CASE WHEN other <> rep THEN md END) AS b FROM mean GROUP BY th, id),
sil AS (SELECT th, avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM own GROUP BY th)
"""


def oracle_more() -> dict[str, str]:
    return {
        "ward_merges": WARD_SQL + """
            SELECT child, parent, round(height, 6) AS height, size, (it + 1)::INTEGER AS round FROM t""",
        "threshold_sweep": SWEEP_SQL + """
            SELECT round(cut.th, 6) AS th, round(cut.t, 6) AS t, n_clusters, n_valid, round(silhouette, 6) AS silhouette
            FROM cut JOIN per USING (th) LEFT JOIN sil USING (th)""",
        "ward_clusters": SWEEP_SQL + """
            SELECT id AS row_id, flat.rep AS cluster_id, size AS cluster_size
            FROM flat JOIN size ON size.th = flat.th AND size.rep = flat.rep
            WHERE flat.th = (SELECT th FROM sil ORDER BY silhouette DESC, th LIMIT 1)""",
        "pca_abs": """
            WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
            u AS (SELECT vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM e),
            mu AS (SELECT i, avg(c) AS m FROM u GROUP BY i),
            w AS (SELECT vec_id, u.i, c - m AS c FROM u JOIN mu USING (i)),
            z AS (SELECT vec_id, list(c ORDER BY i) AS x FROM w GROUP BY vec_id),
            cov AS (SELECT a.i, b.i AS j, sum(a.c * b.c) AS s FROM w a JOIN w b USING (vec_id) GROUP BY ALL),
            m1 AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(s ORDER BY j) AS r FROM cov GROUP BY i)),
            it1(n, v) AS (
              SELECT 0, list_transform(c, lambda r, k: 1.0 + k / 100) FROM m1
              UNION ALL SELECT n + 1, list_transform(y, lambda t: t / sqrt(list_dot_product(y, y)))
              FROM (SELECT n, list_transform(c, lambda r: list_dot_product(r, v)) AS y FROM it1, m1 WHERE n < 3000)),
            v1 AS (SELECT v FROM it1 WHERE n = 3000),
            m2 AS (SELECT list_transform(c, lambda r, i: list_transform(r, lambda s, j: s - l * v[i] * v[j])) AS c
                   FROM (SELECT c, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS l FROM m1, v1)),
            it2(n, v) AS (
              SELECT 0, list_transform(c, lambda r, k: 1.0 - k / 90) FROM m2
              UNION ALL SELECT n + 1, list_transform(y, lambda t: t / sqrt(list_dot_product(y, y)))
              FROM (SELECT n, list_transform(c, lambda r: list_dot_product(r, v)) AS y FROM it2, m2 WHERE n < 3000)),
            v2 AS (SELECT v FROM it2 WHERE n = 3000)
            SELECT vec_id, round(abs(list_dot_product(x, v1.v)), 5) AS pc1, round(abs(list_dot_product(x, v2.v)), 5) AS pc2 FROM z, v1, v2""",
        "cosine_pairs": """
            WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
            SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e, b.e), 6) AS sim,
                   round(greatest(0.0, 1 - list_cosine_similarity(a.e, b.e)), 6) AS dist
            FROM v a JOIN v b ON a.vec_id < b.vec_id""",
        "silhouette_by_label": """
            WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
            p AS (SELECT a.vec_id AS i, b.label AS lj, greatest(0.0, 1 - list_cosine_similarity(a.e, b.e)) AS d
                  FROM v a JOIN v b ON a.vec_id <> b.vec_id),
            m AS (SELECT i, lj, avg(d) AS md FROM p GROUP BY ALL),
            s AS (SELECT v.vec_id, max(CASE WHEN lj = v.label THEN md END) AS a, min(CASE WHEN lj <> v.label THEN md END) AS b
                  FROM v JOIN m ON m.i = v.vec_id GROUP BY v.vec_id)
            SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n_rows,
                   (SELECT count(DISTINCT label) FROM embeddings) AS n_clusters FROM s""",
        "cluster_sizes": "SELECT label::BIGINT AS cluster_id, count(*) AS cluster_size FROM embeddings GROUP BY label",
        "cluster_members": """
            SELECT label::BIGINT AS cluster_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos,
                   vec_id AS row_id, count(*) OVER (PARTITION BY label) AS cluster_size FROM embeddings""",
        "cluster_samples": f"""
            WITH {_members_sql()},
            r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) AS pos FROM mem)
            SELECT cluster_id, pos, row_id,
                   CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
            FROM r WHERE pos <= 5""",
        "cluster_fallback_name": f"""
            WITH {_members_sql()}
            SELECT cluster_id, count(*) AS cluster_size, '【自动生成】' || substring(arg_min(text, row_id), 1, 50) || '...' AS name
            FROM mem GROUP BY cluster_id""",
        "cluster_top_factor": _factor_sql() + """,
            mem AS (SELECT e.label::BIGINT AS cluster_id, g.row_id, array_to_string(g.factors, '，') AS t
                    FROM embeddings e JOIN g ON g.row_id = e.vec_id),
            occ AS (SELECT cluster_id, row_id, unnest(string_split(t, '，')) AS f,
                           generate_subscripts(string_split(t, '，'), 1) - 1 AS pos FROM mem),
            cnt AS (SELECT cluster_id, trim(f) AS f, count(*) AS n, min({'r': row_id, 'p': pos}) AS fs FROM occ
                    WHERE trim(f) <> '' GROUP BY ALL),
            best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, fs.r, fs.p) AS rk FROM cnt) WHERE rk = 1),
            heads AS (SELECT cluster_id, count(*) AS cluster_size, arg_min(t, row_id) AS first_text FROM mem GROUP BY cluster_id)
            SELECT h.cluster_id, h.cluster_size, b.f AS top_factor, b.n AS top_n,
                   coalesce(b.f, '【自动生成】' || substring(h.first_text, 1, 50) || '...') AS name
            FROM heads h LEFT JOIN best b USING (cluster_id)""",
        "document_samples": f"""
            WITH {document_clusters_sql()},
            r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) AS pos FROM mem)
            SELECT cluster_id, pos, row_id,
                   CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
            FROM r WHERE pos <= 5""",
        "document_fallback_name": f"""
            WITH {document_clusters_sql()}
            SELECT cluster_id, count(*) AS cluster_size, '【自动生成】' || substring(arg_min(text, row_id), 1, 50) || '...' AS name
            FROM mem GROUP BY cluster_id""",
        "document_top_factor": _factor_sql() + f""",
            {document_clusters_sql()},
            j AS (SELECT cluster_id, row_id, array_to_string(g.factors, '，') AS t FROM mem JOIN g USING (row_id)),
            occ AS (SELECT cluster_id, row_id, unnest(string_split(t, '，')) AS f,
                           generate_subscripts(string_split(t, '，'), 1) - 1 AS pos FROM j),
            cnt AS (SELECT cluster_id, trim(f) AS f, count(*) AS n, min({{'r': row_id, 'p': pos}}) AS fs FROM occ
                    WHERE trim(f) <> '' GROUP BY ALL),
            best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, fs.r, fs.p) AS rk FROM cnt) WHERE rk = 1),
            heads AS (SELECT cluster_id, count(*) AS cluster_size, arg_min(t, row_id) AS first_text FROM j GROUP BY cluster_id)
            SELECT h.cluster_id, h.cluster_size, b.f AS top_factor, b.n AS top_n,
                   coalesce(b.f, '【自动生成】' || substring(h.first_text, 1, 50) || '...') AS name
            FROM heads h LEFT JOIN best b USING (cluster_id)""",
        "theme_cooccurrence": _factor_sql() + """,
            e AS (SELECT DISTINCT row_id, unnest(list_distinct(factors)) AS f FROM g WHERE factors[1] NOT IN ('无法提取', 'API错误'))
            SELECT x.f AS a, y.f AS b, count(*) AS weight FROM e x JOIN e y ON x.row_id = y.row_id AND x.f < y.f GROUP BY ALL""",
        "theme_ranking": _theme_sql() + """
            SELECT row_number() OVER (ORDER BY frequency DESC, theme) AS rank, theme, frequency, m.sentiment
            FROM tt JOIN maj m USING (theme) """,
        "theme_priority": _theme_sql() + """,
            pr AS (SELECT *, n_negative / frequency AS negative_share, (n_negative / frequency) * frequency AS priority FROM tt)
            SELECT row_number() OVER (ORDER BY priority DESC, frequency DESC, theme) AS rank, theme, frequency, n_negative,
                   round(negative_share, 6) AS negative_share, round(priority, 6) AS priority
            FROM pr """,
    }


def registry_more() -> dict:
    return {
        "cosine_pairs": q_cosine_pairs,
        "silhouette_by_label": q_silhouette_by_label,
        "cluster_sizes": q_cluster_sizes,
        "cluster_members": q_cluster_members,
        "cluster_samples": q_cluster_samples,
        "cluster_fallback_name": q_cluster_fallback_name,
        "cluster_top_factor": q_cluster_top_factor,
        "document_samples": q_document_samples,
        "document_fallback_name": q_document_fallback_name,
        "document_top_factor": q_document_top_factor,
        "ward_clusters": q_ward_clusters,
        "threshold_sweep": q_threshold_sweep,
        "ward_merges": q_ward_merges,
        "pca_2d": q_pca_2d,
        "pca_abs": q_pca_abs,
        "text_vectors": q_text_vectors,
        "theme_cooccurrence": q_theme_cooccurrence,
        "theme_communities": q_theme_communities,
        "theme_ranking": q_theme_ranking,
        "theme_priority": q_theme_priority,
    }


# ============================================================================= sources, sinks, streams

from voxpop.sinks import files as K  # noqa: E402
from voxpop.sources import csv as CSV  # noqa: E402
from voxpop.sources import sectioned as SEC  # noqa: E402
from voxpop.session import materialize, scratch_path  # noqa: E402
from voxpop.streaming import scoring as ST  # noqa: E402

TEXT_SUFFIX = "（正文）"


def _texts_cn(spark, sf_dir):
    return TB.load(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(TEXT_SUFFIX)).alias("text"), "lang")


def q_csv_encodings(spark, sf_dir):
    """The whole table in files of two encodings, those in UTF-8 with a BOM."""
    docs = _texts_cn(spark, sf_dir)
    base = scratch_path(spark, "csv-encodings")
    CSV.allow_charset(spark, "GB18030")
    K.write_csv(docs.where("doc_id % 2 = 0"), f"{base}/gb", encoding="GB18030")
    K.write_csv(docs.where("doc_id % 2 <> 0").withColumnRenamed("doc_id", "\ufeffdoc_id"), f"{base}/bom")
    back = CSV.read_csv_tolerant(spark, [f"{base}/gb", f"{base}/bom"], required="text")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


def q_mojibake_repair(spark, sf_dir):
    """S3: GB18030 files read as latin1, then repaired."""
    path = scratch_path(spark, "mojibake")
    CSV.allow_charset(spark, "GB18030")
    K.write_csv(_texts_cn(spark, sf_dir).withColumnRenamed("text", "正文"), path, encoding="GB18030")
    garbled = CSV.read_csv_tolerant(spark, path, candidates=["latin1"])
    fixed = CSV.repair_mojibake(garbled)
    return fixed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("正文").alias("text"), "lang")


def q_sectioned_text_roundtrip(spark, sf_dir):
    n = TB.load(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("cluster_id"),
                                                 F.col("n_nationkey").cast("long").alias("row_id"),
                                                 F.col("n_name").alias("text"))
    path = K.write_listing(K.listing_lines(n, "cluster_id", "row_id", "text"))
    return SEC.read_sectioned(spark, path)


def _files(df):
    """How many files to write ``df`` to: one for each split of its input, which Spark bounds, and four at least."""
    return max(4, df.rdd.getNumPartitions())


def q_stream_equals_batch(spark, sf_dir):
    """Posts written as files in two arrivals; the stream scores them across a restart."""
    posts = TB.posts(spark, sf_dir).select("row_id", "text")
    base = scratch_path(spark, "stream")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    schema = T_POSTS
    n = _files(posts)
    half = posts.agg(F.percentile_approx("row_id", 0.5)).first()[0]
    posts.where(F.col("row_id") <= half).repartition(n).write.mode("overwrite").parquet(f"{src}/a")
    ST.stream_labels(spark, f"{src}/*", schema, out, ck, TB.demo_demand(), max_files_per_trigger=n // 2)
    posts.where(F.col("row_id") > half).repartition(n).write.mode("overwrite").parquet(f"{src}/b")
    ST.stream_labels(spark, f"{src}/*", schema, out, ck, TB.demo_demand(), max_files_per_trigger=n // 2)  # restart
    scored = spark.read.parquet(out)
    d = D.label_distribution(scored, TB.demo_demand(), "demand", order="count")
    return d.withColumn("share", F.round("share", 6))


def q_stream_running_counts(spark, sf_dir):
    """ST2 over the stream's output, run again after a replay of the last batch: the counts per label stay those of the posts."""
    posts = TB.posts(spark, sf_dir).select("row_id", "text")
    base = scratch_path(spark, "stream2")
    posts.repartition(_files(posts)).write.mode("overwrite").parquet(f"{base}/src")
    ST.stream_labels(spark, f"{base}/src", T_POSTS, f"{base}/out", f"{base}/ck1", TB.demo_demand())
    scored_schema = spark.read.parquet(f"{base}/out").schema
    name = "running_" + base.rstrip("/").split("-")[-1]
    ST.stream_distribution(spark, f"{base}/out", scored_schema, "demand", name, f"{base}/ck2")
    last = spark.read.parquet(f"{base}/out").agg(F.max("batch")).first()[0]
    again = materialize(spark.read.parquet(f"{base}/out/batch={last}"), "replay")
    ST.write_batch(f"{base}/out")(again, last)  # the folder is rewritten under new file names
    t = ST.stream_distribution(spark, f"{base}/out", scored_schema, "demand", name, f"{base}/ck2")
    return t.select(F.col("demand").alias("label"), F.col("n").cast("long").alias("n"), F.col("rows").cast("long").alias("rows"))


def q_resumable_scoring(spark, sf_dir):
    """K2: a run that dies in its fifth slice, leftovers of an uncommitted one, a run that ends, a run with nothing to do."""
    posts = TB.posts(spark, sf_dir).select("row_id", "text")
    done = scratch_path(spark, "resume")
    score = lambda df: SC.label_with_rules(df, TB.demo_demand(), "text", "demand").select("row_id", "demand")
    calls = []

    def dies(df):
        calls.append(1)
        if len(calls) == 5:
            score(df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{done}/data/left-behind")
            raise RuntimeError("the run dies")
        return score(df)

    try:
        ST.resume_scoring(posts, done, dies)
    except RuntimeError:
        pass
    ST.resume_scoring(posts, done, score)
    return ST.resume_scoring(posts, done, score)


from pyspark.sql import types as _T  # noqa: E402

T_POSTS = _T.StructType([_T.StructField("row_id", _T.LongType()), _T.StructField("text", _T.StringType())])


def oracle_sources() -> dict[str, str]:
    return {
        "csv_encodings": f"SELECT doc_id, coalesce(text, '') || '{TEXT_SUFFIX}' AS text, lang FROM documents",
        "mojibake_repair": f"SELECT doc_id, coalesce(text, '') || '{TEXT_SUFFIX}' AS text, lang FROM documents",
        "sectioned_text_roundtrip": """
            SELECT n_regionkey::BIGINT AS cluster_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos,
                   n_name AS text FROM nation""",
        "stream_equals_batch": _dist_sql(TB.demo_demand(), G.labelled_case(TB.demo_demand()), "documents"),
        "stream_running_counts": f"""
            WITH lab AS (SELECT {G.labelled_case(TB.demo_demand())} AS label, {G.norm('text')} = '' AS is_blank FROM documents)
            SELECT label, count(*) FILTER (WHERE NOT is_blank) AS n, count(*) AS rows FROM lab GROUP BY label""",
        "resumable_scoring": f"SELECT doc_id AS row_id, {G.labelled_case(TB.demo_demand())} AS demand FROM documents",
    }


def registry_sources() -> dict:
    return {
        "csv_encodings": q_csv_encodings,
        "mojibake_repair": q_mojibake_repair,
        "sectioned_text_roundtrip": q_sectioned_text_roundtrip,
        "stream_equals_batch": q_stream_equals_batch,
        "stream_running_counts": q_stream_running_counts,
        "resumable_scoring": q_resumable_scoring,
    }


# ============================================================================= end-to-end workflows

from voxpop.plans import workflows as WF  # noqa: E402


def _factor_clusters(spark, sf_dir):
    return WF.cluster_and_name(factor_table(spark, sf_dir))


def q_factor_text_clusters(spark, sf_dir):
    """U4 -> V12 on the joined factor strings of every post (duplicates collapsed with weights)."""
    r = _factor_clusters(spark, sf_dir).result
    return r.assignments.select("row_id", "text", "cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"))


def q_factor_cluster_report(spark, sf_dir):
    """U5 + T4 + K5 rows for the factor-text clusters."""
    rep = _factor_clusters(spark, sf_dir).report
    if rep is None:
        return spark.createDataFrame([], "cluster_id long, cluster_size long, name string, samples array<string>")
    return rep.select("cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"), "name", "samples")


def q_bisecting_clusters(spark, sf_dir):
    """The scale-out alternative clustering of the embeddings (BisectingKMeans, silhouette-chosen k)."""
    e = _emb(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "embedding")
    r = CL.cluster_bisecting(e, "row_id", "embedding")
    return r.assignments.select("row_id", "cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"))


def registry_workflows() -> dict:
    return {
        "bisecting_clusters": q_bisecting_clusters,
        "factor_text_clusters": q_factor_text_clusters,
        "factor_cluster_report": q_factor_cluster_report,
    }
