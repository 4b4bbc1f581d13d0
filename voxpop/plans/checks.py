"""Registered queries on inputs that plain tables lack, and their DuckDB SQL.

Blank and null posts (derived from ``labels`` on both sides), null truths,
one-row clusters, files in several encodings and column orders, listings in
many files, and a scorer that answers in chat JSON and sometimes fails.
"""

from __future__ import annotations

import json
import re
import time

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import reply as R
from voxpop.functions import text as X
from voxpop.operators import distribution as D
from voxpop.operators import evaluation as E
from voxpop.operators import factors as FA
from voxpop.operators import naming as NM
from voxpop.operators import scoring as SC
from voxpop.operators import vectors as V
from voxpop.plans import sqlgen as G
from voxpop.plans import tables as TB
from voxpop.session import scratch_path
from voxpop.sinks import files as K
from voxpop.sources import csv as CSV
from voxpop.sources import sectioned as SEC

BLANKS_SQL = """
    posts AS (
      SELECT doc_id AS row_id, text FROM documents
      UNION ALL SELECT -1 - doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN chr(12288) || ' ' || chr(9) ELSE '' END FROM labels)"""


# ----------------------------------------------------------------------------- blank and null posts


def q_blank_normalize(spark, sf_dir):
    p = TB.posts_with_blanks(spark, sf_dir)
    norm = X.normalized("text")
    return p.select("row_id", F.length(norm).cast("long").alias("n_chars_stripped"), X.is_blank("text").alias("is_blank"),
                    X.preview("text").alias("preview"), X.truncate(norm).alias("scored"))


def q_blank_distribution(spark, sf_dir):
    """Blank posts are not counted but stay in the denominator; the order as a rank."""
    t = TB.demo_demand()
    lab = SC.label_with_rules(TB.posts_with_blanks(spark, sf_dir), t, "text", "demand")
    d = D.label_distribution(lab, t, "demand", order="count")
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("ordinal")))  # one row per category
    return d.select(rank.cast("long").alias("rank"), "label", "n", "n_total", F.round("share", 6).alias("share"), "share_pct")


def _blank_factors(spark, sf_dir):
    p = TB.posts_with_blanks(spark, sf_dir)
    p = SC.label_with_rules(p, TB.demo_demand(), "text", "demand").drop("is_blank")
    p = SC.label_with_rules(p, TB.demo_sentiment(), "text", "sentiment")
    return SC.extract_factors(p, "text", TB.DEMO_FACTOR_CUES)


def q_blank_factor_rows(spark, sf_dir):
    """Posts without text are error rows."""
    return FA.factor_rows(_blank_factors(spark, sf_dir))


def q_row_counts(spark, sf_dir):
    """Rows, rows with factors, rows with real factors."""
    return D.row_counts(_blank_factors(spark, sf_dir))


def _blank_factor_sql() -> str:
    pattern = S.literal_alternation([c for c, _ in TB.DEMO_FACTOR_CUES])
    return f"""
    WITH {BLANKS_SQL},
    base AS (SELECT row_id, text, {G.labelled_case(TB.demo_demand())} AS demand, {G.labelled_case(TB.demo_sentiment())} AS sentiment FROM posts),
    m AS (SELECT *, list_transform(regexp_extract_all(coalesce(text, ''), {G.q(pattern)}), lambda x: {G.map_case('x', TB.DEMO_FACTOR_CUES)}) AS names FROM base),
    d AS (SELECT *, list_filter(names, lambda x, i: NOT list_contains(names[1:i-1], x)) AS uniq FROM m),
    f AS (SELECT *, list_filter(uniq, lambda x: length(x) BETWEEN 2 AND 5) AS kept FROM d),
    g AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE ['无法提取'] END AS factors FROM f)"""


# ----------------------------------------------------------------------------- metrics with null truths


def q_sentiment_metrics(spark, sf_dir):
    """A4-A7 in the sentiment form: three fixed labels, unrounded; rows without truth count as wrong."""
    pred = SC.label_with_rules(TB.posts(spark, sf_dir), TB.demo_sentiment(), "text", "pred")
    truth = TB.load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("toxic") == 1, "负面").when(F.col("quality") == 1, "正面").alias("truth"))
    r = E.evaluation_report(E.align(pred, truth, "row_id", "pred", "truth"), S.SENTIMENT_LABELS, None)
    return r.select("label", "is_total", "support", *[F.round(c, 12).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def q_silhouette_singletons(spark, sf_dir):
    """V8 where some clusters have one row, which scores 0."""
    e = TB.load(spark, sf_dir, "embeddings")
    e = e.withColumn("c", F.when(F.col("vec_id") < 5, F.col("vec_id") + 100).otherwise(F.col("label")))
    return V.silhouettes(e, "embedding", "c").select(F.round("silhouette", 6).alias("silhouette"))


# ----------------------------------------------------------------------------- a scorer that answers in JSON and fails


def _answer(choose):
    def score(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            n = ord(p[-1]) + len(p)
            if n % 11 == 0:
                raise RuntimeError("no reply")
            out.append(json.dumps({"choices": [{"message": {"content": choose(p, n)}}]}, ensure_ascii=False))
        return pd.Series(out)

    return score


def q_scored_demand(spark, sf_dir):
    """U1 by a scorer: exact labels, the default for others, failures per row."""
    names = [*S.DEMAND_LABELS, "基础层。"]
    scorer = _answer(lambda p, n: f" {names[n % 7]}\n")
    return SC.label_with_scorer(TB.posts_with_blanks(spark, sf_dir), scorer, S.demand_taxonomy(), "text", "demand", call_rows=16).select(
        "row_id", "demand", "is_blank", "score_error")


#: A scorer that never answers on texts of this length or more.
NO_ANSWER = 25_000


def q_scored_with_time_limit(spark, sf_dir):
    """A scorer that hangs on some posts; those get the default label and an error, their neighbours in the call their label."""
    names = S.DEMAND_LABELS

    def scorer(prompts: pd.Series) -> pd.Series:
        if prompts.str.len().max() >= NO_ANSWER:
            time.sleep(3600)
        return prompts.map(lambda p: names[len(p) % len(names)])

    posts = TB.posts(spark, sf_dir).select("row_id", "text")
    got = SC.label_with_scorer(posts, scorer, S.demand_taxonomy(), "text", "demand", limit=None, call_rows=32,
                               patience=SC.Patience(limit=0.5, retries=1, pause=0.05, at_once=8, rows_at_once=64))
    return got.select("row_id", "demand", "is_blank", "score_error")


def q_scored_sentiment(spark, sf_dir):
    """U2 by a scorer: containment in the order of the categories."""
    names = ["答：正面", "负面！", "不是正面，是负面", "说不清"]
    scorer = _answer(lambda p, n: names[n % 4])
    s = SC.label_with_scorer(TB.posts_with_blanks(spark, sf_dir), scorer, S.sentiment_taxonomy(), "text", "sentiment", match="contains")
    return s.select("row_id", "sentiment", R.sentiment_code("sentiment", 0).alias("sentiment_code"), "score_error")


def q_scored_factors(spark, sf_dir):
    """U3 by a scorer that gets text, demand and sentiment."""
    p = TB.posts_with_blanks(spark, sf_dir)
    p = SC.label_with_rules(p, TB.demo_demand(), "text", "demand").drop("is_blank")
    p = SC.label_with_rules(p, TB.demo_sentiment(), "text", "sentiment")

    def choose(prompt, n):
        demand, sentiment, _ = prompt.split("|", 2)
        return f"{sentiment}{'x' * (n % 6)}， {demand} ,,无"

    got = SC.extract_factors(p, "text", scorer=_answer(choose), template="{demand}|{sentiment}|{text}.",
                             slots={"demand": "demand", "sentiment": "sentiment"})
    return got.select("row_id", X.join_factors("factors").alias("factors_text"), F.col("n_factors").cast("long").alias("n_factors"), "score_error")


def q_scored_names(spark, sf_dir):
    """U5 by a namer that sees all distinct texts of its cluster."""
    mem = TB.load(spark, sf_dir, "labels").select(
        (F.col("quality") * 2 + F.col("toxic")).cast("long").alias("cluster_id"), F.col("doc_id").alias("row_id"))
    mem = mem.join(TB.posts(spark, sf_dir).select("row_id", F.concat_ws("/", "lang", "source").alias("text")), "row_id")

    def namer(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            n = p.count("\n") + 1
            if n % 2 == 0:
                raise RuntimeError("no reply")
            out.append(f'" {n} lines\n\'')
        return pd.Series(out)

    return NM.name_with_scorer(mem, namer).select("cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"), "name", "score_error")


def q_scored_text_names(spark, sf_dir):
    """U5 over the texts of all documents; the name counts the rows that the namer was told of, round by round."""
    from voxpop.plans.queries import document_clusters

    mem = document_clusters(spark, sf_dir).join(
        TB.posts(spark, sf_dir).select("row_id", X.normalized("text").alias("text")), "row_id")

    def namer(prompts: pd.Series) -> pd.Series:
        return pd.Series([f"{sum(map(int, re.findall(r' [(]x([0-9]+)[)](?:\n|$)', p)))} rows" for p in prompts])

    return NM.name_with_scorer(mem, namer).select("cluster_id", F.col("cluster_size").cast("long").alias("cluster_size"), "name", "score_error")


def _scored_sql(prompt: str) -> str:
    return f"SELECT *, {prompt} AS p, unicode(right({prompt}, 1)) + length({prompt}) AS n"


# ----------------------------------------------------------------------------- files


def q_csv_mixed_headers(spark, sf_dir):
    """One folder per column order and encoding; columns are matched by name."""
    docs = TB.load(spark, sf_dir, "documents")
    base = scratch_path(spark, "csv-mixed")
    CSV.allow_charset(spark, "GB18030")
    K.write_csv(docs.where("doc_id % 2 = 0").select("doc_id", "text", "lang", "source"), f"{base}/a")
    K.write_csv(docs.where("doc_id % 2 <> 0").select("source", "text", "doc_id"), f"{base}/b", encoding="GB18030")
    back = CSV.read_csv_tolerant(spark, [f"{base}/a", f"{base}/b"], required="text")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


def q_csv_late_encoding(spark, sf_dir):
    """Rows that only GB18030 decodes come last in each file, beyond any head of it."""
    docs = TB.load(spark, sf_dir, "documents")
    path = scratch_path(spark, "csv-late")
    CSV.allow_charset(spark, "GB18030")
    late = docs.select("doc_id", "text").sortWithinPartitions(~F.col("text").rlike("^[\\x00-\\x7F]*$"), "doc_id")
    late = late.withColumn("text", F.when(F.col("text").rlike("[^\\x00-\\x7F]"), F.concat(F.lit("（）"), "text")).otherwise(F.col("text")))
    K.write_csv(late, path, encoding="GB18030")
    back = CSV.read_csv_tolerant(spark, path, required="text")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def q_csv_split_records(spark, sf_dir):
    """Texts that begin and end in quoted line breaks, their files cut into splits inside cells."""
    docs = TB.load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"\n,"\n'), F.coalesce("text", F.lit("")), F.lit('\n""')).alias("text"))
    path = K.write_csv(docs, scratch_path(spark, "csv-split"))
    back = CSV.read_csv_tolerant(spark, path, required="text", split_bytes=1 << 20)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def q_sectioned_multi_file(spark, sf_dir):
    """A listing of all documents over many files, sections running across them."""
    docs = TB.posts(spark, sf_dir).select(
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).otherwise(3).cast("long").alias("cluster_id"), "row_id",
        F.trim(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", " ")).alias("text"))
    path = K.write_listing(K.listing_lines(docs), files=9)
    return SEC.read_sectioned(spark, path)


def q_stats_object(spark, sf_dir):
    """K3: the one JSON object with group, total and ordered factors, read back."""
    from voxpop.plans.queries import factor_table

    stats = FA.stats_json(FA.top_factors(FA.factor_counts(factor_table(spark, sf_dir)), 10))
    path = K.write_stats_object(stats)
    kind = "map<string,struct<`总记录数`:bigint,`高频因素`:map<string,bigint>>>"
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("group_key", "v"))
    return one.select("group_key", F.col("v.`总记录数`").alias("total"), F.posexplode("v.`高频因素`").alias("pos", "factor", "n")).select(
        "group_key", "total", (F.col("pos") + 1).cast("long").alias("rank"), "factor", "n")


def q_cluster_report_lines(spark, sf_dir):
    """K5: the report written and read back, by line."""
    mem = TB.load(spark, sf_dir, "labels").select(
        (F.col("quality") * 2 + F.col("toxic")).cast("long").alias("cluster_id"), F.col("doc_id").alias("row_id"))
    mem = mem.join(TB.posts(spark, sf_dir).select("row_id", F.concat_ws("，", "lang", "source").alias("text")), "row_id")
    path = K.write_cluster_report(NM.cluster_report(mem))
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def q_cluster_theme_priority(spark, sf_dir):
    """G3, G4 with clusters as themes: here the four (quality, toxic) groups of ``labels``."""
    from voxpop.operators import network as NW

    p = SC.label_with_rules(TB.posts(spark, sf_dir), TB.demo_sentiment(), "text", "sentiment")
    themes = TB.load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), F.concat(F.lit("c"), F.col("quality") * 2 + F.col("toxic")).alias("theme"))
    ranking = NW.theme_ranking(p, themes=themes).select("theme", F.col("rank").alias("frequency_rank"), "sentiment")
    return NW.theme_priority(p, themes=themes).join(ranking, "theme")


def registry() -> dict:
    return {k[2:]: f for k, f in globals().items() if k.startswith("q_")}


def oracle() -> dict[str, str]:
    from voxpop.plans.queries import oracle as base

    factor_stats_sql = lambda: base()["factor_stats_json"]
    n = G.norm("text")
    demand = ", ".join(G.q(x) for x in [*S.DEMAND_LABELS, "其他"])
    rule = "repeat('=', 60)"
    return {
        "blank_normalize": f"""
            WITH {BLANKS_SQL}
            SELECT row_id, CAST(length({n}) AS BIGINT) AS n_chars_stripped, {n} = '' AS is_blank,
                   CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview,
                   substring({n}, 1, 500) AS scored
            FROM posts""",
        "blank_distribution": f"""
            WITH {BLANKS_SQL},
            lab AS (SELECT {G.labelled_case(TB.demo_demand())} AS label, {n} = '' AS is_blank FROM posts),
            c AS (SELECT label, count(*) FILTER (WHERE NOT is_blank) AS n FROM lab GROUP BY label),
            tot AS (SELECT count(*) AS n_total FROM lab),
            dim AS {G.values_dim(TB.demo_demand())}
            SELECT row_number() OVER (ORDER BY coalesce(c.n, 0) DESC, ordinal) AS rank, dim.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
                   tot.n_total, round(coalesce(c.n, 0) / tot.n_total, 6) AS share, printf('%.2f%%', coalesce(c.n, 0) / tot.n_total * 100.0) AS share_pct
            FROM dim LEFT JOIN c ON c.label = dim.label CROSS JOIN tot""",
        "blank_factor_rows": _blank_factor_sql() + """
            SELECT row_id, row_id + 1 AS ordinal,
                   CASE WHEN text IS NOT NULL THEN demand END AS demand, CASE WHEN text IS NOT NULL THEN sentiment END AS sentiment,
                   CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview,
                   CASE WHEN text IS NOT NULL THEN array_to_string(factors, '，') END AS factors_text,
                   CASE WHEN text IS NOT NULL THEN CAST(len(factors) AS BIGINT) END AS n_factors,
                   CASE WHEN text IS NULL THEN 'text is null' END AS error
            FROM g""",
        "row_counts": _blank_factor_sql() + """
            SELECT count(*) AS n_rows, count(*) FILTER (WHERE len(factors) > 0) AS n_with_factors,
                   count(*) FILTER (WHERE factors[1] NOT IN ('无法提取', 'API错误')) AS n_extracted FROM g""",
        "sentiment_metrics": f"""
            WITH p AS (SELECT CASE WHEN toxic = 1 THEN '负面' WHEN quality = 1 THEN '正面' END AS truth, {G.labelled_case(TB.demo_sentiment())} AS pred
                       FROM labels JOIN documents USING (doc_id)),
            labs AS (SELECT unnest(['正面', '中性', '负面']) AS label),
            s AS (SELECT label, count(*) FILTER (WHERE truth = label AND pred = label) AS tp,
                         count(*) FILTER (WHERE truth IS DISTINCT FROM label AND pred = label) AS fp,
                         count(*) FILTER (WHERE truth = label AND pred <> label) AS fn
                  FROM labs LEFT JOIN p ON truth = label OR pred = label GROUP BY label),
            m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM s)
            SELECT label, false AS is_total, tp + fn AS support, round(pr, 12) AS precision, round(rc, 12) AS recall,
                   round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 12) AS f1, CAST(NULL AS DOUBLE) AS accuracy FROM m
            UNION ALL
            SELECT '总体', true, count(*), NULL, NULL, NULL, round(count(*) FILTER (WHERE truth = pred) / count(*), 12) FROM p""",
        "silhouette_singletons": """
            WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id < 5 THEN vec_id + 100 ELSE label END AS c FROM embeddings),
            p AS (SELECT a.vec_id AS i, b.c AS cj, greatest(0.0, 1 - list_cosine_similarity(a.e, b.e)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
            m AS (SELECT i, cj, avg(d) AS md FROM p GROUP BY ALL),
            s AS (SELECT v.vec_id, max(CASE WHEN cj = v.c THEN md END) AS a, min(CASE WHEN cj <> v.c THEN md END) AS b
                  FROM v JOIN m ON m.i = v.vec_id GROUP BY v.vec_id)
            SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
        "scored_demand": f"""
            WITH {BLANKS_SQL},
            s AS ({_scored_sql(f"substring({n}, 1, 500)")} FROM posts)
            SELECT row_id, CASE WHEN p = '' OR n % 11 = 0 THEN '其他' ELSE [{demand}][n % 7 + 1] END AS demand, p = '' AS is_blank,
                   CASE WHEN p <> '' AND n % 11 = 0 THEN 'RuntimeError: no reply' END AS score_error
            FROM s""",
        "scored_sentiment": f"""
            WITH {BLANKS_SQL},
            s AS ({_scored_sql(f"substring({n}, 1, 500)")} FROM posts),
            t AS (SELECT *, CASE WHEN p = '' OR n % 11 = 0 THEN '中性' ELSE ['正面', '负面', '正面', '中性'][n % 4 + 1] END AS sentiment FROM s)
            SELECT row_id, sentiment, CAST(CASE sentiment WHEN '正面' THEN 1 WHEN '负面' THEN -1 ELSE 0 END AS INTEGER) AS sentiment_code,
                   CASE WHEN p <> '' AND n % 11 = 0 THEN 'RuntimeError: no reply' END AS score_error
            FROM t""",
        "scored_factors": f"""
            WITH {BLANKS_SQL},
            b AS (SELECT row_id, text, {G.labelled_case(TB.demo_demand())} AS demand, {G.labelled_case(TB.demo_sentiment())} AS sentiment FROM posts),
            s AS ({_scored_sql("demand || '|' || sentiment || '|' || text || '.'")} FROM b),
            f AS (SELECT *, CASE WHEN text IS NULL THEN ['无法提取'] WHEN n % 11 = 0 THEN ['API错误']
                    ELSE list_filter([sentiment || repeat('x', (n % 6)::INTEGER), demand], lambda x: length(x) BETWEEN 2 AND 5) END AS factors FROM s)
            SELECT row_id, array_to_string(factors, '，') AS factors_text, CAST(len(factors) AS BIGINT) AS n_factors,
                   CASE WHEN text IS NOT NULL AND n % 11 = 0 THEN 'RuntimeError: no reply' END AS score_error
            FROM f""",
        "cluster_theme_priority": f"""
            WITH p AS (SELECT 'c' || (quality * 2 + toxic) AS theme, {G.labelled_case(TB.demo_sentiment())} AS sentiment FROM labels JOIN documents USING (doc_id)),
            per AS (SELECT theme, sentiment, count(*) AS n, CASE sentiment WHEN '正面' THEN 1 WHEN '负面' THEN -1 ELSE 0 END AS code FROM p GROUP BY ALL),
            maj AS (SELECT theme, sentiment FROM per QUALIFY row_number() OVER (PARTITION BY theme ORDER BY n DESC, code DESC) = 1),
            t AS (SELECT theme, sum(n)::BIGINT AS frequency, sum(CASE WHEN sentiment = '负面' THEN n ELSE 0 END)::BIGINT AS n_negative FROM per GROUP BY theme)
            SELECT theme, frequency, n_negative, round(n_negative / frequency, 6) AS negative_share, round(n_negative / frequency * frequency, 6) AS priority,
                   row_number() OVER (ORDER BY n_negative / frequency * frequency DESC, frequency DESC, theme) AS rank,
                   row_number() OVER (ORDER BY frequency DESC, theme) AS frequency_rank, maj.sentiment
            FROM t JOIN maj USING (theme)""",
        "scored_names": """
            WITH m AS (SELECT quality * 2 + toxic AS cluster_id, doc_id, lang || '/' || source AS t FROM labels JOIN documents USING (doc_id)),
            c AS (SELECT cluster_id, count(*) AS cluster_size, count(DISTINCT t) AS k, arg_min(t, doc_id) AS first FROM m GROUP BY 1)
            SELECT CAST(cluster_id AS BIGINT) AS cluster_id, cluster_size,
                   CASE WHEN k % 2 = 0 THEN '【自动生成】' || substring(first, 1, 50) || '...' ELSE k || ' lines' END AS name,
                   CASE WHEN k % 2 = 0 THEN 'RuntimeError: no reply' END AS score_error
            FROM c""",
        "scored_text_names": """
            SELECT coalesce(l.quality * 2 + l.toxic, 4)::BIGINT AS cluster_id, count(*) AS cluster_size,
                   count(*) || ' rows' AS name, NULL::VARCHAR AS score_error
            FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
        "scored_with_time_limit": f"""
            WITH p AS (SELECT doc_id AS row_id, {G.norm('text')} AS t FROM documents)
            SELECT row_id, t = '' AS is_blank,
                   CASE WHEN t = '' OR length(t) >= {NO_ANSWER} THEN '{S.demand_taxonomy().default}'
                        ELSE [{', '.join(repr(x) for x in S.DEMAND_LABELS)}][length(t) % {len(S.DEMAND_LABELS)} + 1] END AS demand,
                   CASE WHEN length(t) >= {NO_ANSWER} THEN 'TimeoutError: no reply within 0.5 s' END AS score_error
            FROM p""",
        "stats_object": factor_stats_sql(),
        "csv_mixed_headers": "SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, source FROM documents",
        "csv_split_records": "SELECT doc_id, chr(34) || chr(10) || ',' || chr(34) || chr(10) || coalesce(text, '') || chr(10) || chr(34) || chr(34) AS text FROM documents",
        "csv_late_encoding": "SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN '（）' || text ELSE text END AS text FROM documents",
        "sectioned_multi_file": """
            WITH d AS (SELECT CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END::BIGINT AS cluster_id, doc_id,
                              trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS text FROM documents)
            SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) AS pos, text FROM d""",
        "cluster_report_lines": f"""
            WITH m AS (SELECT quality * 2 + toxic AS c, doc_id, lang || '，' || source AS t FROM labels JOIN documents USING (doc_id)),
            o AS (SELECT c, doc_id, unnest(string_split(t, '，')) AS f, generate_subscripts(string_split(t, '，'), 1) AS pos FROM m),
            k AS (SELECT c, f, count(*) AS n, min(doc_id * 10 + pos) AS seen FROM o GROUP BY 1, 2),
            best AS (SELECT c, f FROM k QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, seen) = 1),
            s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS i, t FROM m),
            l AS (
              SELECT {rule} AS line UNION ALL SELECT '{K.REPORT_TITLE}' UNION ALL SELECT {rule} UNION ALL SELECT ''
              UNION ALL SELECT '■ 簇ID: ' || c || ' (共' || count(*) || '条)' FROM m GROUP BY c
              UNION ALL SELECT '标准表述: ' || f FROM best
              UNION ALL SELECT unnest([repeat('-', 50), '代表性原始文本:', '', {rule}, '']) FROM best
              UNION ALL SELECT i || '. ' || t FROM s WHERE i <= 5)
            SELECT line, count(*) AS n FROM l GROUP BY 1""",
    }
