"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from voxpop.llm import chat, collocations, divergence, exact, fingerprints, minhash, packing, quality, secrets, surrogates, toxicity, transducer, vectors
from voxpop.llm.common import held_out, table


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.findings(docs).withColumnRenamed("doc_id", "_id")
    every = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    every = every.withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return every.select(
        "doc_id", *[count(r.kind) for r in secrets.BASE_RULES], F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])
                             WHEN len(ws) = 1 THEN ws ELSE [] END) AS g
  FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY 1),
r AS (SELECT k, min(doc_id) AS rep FROM k GROUP BY 1),
u AS (SELECT s.* FROM s WHERE doc_id IN (SELECT rep FROM r)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(node, comp) AS (SELECT rep, rep FROM r UNION SELECT e.b, c.comp FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(comp) AS comp FROM c GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.comp, n.doc_id) AS component_id,
       n.doc_id = coalesce(m.comp, n.doc_id) AS kept
FROM n LEFT JOIN k USING (doc_id) LEFT JOIN r ON r.k = k.k LEFT JOIN m ON m.node = r.rep
"""


def _scored(docs: DataFrame, threshold: float) -> DataFrame:
    return docs.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(quality.score_quality(docs.select("doc_id", "text"), labels, ~held_out()), 0.3)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))[1]


def op5_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = transducer.decode(transducer.encode(table(spark, sf_dir, "documents")))
    return spelled.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("decoded_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(toxicity.score_toxicity(docs.select("doc_id", "text"), labels, ~held_out()), 0.5)


def op8_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
c(node, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, c.comp FROM c JOIN p ON p.a = c.node),
m AS (SELECT node, min(comp) AS comp FROM c GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.comp AS component_id, vec_id = m.comp AS kept
FROM embeddings JOIN m ON m.node = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op10_chat_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(extra).alias("x"), F.lit(said).alias("text"))
    extra = extra.select("conv_id", F.col("x.turn").cast(rows.schema["turn"].dataType).alias("turn"), "x.role", "text")
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(
    replace(text, '\', '\\'),
    '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\])', chr(1) || '\1', 'g') AS marked,
    row_number() OVER w - 1 AS place,
    CASE lag(role, 1, 'start') OVER w @STEPS@ ELSE false END AS follows
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(marked) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END)::BIGINT AS formatted_chars,
  coalesce(min(place) FILTER (NOT follows),
    CASE WHEN arg_max(role, place) IN (@ENDS@) THEN -1 ELSE count(*) END)::INTEGER AS first_error
FROM e GROUP BY conv_id
"""
_MACHINE = chat.Template()
_STEPS = " ".join(f"WHEN '{a}' THEN role IN ({', '.join(map(repr, b))})" for a, b in _MACHINE.steps.items())
OP10_SQL = OP10_SQL.replace("@STEPS@", _STEPS).replace("@ENDS@", ", ".join(map(repr, _MACHINE.ends)))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY 1),
gn AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
      FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang JOIN gn ON gn.lang = g.lang AND gn.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
w AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, unnest(flatten([[ws[i : i + k - 1] FOR i IN range(1, len(ws) - k + 2)] FOR k IN range(1, 5)])) AS p FROM w),
f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
cuts AS (SELECT c.lang, c.p, c.f AS a, x.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
         FROM (SELECT * FROM f WHERE len(p) > 1) c, unnest(range(1, len(c.p))) x(k)
         JOIN f l ON l.lang = c.lang AND l.p = c.p[1 : x.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[x.k + 1 : len(c.p)]),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_p AS (SELECT lang, unnest(flatten([[p[i : i + m - 1] FOR i IN range(1, len(p) - m + 2)] FOR m IN range(2, len(p))])) AS p, f FROM f WHERE len(p) > 2),
most AS (SELECT lang, p, max(f) AS m FROM inner_p GROUP BY 1, 2),
o AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, n, score
      FROM s JOIN n ON n.lang = s.lang LEFT JOIN most ON most.lang = s.lang AND most.p = s.p WHERE m IS NULL OR 100 * m < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY rank <= 2000
"""


def op13_patricia_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_ledger": op1_secret_ledger,
        "op2_minhash_neardup": op2_minhash_neardup,
        "op3_quality_pu": op3_quality_pu,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_sentencepiece_wfst": op5_sentencepiece_wfst,
        "op6_syncmer_fingerprints": op6_syncmer_fingerprints,
        "op7_toxicity_fm": op7_toxicity_fm,
        "op8_subspace_join": op8_subspace_join,
        "op9_surrogates": op9_surrogates,
        "op10_chat_fsm": op10_chat_fsm,
        "op11_divergence_audit": op11_divergence_audit,
        "op12_collocations": op12_collocations,
        "op13_patricia_exact": op13_patricia_exact,
    }


def oracle() -> dict[str, str]:
    return {
        "op2_minhash_neardup": OP2_SQL,
        "op8_subspace_join": OP8_SQL,
        "op10_chat_fsm": OP10_SQL,
        "op11_divergence_audit": OP11_SQL,
        "op12_collocations": OP12_SQL,
        "op13_patricia_exact": OP13_SQL,
    }
