"""Secret scans with an incremental blob ledger (operator 1).

Every version of every path is content-addressed: its blob id is the SHA-256
of its text. The ledger holds the (blob, rule version) pairs that were ever
scanned, with their findings. A run scans only the pairs that the ledger
lacks, each distinct blob once whatever number of paths and versions share it,
appends them, and joins the findings back to all paths.

Addressing and screening are one pass over the texts: next to the hash, one
JVM regular expression says whether a text can hold a finding of any rule at
all. A text that fails the screen has no finding by construction, so its
(empty) entry needs no text; only the few screened texts are shuffled.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop.llm.common import written
from voxpop.session import path_exists, scratch_path, ship_package


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` finds leftmost matches that do not overlap; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    any_case: bool = False
    #: A Java regular expression without which the rule cannot match.
    screen: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds of secrets that every scan reports, in this order.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=12, any_case=True,
        screen=r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, screen=r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]+", least=16, screen=r"[0-9a-f]{16}"),
)
#: Further kinds that the ledger scans for.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", screen=r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", screen=r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", screen="-----BEGIN "),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:int,stop:int>>"
#: Rows of the ledger; given on reading, since a first run that died leaves an empty folder.
LEDGER = f"blob string, rule string, spans {SPANS}"


def find(rule: Rule, text: str | None) -> list[tuple[int, int]]:
    """Spans (code points, end exclusive) of one rule in a whole text."""
    if not text:
        return []
    flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
    return [m.span() for m in re.finditer(rule.pattern, text, flags) if len(m[rule.group]) >= rule.least]


def screened(rules: tuple[Rule, ...], text_col: str = "text"):
    """Whether a text may hold a finding of any of the rules; rules without a screen let every text pass."""
    if not rules:
        return F.lit(False)
    if not all(r.screen for r in rules):
        return F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0
    return F.coalesce(F.col(text_col).rlike("|".join(r.screen for r in rules)), F.lit(False))


def blob_id(text_col: str = "text"):
    """The content address; a null text has the address of the empty text."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans ``versions(path, version, text)`` against ``rules`` -> (path, version, blob, rule, spans).

    ``ledger`` is a folder that all executors see: Parquet rows (blob, rule,
    spans) of every pair ever scanned, appended by each run; a missing one
    starts empty. The result has one row per (path, version) row and rule with
    at least one finding, whether found now or by an earlier run. Null and empty
    texts have no findings; repeated rows repeat their findings; a null path or
    version is a value like others. Other columns are not read. A rule of a new
    version is a new pair, so every blob is scanned for it. A run that dies
    before its append leaves the ledger as it was.
    """
    spark = versions.sparkSession
    ship_package(spark)
    pairs = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.lit(json.dumps(vars(r))).alias("spec")) for r in rules])

    @F.pandas_udf(SPANS)
    def matches(texts: pd.Series, specs: pd.Series) -> pd.Series:
        out = []
        for text, spec in zip(texts, specs, strict=True):
            rule = Rule(**json.loads(spec))
            out.append([{"kind": rule.kind, "start": a, "stop": b} for a, b in find(rule, text)])
        return pd.Series(out)

    may = screened(rules)
    held, _ = written(
        versions.select("path", "version", blob_id().alias("blob"), may.alias("may"), F.when(may, F.col("text")).alias("text")),
        "addressed",
    )
    blobs = held.groupBy("blob").agg(F.first("may").alias("may"))
    wanted = blobs.select("blob", "may", F.explode(pairs).alias("pair")).select("blob", "may", "pair.*")
    if path_exists(spark, ledger):
        wanted = wanted.join(spark.read.schema(LEDGER).parquet(ledger).select("blob", "rule"), ["blob", "rule"], "left_anti")
    texts = held.where("may").select("blob", "text").dropDuplicates(["blob"])
    none = F.array().cast(SPANS)
    scanned = (
        wanted.where("may").join(texts, "blob").select("blob", "rule", matches("text", "spec").alias("spans"))
        .unionByName(wanted.where("not may").select("blob", "rule", none.alias("spans")))
    )
    scanned.write.mode("append").parquet(ledger)
    keys = [r.key for r in rules]
    found = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule").isin(keys) & (F.size("spans") > 0))
    return held.select("path", "version", "blob").join(found, "blob").select("path", "version", "blob", "rule", "spans")


def _ordered(rules: tuple[Rule, ...], spans):
    """Spans in the order of their start, then of the rules."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    )
    return F.array_sort(keyed)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per id with findings: the id, spans (start, rank, stop, kind) in order. Each row of ``docs`` is version 0 of its id.

    Without ``ledger`` a fresh one is made in the shared checkpoint folder.
    Rows that repeat an id and a text give one entry; the findings of several
    texts under one id are joined.
    """
    spark = docs.sparkSession
    versions = docs.select(F.col(id_col).alias("path"), F.lit(0).alias("version"), F.col(text_col).alias("text"))
    rows = scan(versions, ledger or scratch_path(spark, "ledger"), rules).dropDuplicates(["path", "blob", "rule"])
    spans = F.flatten(F.collect_list("spans"))  # of one document: bounded by its text
    return rows.groupBy(F.col("path").alias(id_col)).agg(spans.alias("spans")).withColumn("spans", _ordered(rules, F.col("spans")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """``docs`` with every finding replaced by ``[kind]``; overlapping findings become the mark of the first.

    Texts that fail the screen pass through as they are and are never
    shuffled; null and empty texts stay, as do rows with a null id (their
    texts are redacted as well). Columns and row count stay the same.
    """
    spark = docs.sparkSession
    versions = docs.select(F.col(id_col).alias("path"), F.lit(0).alias("version"), F.col(text_col).alias("text"))
    rows = scan(versions, ledger or scratch_path(spark, "ledger"), rules)
    of_blob = rows.dropDuplicates(["blob", "rule"]).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    of_blob = of_blob.select(F.col("blob").alias("_blob"), _ordered(rules, F.col("_spans")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if text is not None and found is not None and len(found):
                parts, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind']}]"]
                    elif s["stop"] <= at:
                        continue
                    at = max(at, s["stop"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    may = screened(rules, text_col)
    # a row travels as one value: its columns may have any names
    hit = docs.where(may).select(F.struct(*docs.columns).alias("row"), blob_id(text_col).alias("_blob")).join(of_blob, "_blob", "left")
    text = cut(F.col("row")[text_col], F.col("_spans"))
    return docs.where(~may).unionByName(hit.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]))
