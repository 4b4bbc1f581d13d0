"""The corpus pipeline: toxic and poor documents go, near-duplicates go, secrets are cut out, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on
all that its predecessor kept, written as Parquet and read again. All but the
last return the columns of ``documents``. Null and empty texts pass the
filters like any text with their score; an empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxpop.llm import minhash, packing, quality, secrets, toxicity
from voxpop.llm.common import held_out, table, written
from voxpop.session import ship_package

#: A document goes when its toxicity reaches the first, or its quality stays below the second.
TOXIC, GOOD = 0.5, 0.3

# SQL cannot express learned models, hashes and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below ``TOXIC``."""
    ship_package(spark)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(), name="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores ``GOOD`` or more."""
    ship_package(spark)
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), ~held_out(), name="_quality")
    return scored.where(F.col("_quality") >= GOOD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that links of similarity 0.8 on five-word shingles connect."""
    ship_package(spark)
    return minhash.keep_one(docs, size=5, percent=80)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding replaced by the mark of its kind; ``n_chars`` follows the text."""
    ship_package(spark)
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    ship_package(spark)
    return packing.pack(docs)[1]


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", cut_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
