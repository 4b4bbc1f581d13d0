"""Test tables standing in for the reference's inputs, and the demo taxonomies over them.

The driver's documents are invented prose in en/fr/de/es, so the demo label
rules and factor dictionary use words found in that prose; the Chinese rules of
``voxpop.schema`` are the defaults for real feedback.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxpop import schema as S

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Demo rules over the test prose (substring tests on the stripped, truncated text).
DEMO_DEMAND_RULES = [
    ("基础层", [" der ", " und "]),
    ("保障层", [" les ", " des "]),
    ("舒适层", [" el ", " que "]),
    ("尊重层", [" that "]),
    ("共鸣层", [" with "]),
]
DEMO_SENTIMENT_RULES = [
    ("正面", [" this "]),
    ("负面", [" of "]),
    ("正面", [" the "]),
]
DEMO_QUALITY_RULES = [("high", ["tion"])]
DEMO_FACTOR_CUES = [
    ("rewh", "rewh"), ("orre", "orre"), ("hehely", "hehely"), ("thatin", "thatin"), ("inoran", "inoran"),
    ("thing", "thing"), ("ering", "thing"), ("orantion", "orant"), ("ononst", "onon"), ("ciónc", "ción"),
    ("cióna", "ción"), ("mente", "mente"), ("thble", "thble"),
]


def demo_demand() -> S.Taxonomy:
    return S.Taxonomy.from_cues(DEMO_DEMAND_RULES, S.DEMAND_DEFAULT, "demand", S.DEMAND_LABELS)


def demo_sentiment() -> S.Taxonomy:
    t = S.Taxonomy.from_cues(DEMO_SENTIMENT_RULES, S.SENTIMENT_DEFAULT, "sentiment")
    return replace(t, extra={"order": S.SENTIMENT_LABELS})


def demo_quality() -> S.Taxonomy:
    return S.Taxonomy.from_cues(DEMO_QUALITY_RULES, "low", "quality", ["high", "low"])


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: ``row_id`` is the document key, ``text`` the post body."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang", "source")


def posts_with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and for each row of ``labels`` one more post without content: null for toxic
    ones, blank (ideographic and ASCII spaces) for good ones, empty for the rest."""
    blank = load(spark, sf_dir, "labels").select(
        (-1 - F.col("doc_id")).alias("row_id"),
        F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("quality") == 1, F.lit("\u3000 \t")).otherwise(F.lit("")).alias("text"))
    return posts(spark, sf_dir).select("row_id", "text").unionByName(blank)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a second post table (key ``conv_id, turn``)."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def quality_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand labels standing in for the truth table: ``(row_id, truth)``."""
    return load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("quality") == 1, "high").otherwise("low").alias("truth"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("toxic_label"))
