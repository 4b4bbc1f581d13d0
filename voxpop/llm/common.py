"""Helpers shared by the corpus operators: tables, label folds, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxpop.session import drop_scratch, scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back; also its path."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path), path


def settled(df: DataFrame, name: str, *paths: str) -> DataFrame:
    """Write ``df`` like :func:`written`, then delete the scratch tables that it was made from."""
    result, _ = written(df, name)
    drop_scratch(df.sparkSession, *paths)
    return result


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 500) -> Iterator[list[tuple]]:
    """Rows of batches, some at a time: few of a batch's texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            yield list(zip(*(c.to_pylist() for c in batch.slice(i, at_once).columns), strict=True))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def held_out(id_col: str = "doc_id"):
    """True for the fold that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def lowest_hashes(rows: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """Rows whose ``id`` hashes low enough to be among the ``n`` lowest hashes, and some more.

    The bound comes from the number of rows, so a following ``orderBy(hash).limit(n)``
    meets little more than ``n`` rows instead of ``n`` of every partition.
    """
    share = (1.1 * n + 1000) / max(1, rows.count())
    return rows.where(hash_of_id(salt) < -(2**63) + int(share * 2**64)) if share < 1 else rows


def hash_of_id(salt: int = 0):
    return F.xxhash64(F.col("id"), F.lit(salt))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node of an undirected graph.

    ``edges(a long, b long)`` -> ``(node, component)`` for every node that an
    edge names. Alternates the large-star and small-star steps of Kiveris et
    al. (2014): edges never outgrow the input, rounds are logarithmic, and each
    round is one written table, so lineage stays one round long and a lost
    executor repeats at most one round. Loops (a = b) and nulls are left out;
    no edges give an empty table.
    """
    spark = edges.sparkSession
    cur, path = written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc"
    )
    before = None
    while True:
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours move to the smallest one
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: every node's smaller neighbours and the node itself move to the smallest
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low2, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        nxt, npath = written(
            small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc"
        )
        drop_scratch(spark, path)
        cur, path = nxt, npath
    return cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(
        cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
