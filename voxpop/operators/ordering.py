"""Skew-safe ordered operators inside groups.

A window partitioned only by a group key sends a whole group to one task; with
one cluster or one label holding a third of all rows that task is the job. The
two helpers here split every group first and stay exact:

* ``top_k_within``: top-k per (group, salt) bucket, then top-k over the
  at most ``k * buckets`` survivors per group.
* ``numbered``, ``number_within``: 1-based item number per group (or of all rows)
  in a total order: ranges between sampled splitters are numbered locally, and a
  prefix sum over the (small) per-range counts gives each range its offset.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxpop.session import materialize


def top_k_within(df: DataFrame, group_cols: list[str], order: list[Column], k: int, salt_key: str,
                 buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Exact top-k per group by ``order`` (a total order), ``rank_col`` = 1..k."""
    salt = F.pmod(F.xxhash64(F.col(salt_key)), F.lit(buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
              .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def numbered(df: DataFrame, group_cols: list[str], order: list[Column], out_col: str = "pos") -> DataFrame:
    """1-based position of each row in its group (of all rows, without group columns) by ``order``, a total order.

    Spark cuts the rows at sampled splitters of (group, order), so ranges hold
    about equally many rows whatever the keys look like and however many rows one
    group has. A range is sorted and numbered in its task; the numbers before it
    come from a table of one row per group and range. Nulls are a group.

    The numbered ranges are a table written to the shared checkpoint folder, so
    a lost executor never deals a row to another range.
    """
    keys = [F.col(c) for c in group_cols]
    held = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = materialize(held.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("_range", F.shiftright("_at", 33))
    ranges = held.groupBy(*group_cols, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    named = {c: f"_group{i}" for i, c in enumerate([*group_cols, "_range"])}
    offsets = ranges.withColumn("_offset", offset).select(*[F.col(c).alias(n) for c, n in named.items()], "_offset")
    same = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()])
    placed = held.join(offsets, same).withColumn(out_col, (F.col("_at") + F.col("_offset")).cast("long"))
    return placed.drop("_at", "_range", "_offset", *named.values())


def number_within(df: DataFrame, group_cols: list[str], order_col: str, out_col: str = "pos") -> DataFrame:
    """1-based position of each row in its group by ascending ``order_col`` (unique per group)."""
    return numbered(df, group_cols, [F.col(order_col).asc()], out_col)
