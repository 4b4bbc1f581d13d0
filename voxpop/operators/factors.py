"""Factor mining.

Rows of ``(row_id, demand, sentiment, factors ARRAY<STRING>)`` are exploded once
and aggregated on ``(demand, sentiment, factor)`` with map-side partial
aggregation; the top-k then runs over the (much smaller) count table in two
stages (per salted bucket, then per group). Ties keep first-seen order, i.e. the
smallest ``(row_id, position)`` where the factor occurred in the group, like the
reference's stable sort over insertion order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import text as X
from voxpop.operators import ordering as O


def factor_rows(df: DataFrame, key: str = "row_id", text_col: str = "text") -> DataFrame:
    """Row table of the factor step.

    Good rows: ordinal, demand, sentiment, preview, factors_text, n_factors.
    A null text is an error row: only ordinal and ``error`` (the reference fails
    on the preview of a null and records the error instead).
    """
    good = F.col(text_col).isNotNull()
    only = lambda c: F.when(good, c)
    return df.select(
        F.col(key), (F.col(key) + 1).cast("long").alias("ordinal"),
        only(F.col("demand")).alias("demand"), only(F.col("sentiment")).alias("sentiment"),
        only(X.preview(text_col)).alias("preview"),
        only(X.join_factors("factors")).alias("factors_text"),
        only(F.size("factors").cast("long")).alias("n_factors"),
        F.when(~good, F.lit("text is null")).alias("error"))


def counted_factors(factors="factors"):
    """P12 as an array expression: the row's factors, or an empty list when the
    first one is a sentinel. (A ``where`` on a computed array would be pushed below
    the projection and re-run the whole extraction inside the filter.)"""
    arr = F.col(factors) if isinstance(factors, str) else factors
    first = F.try_element_at(arr, F.lit(1))
    return F.when((F.size(arr) > 0) & ~first.isin(*S.FACTOR_SENTINELS), arr).otherwise(F.array().cast("array<string>"))


def exploded(df: DataFrame, key: str = "row_id", group_cols: tuple[str, ...] = ("demand", "sentiment")) -> DataFrame:
    """P12 + posexplode: one row per factor occurrence of rows whose first factor is not a sentinel."""
    base = df.where(F.col("text").isNotNull()) if "text" in df.columns else df
    return base.select(key, *group_cols, F.posexplode(counted_factors()).alias("pos", "factor"))


#: Positions in one row's list stay below this: an array has at most 2^31 elements.
POSITIONS = 10**10


def first_seen_key(row_id, pos):
    """(row_id, pos) as one decimal, exact for every long row id, so that ``min`` stays a hash aggregate (a struct min sorts)."""
    shifted = row_id.cast("decimal(20,0)") * F.lit(POSITIONS).cast("decimal(11,0)")
    return (shifted + pos.cast("decimal(10,0)")).cast("decimal(33,0)")


def first_seen(key):
    """The row id and the position of a :func:`first_seen_key`."""
    pos = F.pmod(key, F.lit(POSITIONS).cast("decimal(33,0)")).cast("long")
    return ((key - pos.cast("decimal(10,0)")) / F.lit(POSITIONS).cast("decimal(11,0)")).cast("long"), pos


def factor_counts(df: DataFrame, key: str = "row_id", group_cols: tuple[str, ...] = ("demand", "sentiment")) -> DataFrame:
    """A8 + A9 + C1: occurrences per (group, factor), the group total, and first-seen order.

    One scan of the posts; totals are an aggregate of the count table joined
    back, so a group with a large open vocabulary is never one task. Null
    labels form groups like others.
    """
    occ = exploded(df, key, group_cols)
    counts = occ.groupBy(*group_cols, "factor").agg(
        F.count(F.lit(1)).alias("n"), F.min(first_seen_key(F.col(key), F.col("pos"))).alias("fk"))
    totals = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in group_cols]).agg(
        F.sum("n").alias("group_total"), F.min("fk").alias("gk"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group_cols]
    row, pos = first_seen(F.col("fk"))
    group_row, group_pos = first_seen(F.col("gk"))
    return counts.join(totals, same).select(
        *group_cols, "factor", "n", "group_total", row.alias("first_row"), pos.alias("first_pos"),
        group_row.alias("group_first_row"), group_pos.alias("group_first_pos"))


def top_factors(counts: DataFrame, k: int = 10, group_cols: tuple[str, ...] = ("demand", "sentiment")) -> DataFrame:
    """Top-k per group, count desc, ties by first-seen order; groups in first-seen order.

    Two-stage (salted by factor) so a group with a huge vocabulary is never one task.
    """
    order = [F.desc("n"), F.asc("first_row"), F.asc("first_pos")]
    return (O.top_k_within(counts, list(group_cols), order, k, "factor")
            .orderBy("group_first_row", "group_first_pos", "rank"))


def stats_json(top: DataFrame, group_cols: tuple[str, ...] = ("demand", "sentiment")) -> DataFrame:
    """K3 shape: one row per group, ``group_key``, ``total`` and the ordered top list.

    ``top_factors`` is ARRAY<STRUCT<factor, n>> in rank order (a JSON object keeps
    that order when written), ``json`` is the reference's per-group object.
    """
    g = (top.groupBy(*group_cols)
         .agg(F.first("group_total").alias("total"),
              F.min(F.struct("group_first_row", "group_first_pos")).alias("_first"),
              F.sort_array(F.collect_list(F.struct("rank", "factor", "n"))).alias("_top")))
    top_list = F.transform("_top", lambda x: F.struct(x["factor"].alias("factor"), x["n"].alias("n")))
    as_map = F.map_from_entries(F.transform("_top", lambda x: F.struct(x["factor"], x["n"])))
    return (g.select(X.group_key(*group_cols).alias("group_key"), *group_cols, "total",
                     top_list.alias("top_factors"),
                     F.to_json(F.struct(F.col("total").alias("总记录数"), as_map.alias("高频因素"))).alias("json"),
                     "_first")
            .orderBy("_first").drop("_first"))
