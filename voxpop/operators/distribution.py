"""Label distributions and cross-tabs.

One partial+final aggregation over the labelled rows; the category dimension
(a handful of rows, fixed by the taxonomy) is broadcast for the zero fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import text as X


def label_distribution(labelled: DataFrame, taxonomy: S.Taxonomy, label_col: str | None = None,
                       order: str = "count") -> DataFrame:
    """A1: scored (non-blank) rows per category, zero filled; share = n / all rows.

    Blank rows are not counted but stay in the denominator, so shares may sum
    to less than 1. ``order='count'``: n desc, then category ordinal (demand);
    ``order='category'``: ordinal (sentiment). Columns: label, ordinal, n,
    n_total, share, share_pct.
    """
    label_col = label_col or taxonomy.name
    spark = labelled.sparkSession
    blank = F.col("is_blank") if "is_blank" in labelled.columns else F.lit(False)
    counts = (labelled.groupBy(F.col(label_col).alias("label"))
              .agg(F.count(F.when(~blank, 1)).alias("n"), F.count(F.lit(1)).alias("rows")))
    # the total over the (one row per label) count table: one scan of the posts
    counts = counts.withColumn("n_total", F.sum("rows").over(Window.partitionBy()))
    dim = F.broadcast(taxonomy.to_df(spark))  # size = number of categories
    out = (dim.join(counts, "label", "left")
           .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
           .withColumn("n_total", F.coalesce(F.max("n_total").over(Window.partitionBy()), F.lit(0)).cast("long"))
           .drop("rows")
           .withColumn("share", X.safe_div("n", "n_total"))
           .withColumn("share_pct", X.percent_text("share")))
    keys = [F.desc("n"), F.asc("ordinal")] if order == "count" else [F.asc("ordinal")]
    return out.select("label", "ordinal", "n", "n_total", "share", "share_pct").orderBy(*keys)


def row_counts(df: DataFrame, n_factors_col: str = "n_factors") -> DataFrame:
    """Loaded rows, rows with factors, rows with real (non-sentinel) factors, in one job."""
    first = F.try_element_at(F.col("factors"), F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col(n_factors_col) > 0, 1)).alias("n_with_factors"),
        F.count(F.when((F.col(n_factors_col) > 0) & ~first.isin(*S.FACTOR_SENTINELS), 1)).alias("n_extracted"),
    )


def demand_sentiment_table(labelled: DataFrame, demand_col: str = "demand", sentiment_col: str = "sentiment",
                           with_totals: bool = True) -> DataFrame:
    """Demand x sentiment counts; ``cube`` adds the margins (null = all)."""
    cells = labelled.groupBy(demand_col, sentiment_col).agg(F.count(F.lit(1)).alias("n"))
    if not with_totals:
        return cells
    return cells.cube(demand_col, sentiment_col).agg(F.sum("n").alias("n"))  # of the few cells, not of every post


def demand_sentiment_wide(labelled: DataFrame, demand_col: str = "demand", sentiment_col: str = "sentiment") -> DataFrame:
    """C2 wide form: one row per demand level, one column per sentiment label."""
    return (labelled.groupBy(demand_col).pivot(sentiment_col, S.SENTIMENT_LABELS)
            .agg(F.count(F.lit(1))).na.fill(0))


def blank_rows(labelled: DataFrame) -> DataFrame:
    """One row: how many posts there are, and how many of them are blank (no scorer saw them, no label counts them)."""
    return labelled.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_blank"), 1)).alias("n_blank"))
