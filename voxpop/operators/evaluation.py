"""Evaluation of predicted labels against a truth table.

Truth and prediction are aligned by key (an equi-join on ``row_id``), never by
position. The joined rows are aggregated once, to the counts of (truth, pred)
pairs; everything else is computed from that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import text as X
from voxpop.session import materialize

COUNT_COLUMNS = ["truth", "pred", "n"]


def require_equal_rows(pred: DataFrame, truth: DataFrame) -> None:
    """The reference's contract, truth covers every post: raise when the row counts differ."""
    n_pred, n_truth = pred.count(), truth.count()
    if n_pred != n_truth:
        raise ValueError(f"truth has {n_truth} rows, prediction has {n_pred}: no evaluation")


def align(pred: DataFrame, truth: DataFrame, key: str = "row_id", pred_col: str = "pred",
          true_col: str = "truth", require_same_rows: bool = False) -> DataFrame:
    """``(key, truth, pred)`` for keys present on both sides.

    ``require_same_rows=True``: :func:`require_equal_rows` before any evaluation.
    """
    if require_same_rows:
        require_equal_rows(pred, truth)
    return (pred.select(key, F.col(pred_col).alias("pred"))
            .join(truth.select(key, F.col(true_col).alias("truth")), key, "inner"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(truth, pred, n)``: the only pass over the rows; at most labels x labels rows.

    Written once, so that the labels, the matrix, the class metrics and the
    total all read this small table and the predictions are computed once.
    """
    if pairs.columns == COUNT_COLUMNS:
        return pairs
    return materialize(pairs.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n")), "pair-counts")


def observed_labels(pairs: DataFrame) -> DataFrame:
    """X1 + T8: union of truth and predicted labels, in code-point order."""
    counts = pair_counts(pairs)
    return (counts.select(F.col("truth").alias("label")).union(counts.select(F.col("pred").alias("label")))
            .where(F.col("label").isNotNull()).distinct().orderBy("label"))


def _labels(counts: DataFrame, labels: list[str] | None) -> DataFrame:
    if labels is None:
        return observed_labels(counts)
    return counts.sparkSession.createDataFrame([(x,) for x in labels], "label string")


def confusion_long(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """A2 long form ``(truth, pred, n)`` over labels x labels, zeros kept."""
    counts = pair_counts(pairs)
    labs = _labels(counts, labels)
    # the grid from each label's array of all labels: the label set is closed and small
    every = labs.agg(F.sort_array(F.collect_list("label")).alias("all"))
    grid = every.select(F.explode("all").alias("truth"), "all").select("truth", F.explode("all").alias("pred"))
    return (grid.join(counts, ["truth", "pred"], "left")
            .select("truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_wide(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """A2 wide form: one row per true label, one column per predicted label."""
    return (confusion_long(pairs, labels).groupBy("truth").pivot("pred", labels).agg(F.sum("n"))
            .orderBy("truth"))


def crosstab(pairs: DataFrame) -> DataFrame:
    """A3: observed labels only; rows with a null on either side drop out."""
    clean = pair_counts(pairs).where(F.col("truth").isNotNull() & F.col("pred").isNotNull())
    return clean.groupBy("truth").pivot("pred").agg(F.sum("n")).na.fill(0).orderBy("truth")


def class_metrics(pairs: DataFrame, labels: list[str] | None = None, round_to: int | None = 4) -> DataFrame:
    """A4 + A5: per label tp/fp/fn, precision, recall, F1 (0 on a zero denominator), support.

    ``labels=None``: every label seen (demand form, rounded half-even to 4);
    a fixed list with ``round_to=None``: the sentiment form.
    """
    counts = pair_counts(pairs)
    # each cell votes tp for its label, or fn for the true and fp for the predicted label
    vote = lambda label, kind: F.struct(F.col(label).alias("label"), F.lit(kind).alias("kind"))
    votes = counts.select("n", F.explode(F.when(F.col("truth") == F.col("pred"), F.array(vote("truth", "tp")))
                                         .otherwise(F.array(vote("truth", "fn"), vote("pred", "fp")))).alias("v"))
    agg = votes.groupBy("v.label").agg(*[
        F.coalesce(F.sum(F.when(F.col("v.kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
    m = (_labels(counts, labels).join(agg, "label", "left").na.fill(0, ["tp", "fp", "fn"])
         .withColumn("precision", X.safe_div("tp", F.col("tp") + F.col("fp")))
         .withColumn("recall", X.safe_div("tp", F.col("tp") + F.col("fn")))
         .withColumn("f1", X.safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
         .withColumn("support", (F.col("tp") + F.col("fn")).cast("long")))
    if round_to is not None:
        for c in ("precision", "recall", "f1"):
            m = m.withColumn(c, X.round_even(c, round_to))
    return m.select("label", "tp", "fp", "fn", "precision", "recall", "f1", "support").orderBy("label")


def accuracy(pairs: DataFrame) -> DataFrame:
    """Right rows / all rows (one row); a null truth or prediction is a wrong row, as in the reference."""
    counts = pair_counts(pairs)
    right = F.coalesce(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))), F.lit(0))
    rows = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return counts.agg(F.when(rows > 0, right.cast("double") / rows).alias("accuracy"), rows.alias("support"))


def evaluation_report(pairs: DataFrame, labels: list[str] | None = None, round_to: int | None = 4) -> DataFrame:
    """A7 + X2: class rows, then one total row (metrics null, support = rows, accuracy only here)."""
    counts = pair_counts(pairs)
    cls = class_metrics(counts, labels, round_to).select("label", "precision", "recall", "f1", "support")
    total = accuracy(counts).select(F.lit(S.TOTAL_ROW_LABEL).alias("label"), "support", "accuracy")
    return cls.withColumn("is_total", F.lit(False)).unionByName(
        total.withColumn("is_total", F.lit(True)), allowMissingColumns=True)
