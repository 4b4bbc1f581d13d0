"""Incremental and resumable scoring (ST1, ST2, K2).

* ``resume_scoring`` (K2 re-aimed): a result table keyed by ``row_id``; each run
  scores only ``src ⟕anti done``, in hashed slices that are committed one by one
  to a log. A crash loses at most the slice in flight; what is committed is never
  scored again.
* ``stream_labels`` (ST1): ``readStream`` over new post files -> stateless rule
  scoring -> ``foreachBatch`` writing ``<out>/batch=<id>`` with overwrite, so a
  replayed batch id rewrites the same folder (idempotent); with the checkpoint a
  restart scores only files it has not seen. ``trigger(availableNow=True)``.
* ``stream_distribution`` (ST2): running label counts over the scored stream,
  kept by scored batch in the folder beside the checkpoint, so a replayed batch
  replaces its counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxpop import schema as S
from voxpop.operators import scoring as SC
from voxpop.session import drop_scratch, path_exists, scratch_path
from voxpop.streaming import commits as CM


def resume_scoring(src: DataFrame, done_path: str, score, key: str = "row_id", slices: int = 16) -> DataFrame:
    """K2: score rows of ``src`` not yet in ``done_path``, slice by slice; returns the whole result table.

    The result table and its commit log are those of :mod:`voxpop.streaming.commits`:
    a slice is in the table once its commit is, whatever a crash leaves behind.
    The source and the result are read once; what is left to do is written by
    slices to a scratch folder and scored from there. Rows with a null key are
    one key. A result table without a log, or without the key, is an error:
    taking it for a first run would score rows twice.
    """
    spark = src.sparkSession
    todo, done = src, CM.committed(spark, done_path)
    if done is not None:
        if key not in done.columns:
            raise ValueError(f"result table {done_path} has no column {key!r}")
        known = done.select(F.col(key).alias("_done"))
        todo = src.join(known, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    pending, run = scratch_path(spark, "pending"), uuid.uuid4().hex[:8]
    todo.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices))).write.partitionBy("_slice").parquet(pending)
    for i in range(slices):
        part = f"{pending}/_slice={i}"
        if not path_exists(spark, part):
            continue
        scored = score(spark.read.schema(src.schema).parquet(part))
        if key not in scored.columns:
            raise ValueError(f"scored rows have no column {key!r}")
        CM.commit(scored, done_path, f"{run}-{i:04d}")
        drop_scratch(spark, part)
    drop_scratch(spark, pending)
    if done is None and not CM.commits(spark, done_path):  # nothing to score at all: an empty table with its columns
        CM.commit(score(src.limit(0)), done_path, f"{run}-empty")
    return CM.committed(spark, done_path)


def write_batch(out_path: str):
    """What ST1 does with a batch: its folder is rewritten whole."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write


def stream_labels(spark: SparkSession, src_path: str, schema: T.StructType, out_path: str, checkpoint: str,
                  taxonomy: S.Taxonomy, text_col: str = "text", fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> None:
    """ST1: score every new file under ``src_path`` once; blocks until all available input is done."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    labelled = SC.label_with_rules(reader.load(src_path), taxonomy, text_col)
    q = (labelled.writeStream.foreachBatch(write_batch(out_path)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_distribution(spark: SparkSession, scored_path: str, schema: T.StructType, label_col: str,
                        query_name: str, checkpoint: str) -> DataFrame:
    """ST2: running counts per label over the folder that :func:`stream_labels` writes; n without blank rows, and all rows.

    The counts are kept by the scored batch: when files of a batch turn up, the
    whole batch is counted and its counts replace the ones before. A replayed
    batch, whose folder is rewritten under new file names, is thus counted once.
    """
    if "batch" not in schema.fieldNames():
        raise ValueError("the scored folder has no column 'batch'")
    out = f"{checkpoint}-counts"

    def replace(batch: DataFrame, _: int) -> None:
        ids = [r.batch for r in batch.select("batch").distinct().collect()]  # no more than the files that turned up
        if ids:
            whole = spark.read.schema(schema).parquet(scored_path).where(F.col("batch").isin(ids))
            counts = whole.groupBy("batch", label_col).agg(F.count(F.when(~F.col("is_blank"), 1)).alias("n"), F.count(F.lit(1)).alias("rows"))
            counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    # files that a replay has replaced are gone: their batch turns up again with the new ones
    new = spark.readStream.schema(schema).option("ignoreMissingFiles", "true").parquet(scored_path)
    q = (new.writeStream.queryName(query_name).foreachBatch(replace)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    kept = T.StructType([schema[label_col], T.StructField("n", T.LongType()), T.StructField("rows", T.LongType())])
    if not path_exists(spark, out):
        return spark.createDataFrame([], kept)
    return spark.read.schema(kept).parquet(out).groupBy(label_col).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
