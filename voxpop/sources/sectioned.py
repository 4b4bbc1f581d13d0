"""Sectioned-text source (S5, T6, F10): listings of ``◆ 簇 <id> (共 <n> 条):`` headers and ``i. text`` items.

Files are read line by line, so large files are split. A listing may run over
many files (in path order) and many splits: a section that is open at the end
of one split goes on in the next. The last header is carried inside a split by
a running ``last(ignorenulls)``, and across splits by a prefix over one row per
split. Items before any header and all other lines are dropped; a repeated
header appends to its section; the declared count is not checked. Item
positions inside a section follow file order, then line order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxpop.functions import text as X
from voxpop.operators import ordering as O
from voxpop.session import materialize

# The listing's header and item line patterns.
HEADER_RE = r"^◆ 簇 (\d+) \(共 (\d+) 条\):"
ITEM_RE = r"^\d+\. (.+)"


#: Lines of one task that the order key has room for.
LINES = 1 << 33


def read_sectioned(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(cluster_id LONG, pos LONG, text STRING)``."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), X.py_strip("value").alias("line"))
    is_head = F.col("line").rlike(HEADER_RE)
    tagged = lines.select(
        "file", "start", "id", F.when(is_head, F.regexp_extract("line", HEADER_RE, 1).cast("long")).alias("hdr"),
        F.when(~is_head & F.col("line").rlike(ITEM_RE), F.regexp_extract("line", ITEM_RE, 1)).alias("item"))
    # written: the ids name the tasks of this one pass
    tagged = materialize(tagged.where("hdr is not null or item is not null"), "sections")
    inside = Window.partitionBy("file", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    carried = tagged.withColumn("own", F.last("hdr", ignorenulls=True).over(inside))
    # one row per split: its place in the order, and the section open before it
    splits = tagged.groupBy("file", "start").agg(F.max_by("hdr", F.when(F.col("hdr").isNotNull(), F.col("id"))).alias("open"))
    order = Window.orderBy("file", "start")
    splits = splits.select(
        "file", "start", F.row_number().over(order).alias("nth"),
        F.last("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    items = carried.join(splits, ["file", "start"]).withColumn("cluster_id", F.coalesce("own", "before"))
    items = items.where(F.col("item").isNotNull() & F.col("cluster_id").isNotNull())
    keyed = items.select("cluster_id", "item", (F.col("nth").cast("long") * LINES + F.pmod("id", F.lit(LINES))).alias("ord"))
    return O.number_within(keyed, ["cluster_id"], "ord", out_col="pos").select("cluster_id", "pos", F.col("item").alias("text"))
