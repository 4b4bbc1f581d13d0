"""Sinks (K1, K3-K6): CSV result tables, nested JSON stats, grouped listings, cluster report.

All writers are distributed ``DataFrameWriter`` calls; nothing is assembled on
the driver. Paths default to a fresh folder under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxpop import schema as S
from voxpop.session import scratch_path

STATS_JSON_SCHEMA = T.StructType([
    T.StructField("group_key", T.StringType()),
    T.StructField("demand", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("total", T.LongType()),
    T.StructField("top_factors", T.ArrayType(T.StructType([
        T.StructField("factor", T.StringType()), T.StructField("n", T.LongType())]))),
    T.StructField("json", T.StringType()),
])


def write_csv(df: DataFrame, path: str | None = None, export_names: bool = False, mode: str = "overwrite",
              encoding: str = "UTF-8") -> str:
    """K1/K6: header, RFC-4180 quoting (quote doubled, not backslash-escaped), white space kept."""
    path = path or scratch_path(df.sparkSession, "csv")
    if export_names:
        df = df.select(*[F.col(c).alias(S.EXPORT_NAMES.get(c, c)) for c in df.columns])
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", encoding).csv(path))
    return path


def write_parquet(df: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    path = path or scratch_path(df.sparkSession, "parquet")
    df.write.mode(mode).parquet(path)
    return path


def write_stats_json(stats: DataFrame, path: str | None = None) -> str:
    """K3 as lines: one JSON object per group with key, total and ordered top factors (UTF-8, non-ASCII kept)."""
    path = path or scratch_path(stats.sparkSession, "stats-json")
    stats.coalesce(1).write.mode("overwrite").json(path)  # one row per (demand, sentiment): bounded
    return path


def write_stats_object(stats: DataFrame, path: str | None = None) -> str:
    """K3 as the reference writes it: one object ``{group: {总记录数, 高频因素: {factor: n}}}``, groups in
    first-seen order. It holds one entry per (demand, sentiment) label pair, so it is one small value."""
    path = path or scratch_path(stats.sparkSession, "stats-object")
    entry = lambda x: F.concat(F.to_json(F.array(x["group_key"])), F.lit(":"), x["json"])
    one = stats.agg(F.collect_list(F.struct("group_key", "json")).alias("g"))
    key = lambda x: F.regexp_replace(entry(x), r'^\["((?:[^"\\\\]|\\\\.)*)"\]:', '"$1": ')
    text = F.concat(F.lit("{"), F.array_join(F.transform("g", key), ", "), F.lit("}"))
    one.select(text.alias("value")).write.mode("overwrite").text(path)
    return path


def listing_lines(groups: DataFrame, group_col: str = "cluster_id", order_col: str = "row_id",
                  text_col: str = "text") -> DataFrame:
    """K4 as rows: per group a header ``◆ 簇 <id> (共 <n> 条):`` (preceded by an empty
    line), a dash rule as long as the header plus that newline, then ``i. text``.

    Returns ``(group, line_no, line)``. Item numbers come from the skew-safe
    range numbering and sizes from an aggregate, so no group is one task.
    """
    from voxpop.operators.ordering import number_within

    items = number_within(groups.select(group_col, order_col, text_col), [group_col], order_col, out_col="i")
    sizes = groups.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    header = F.concat(F.lit("\n"), F.format_string("◆ 簇 %s (共 %s 条):", F.col(group_col).cast("string"),
                                                    F.col("n").cast("string")))
    heads = sizes.select(group_col, F.lit(-1).cast("long").alias("line_no"), header.alias("line"))
    rules = sizes.select(group_col, F.lit(0).cast("long").alias("line_no"),
                         F.expr("repeat('-', length(" + _header_sql(group_col) + "))").alias("line"))
    body = items.select(group_col, F.col("i").cast("long").alias("line_no"),
                        F.concat(F.col("i").cast("string"), F.lit(". "), F.col(text_col)).alias("line"))
    return heads.unionByName(rules).unionByName(body)


def _header_sql(group_col: str) -> str:
    return f"concat('\\n', format_string('◆ 簇 %s (共 %s 条):', cast({group_col} as string), cast(n as string)))"


def write_listing(lines: DataFrame, path: str | None = None, group_col: str = "cluster_id", files: int | None = None) -> str:
    """K4: the listing as text, range-partitioned on (group, line_no) and sorted inside
    each file, so concatenating the part files in name order gives the reference's
    layout; a large group spreads over several files instead of one row or task."""
    path = path or scratch_path(lines.sparkSession, "listing")
    by = (group_col, "line_no")
    dealt = lines.repartitionByRange(files, *by) if files else lines.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    return path


def cluster_report_lines(report: DataFrame) -> DataFrame:
    """K5 as rows: per cluster the id/size line, the standard phrase, a rule and up to 5 samples.

    ``report`` has cluster_id, cluster_size, name, samples ARRAY<STRING> (<= 5, in order).
    """
    body = F.concat(
        F.format_string("■ 簇ID: %s (共%s条)\n", F.col("cluster_id").cast("string"), F.col("cluster_size").cast("string")),
        F.concat(F.lit("标准表述: "), F.col("name"), F.lit("\n")),
        F.lit("-" * 50 + "\n"),
        F.lit("代表性原始文本:\n"),
        F.array_join(F.transform("samples", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), ""),
        F.lit("\n" + "=" * 60 + "\n"),
    )
    return report.select("cluster_id", body.alias("value"))


# Default title of the report; callers put their subject before it.
REPORT_TITLE = "情感因素聚类结果 - 语义对齐标准表述"


def write_cluster_report(report: DataFrame, path: str | None = None, title: str = REPORT_TITLE) -> str:
    """K5: the title block, then the clusters by id; part files in name order give the report."""
    path = path or scratch_path(report.sparkSession, "cluster-report")
    rule = "=" * 60
    block = report.sparkSession.range(1).select(
        F.lit(0).alias("o"), F.lit(None).cast("long").alias("cluster_id"), F.lit(f"{rule}\n{title}\n{rule}\n").alias("value"))
    body = cluster_report_lines(report).select(F.lit(1).alias("o"), F.col("cluster_id").cast("long").alias("cluster_id"), "value")
    (block.unionByName(body).repartitionByRange("o", "cluster_id").sortWithinPartitions("o", "cluster_id")
     .select("value").write.mode("overwrite").text(path))
    return path
