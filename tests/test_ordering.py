from pyspark.sql import Window
from pyspark.sql import functions as F

from voxpop.operators import ordering as O


def _df(spark):
    # one hot group holding most rows, ids sparse and unordered in the input
    rows = [(0 if i % 5 else 1, i * 7 % 1009, f"t{i}", i % 13) for i in range(600)]
    return spark.createDataFrame(rows, "g long, k long, text string, n long")


def test_number_within_matches_window(spark):
    df = _df(spark)
    got = O.number_within(df, ["g"], "k", out_col="pos")
    ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    a = sorted((r.g, r.k, r.pos) for r in got.collect())
    b = sorted((r.g, r.k, r.pos) for r in ref.collect())
    assert a == b


def test_top_k_within_matches_window(spark):
    df = _df(spark)
    order = [F.desc("n"), F.asc("k")]
    got = O.top_k_within(df, ["g"], order, 7, "text", buckets=9)
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where("rank <= 7")
    a = sorted((r.g, r.k, r["rank"]) for r in got.collect())
    b = sorted((r.g, r.k, r["rank"]) for r in ref.collect())
    assert a == b


def test_numbers_of_sparse_dense_and_hot_keys(spark):
    """Keys a million apart and keys side by side, a hot group over several ranges, a null group."""
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("sparse", i * 1_000_000) for i in range(1000)] + [("dense", i) for i in range(3000)] + [(None, -i) for i in range(50)] + [("one", 5)]
        df = spark.createDataFrame(rows, "g string, k long").repartition(5)
        got = O.number_within(df, ["g"], "k")
        ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k")))
        assert sorted(map(str, got.collect())) == sorted(map(str, ref.collect()))
        whole = O.numbered(df, [], [F.desc("k"), F.asc_nulls_first("g")], "rank")
        assert [(r.g, r.k) for r in whole.orderBy("rank").collect()] == [(r.g, r.k) for r in df.orderBy(F.desc("k"), F.asc_nulls_first("g")).collect()]
        assert sorted(r["rank"] for r in whole.collect()) == list(range(1, len(rows) + 1))
        held = df.repartitionByRange("g", "k").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert held < 3 * len(rows) / 16  # no range is much larger than the others
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_ranks_of_themes_have_no_window_over_rows(spark):
    from voxpop.operators import network as NW

    df = spark.createDataFrame([(i, "正面", [f"t{i % 7}"]) for i in range(60)], "row_id long, sentiment string, factors array<string>")
    plan = NW.theme_ranking(df)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and NW.theme_ranking(df).count() == 7
    assert O.numbered(df.limit(0), [], [F.asc("row_id")]).count() == 0
