import glob
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxpop import schema as S
from voxpop.operators import clustering as CL
from voxpop.operators import vectors as V
from voxpop.streaming import scoring as ST

POSTS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("text", T.StringType())])


def test_stream_restart_scores_only_new_files(spark):
    base = tempfile.mkdtemp(prefix="vx-stream-", dir="/tmp")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    spark.createDataFrame([(0, "空调太冷"), (1, "安检很慢")], POSTS).write.parquet(f"{src}/a")
    ST.stream_labels(spark, f"{src}/*", POSTS, out, ck, S.demand_taxonomy())
    n1 = len(glob.glob(f"{out}/batch=*"))
    ST.stream_labels(spark, f"{src}/*", POSTS, out, ck, S.demand_taxonomy())  # restart, nothing new
    assert len(glob.glob(f"{out}/batch=*")) == n1
    spark.createDataFrame([(2, "  "), (3, "怀念")], POSTS).write.parquet(f"{src}/b")
    ST.stream_labels(spark, f"{src}/*", POSTS, out, ck, S.demand_taxonomy())
    got = {r.row_id: r.demand for r in spark.read.parquet(out).collect()}
    assert got == {0: "舒适层", 1: "基础层", 2: "其他", 3: "共鸣层"}


def test_resumable_scoring_scores_each_row_once(spark):
    done = tempfile.mkdtemp(prefix="vx-resume-", dir="/tmp") + "/done"
    posts = spark.createDataFrame([(i, f"t{i}") for i in range(10)], POSTS)
    calls = []

    def score(df):
        calls.append(1)
        return df.withColumn("label", F.lit("x"))

    ST.resume_scoring(posts.where("row_id < 4"), done, score)
    res = ST.resume_scoring(posts, done, score)
    assert sorted(r.row_id for r in res.collect()) == list(range(10))


def test_user_encoder(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "ab"), (2, "cd")], "row_id long, text string")

    def enc(s: pd.Series):
        return np.stack([[len(t), ord(t[0])] for t in s]).astype(float)

    v = {r.row_id: r.embedding for r in V.encode_with(df, enc).collect()}
    assert v[0] == v[1] == [2.0, 97.0] and v[2] == [2.0, 99.0]


def test_bisecting_alternative(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(3, 8)) * 5
    rows = [(i, (centers[i % 3] + rng.normal(size=8) * 0.1).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    r = CL.cluster_bisecting(df, ks=[2, 3, 4])
    assert r.best_threshold == 3.0
    sizes = sorted(x.cluster_size for x in r.assignments.select("cluster_id", "cluster_size").distinct().collect())
    assert sizes == [20, 20, 20]
