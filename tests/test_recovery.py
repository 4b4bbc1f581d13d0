"""Commit log, replays, early length check, time limits of scorers."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.operators import distribution as D
from voxpop.operators import scoring as SC
from voxpop.plans import workflows as WF
from voxpop.streaming import commits as CM
from voxpop.streaming import scoring as ST

POSTS = "row_id long, text string"


def _posts(spark, n):
    return spark.createDataFrame([(i, f"t{i}") for i in range(n)] + [(None, "no key")], POSTS)


def test_a_dead_run_and_its_leftovers(spark, tmp_path):
    done, posts, seen = str(tmp_path / "done"), _posts(spark, 100), []

    def score(df):
        return df.withColumn("label", F.lit("x"))

    def dies(df):
        seen.append(df.count())
        if len(seen) == 3:
            score(df).write.parquet(f"{done}/data/left")  # files are there, the commit is not
            raise RuntimeError
        return score(df)

    with pytest.raises(RuntimeError):
        ST.resume_scoring(posts, done, dies, slices=8)
    for marker in glob.glob(f"{done}/**/*_SUCCESS*", recursive=True):
        os.remove(marker)  # a cluster may write none
    before = CM.committed(spark, done)
    assert before.count() == sum(seen[:2])
    scored = []
    res = ST.resume_scoring(posts, done, lambda df: (scored.append(df.count()), score(df))[1], slices=8)
    assert sum(scored) == 101 - before.count()  # no committed row is scored again
    assert sorted((r.row_id is None, r.row_id) for r in res.collect() if r.row_id is not None) == [(False, i) for i in range(100)]
    again = ST.resume_scoring(posts, done, lambda df: pytest.fail("nothing is left to score"))
    assert again.count() == 101 and sum(c["rows"] for c in CM.commits(spark, done)) == 101
    assert CM.drop_uncommitted(spark, done) == ["left"] and CM.committed(spark, done).count() == 101


def test_commit_log_refuses(spark, tmp_path):
    df = _posts(spark, 3)
    CM.commit(df, str(tmp_path / "t"), "a")
    with pytest.raises(ValueError, match="committed already"):
        CM.commit(df, str(tmp_path / "t"), "a")
    df.write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="no commits"):
        ST.resume_scoring(df, str(tmp_path / "old"), lambda x: x)
    with pytest.raises(ValueError, match="no column"):
        ST.resume_scoring(df, str(tmp_path / "new"), lambda x: x.select("text"))
    empty = ST.resume_scoring(df.limit(0), str(tmp_path / "empty"), lambda x: x.withColumn("label", F.lit("x")))
    assert empty.count() == 0 and empty.columns == ["row_id", "text", "label"]


def test_running_counts_survive_a_replay(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    posts = spark.createDataFrame([(i, "空调太冷" if i % 2 else " ") for i in range(100)], POSTS)
    posts.repartition(4).write.parquet(src)
    ST.stream_labels(spark, src, posts.schema, out, f"{ck}1", S.demand_taxonomy(), max_files_per_trigger=1)
    schema = spark.read.parquet(out).schema
    counts = lambda: {r.demand: (r.n, r.rows) for r in ST.stream_distribution(spark, out, schema, "demand", "q", f"{ck}2").collect()}
    expect = {"舒适层": (50, 50), "其他": (0, 50)}
    assert counts() == expect
    rows = spark.createDataFrame(spark.read.parquet(f"{out}/batch=1").collect(), spark.read.parquet(f"{out}/batch=1").schema)
    ST.write_batch(out)(rows, 1)  # the same batch under new file names
    assert counts() == expect
    ST.write_batch(out)(rows.limit(1), 1)  # a replay may also hold other rows
    assert sum(r for _, r in counts().values()) == 100 - rows.count() + 1


def test_lengths_are_checked_before_a_scorer_runs(spark, tmp_path):
    calls = str(tmp_path)

    def scorer(prompts):
        open(f"{calls}/called", "w").close()
        return prompts

    truth = spark.createDataFrame([(0, "其他")], "row_id long, truth string")
    with pytest.raises(ValueError, match="no evaluation"):
        WF.label_and_evaluate(_posts(spark, 5), demand_truth=truth, demand_scorer=scorer, require_same_rows=True)
    assert not os.path.exists(f"{calls}/called")


def _replies(spark, n, scorer, **patience):
    df = spark.range(n, numPartitions=1).select(F.col("id").cast("string").alias("p"))
    got = SC.score_replies(df, scorer, F.col("p"), 4, SC.Patience(**patience)).collect()
    return {int(r.p): (r._reply, r.score_error) for r in got}


def test_calls_that_never_return(spark):
    def scorer(prompts):
        if (prompts == "5").any():
            time.sleep(3600)
        return "r" + prompts

    start = time.time()
    got = _replies(spark, 12, scorer, limit=0.3, retries=1, pause=0.01)
    assert time.time() - start < 60
    assert got.pop(5) == (None, "TimeoutError: no reply within 0.3 s")
    assert got == {i: (f"r{i}", None) for i in range(12) if i != 5}


def test_giving_up_and_retries(spark, tmp_path):
    log = str(tmp_path)

    def down(prompts):
        with open(f"{log}/calls", "a") as f:
            f.write("x")
        raise RuntimeError("down")

    got = _replies(spark, 40, down, give_up=3)
    assert sum(e == "RuntimeError: down" for _, e in got.values()) == 3
    assert sum(e == "Stopped: 3 rows without a reply" for _, e in got.values()) == 37
    assert os.path.getsize(f"{log}/calls") == 4  # one whole call, three rows

    def second_time(prompts):
        if len(prompts) > 1:
            raise RuntimeError
        path = f"{log}/{prompts.iloc[0]}"
        if not os.path.exists(path):
            open(path, "w").close()
            raise RuntimeError("busy")
        return prompts

    assert _replies(spark, 6, second_time, retries=1, pause=0.0) == {i: (str(i), None) for i in range(6)}


def test_blank_rows_and_label_filter(spark):
    posts = spark.createDataFrame([(0, "空调太冷"), (1, "安检很慢"), (2, " "), (3, None)], POSTS)
    lab = WF.label_and_evaluate(posts)
    assert tuple(lab.n_blank.first()) == (4, 2) == tuple(D.blank_rows(lab.posts).first())
    mined = WF.mine_factors(lab.posts, demands=["基础层"])
    assert [r.row_id for r in mined.table.collect()] == [1]
    assert WF.mine_factors(lab.posts, demands=["基础层"], sentiments=[]).table.count() == 0
    assert WF.mine_factors(lab.posts).table.count() == 4
