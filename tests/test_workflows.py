"""The workflows with scorers, and the outputs they write."""

import glob
import json
import os

import pandas as pd
import pytest

from voxpop import schema as S
from voxpop.functions import text as X
from voxpop.operators import evaluation as E
from voxpop.operators import factors as FA
from voxpop.plans import workflows as WF
from voxpop.sources import csv as CSV
from voxpop.streaming import commits as CM
from voxpop.streaming import scoring as ST


def test_each_post_is_scored_once_for_all_outputs(spark, tmp_path):
    log = str(tmp_path / "calls")

    def scorer(prompts: pd.Series) -> pd.Series:
        import uuid

        with open(f"{log}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        return pd.Series([S.DEMAND_LABELS[hash((p, uuid.uuid4().int)) % 5] for p in prompts])  # another answer each time

    posts = spark.createDataFrame([(i, f"post {i}") for i in range(60)] + [(60, None), (61, " ")], "row_id long, text string")
    lab = WF.label_and_evaluate(posts, demand_scorer=scorer, demand_template="rate: {}")
    out = WF.write_outputs(str(tmp_path / "out"), lab)
    prompts = [x for p in glob.glob(f"{log}-*") for x in open(p).read().split("\n")]
    assert sorted(prompts) == sorted(f"rate: post {i}" for i in range(60))
    table = spark.read.parquet(out["labels"])
    assert "demand_error" in table.columns
    counts = {r.demand: r["count"] for r in table.where("not is_blank").groupBy("demand").count().collect()}
    stats = spark.read.option("header", True).csv(out["demand_stats"])
    assert stats.columns == ["类别", "数量", "占比"]
    assert {r["类别"]: int(r["数量"]) for r in stats.collect() if r["数量"] != "0"} == counts


def test_mined_outputs_and_names(spark, tmp_path):
    rows = [(i, t, "舒适层", "负面") for i, t in enumerate(["空调太冷", "空调很冷，拥挤", "拥挤", "安检慢", "空调"] * 4)]
    posts = spark.createDataFrame(rows, "row_id long, text string, demand string, sentiment string")

    def scorer(prompts: pd.Series) -> pd.Series:
        assert all(p.startswith("舒适层/负面/") for p in prompts)
        return prompts.map(lambda p: "列车空调" if "空调" in p else "车厢拥挤")

    mined = WF.mine_factors(posts, scorer=scorer, template="{demand}/{sentiment}/{text}")
    namer = lambda prompts: prompts.map(lambda p: f'"{p.split(" (x")[0]}" ')
    clustered = WF.cluster_and_name(mined.table, namer=namer)
    out = WF.write_outputs(str(tmp_path / "out"), None, mined, clustered)
    text = "".join(open(p).read() for p in sorted(glob.glob(out["factor_stats"] + "/part-*")))
    assert json.loads(text) == {"舒适层-负面": {"总记录数": 20, "高频因素": {"列车空调": 12, "车厢拥挤": 8}}}
    if clustered.report is not None:
        report = "".join(open(p).read() for p in sorted(glob.glob(out["report"] + "/part-*")))
        assert report.startswith("=" * 60 + "\n") and "标准表述: 列车空调\n" in report
        assert os.path.exists(out["listing"])


def test_resume_after_a_scorer_that_dies(spark, tmp_path):
    src = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "row_id long, text string")
    calls = []

    def dying(df):
        calls.append(1)
        if len(calls) == 6:
            raise RuntimeError("service down")
        return df

    done = str(tmp_path / "done")
    with pytest.raises(RuntimeError):
        ST.resume_scoring(src, done, dying)
    part = CM.committed(spark, done).count()
    assert 0 < part < 200
    scored = []
    res = ST.resume_scoring(src, done, lambda df: (scored.append(df.count()), df)[1])
    assert sum(scored) == 200 - part and res.count() == 200 and res.select("row_id").distinct().count() == 200
    with pytest.raises(ValueError):
        ST.resume_scoring(src.withColumnRenamed("row_id", "id"), done, lambda df: df, key="id")


def test_rounding_equals_python(spark):
    ratios = [(a / b,) for b in range(1, 60) for a in range(b + 1)] + [(0.12345,), (0.05385,), (0.00015,), (2469 / 20000,), (1 / 32,)]
    got = spark.createDataFrame(ratios, "x double").select("x", X.round_even("x", 4).alias("r")).collect()
    assert all(r.r == round(r.x, 4) for r in got)


def test_null_truth_counts_as_wrong(spark):
    pairs = spark.createDataFrame([("a", "a"), (None, "a"), ("b", "a")], "truth string, pred string")
    assert E.accuracy(pairs).first().accuracy == pytest.approx(1 / 3)


def test_factors_of_the_5000th_file(spark):
    base = 5000 * CSV.FILE_ID_SHIFT
    df = spark.createDataFrame([(base + 3, "d", "s", ["ab", "cd"]), (base + 2, "d", "s", ["cd"])], "row_id long, demand string, sentiment string, factors array<string>")
    got = {r.factor: (r.n, r.first_row, r.first_pos, r.group_first_row) for r in FA.factor_counts(df).collect()}
    assert got == {"ab": (1, base + 3, 0, base + 2), "cd": (2, base + 2, 0, base + 2)}


def test_recovery_of_a_damaged_file(spark, tmp_path):
    body = "微博正文,n\n安检很慢,1\n".encode("gb18030") + b"\xff\xff,2\n"
    (tmp_path / "a.csv").write_bytes(body)
    with pytest.raises(ValueError):
        CSV.read_csv_tolerant(spark, str(tmp_path / "a.csv"), "微博正文", candidates=["gb18030", "utf-8"])
    got = CSV.read_csv_tolerant(spark, str(tmp_path / "a.csv"), "微博正文", candidates=["gb18030", "utf-8"], recover=True)
    assert [r["微博正文"] for r in got.orderBy("row_id").collect()][0] == "安检很慢" and got.count() == 2
