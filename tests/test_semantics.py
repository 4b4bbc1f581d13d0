
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxpop import schema as S
from voxpop.functions import reply as R
from voxpop.functions import text as X
from voxpop.operators import distribution as D
from voxpop.operators import evaluation as E
from voxpop.operators import factors as FA
from voxpop.operators import naming as NM
from voxpop.operators import network as NW
from voxpop.operators import scoring as SC
from voxpop.operators import vectors as V


def test_strip_blank_and_distribution_denominator(spark):
    rows = [(0, None), (1, ""), (2, "\u3000 "), (3, "车厢空调太冷"), (4, "安检很慢"), (5, "今天天气")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    lab = SC.label_with_rules(df, S.demand_taxonomy(), "text", "demand")
    got = {r.row_id: (r.demand, r.is_blank) for r in lab.collect()}
    assert got[0] == ("其他", True) and got[1] == ("其他", True) and got[2] == ("其他", True)
    assert got[3] == ("舒适层", False) and got[4] == ("基础层", False) and got[5] == ("其他", False)
    dist = {r.label: r for r in D.label_distribution(lab, S.demand_taxonomy(), "demand").collect()}
    assert dist["其他"].n == 1  # blank rows are not counted ...
    assert dist["舒适层"].n_total == 6  # ... but stay in the denominator
    assert abs(sum(r.share for r in dist.values()) - 3 / 6) < 1e-12
    assert dist["保障层"].n == 0 and dist["保障层"].share_pct == "0.00%"


def test_truncate_and_preview_code_points(spark):
    long = "😀" * 600
    df = spark.createDataFrame([(long, "a" * 100, "b" * 101)], "l string, p100 string, p101 string")
    r = df.select(F.length(X.truncate("l")).alias("t"), X.preview("p100").alias("a"), X.preview("p101").alias("b")).first()
    assert r.t == 500
    assert r.a == "a" * 100 and r.b == "b" * 100 + "..."


def test_reply_normalisers(spark):
    df = spark.createDataFrame([("基础层。",), (" 舒适层 \n",), ("不是正面，是负面",), ('{"choices":[{"message":{"content":"尊重层"}}]}',), (None,)],
                               "r string")
    out = df.select(R.exact_label(R.reply_content("r"), S.DEMAND_LABELS, "其他").alias("d"),
                    R.sentiment_from_reply("r").alias("s")).collect()
    assert [o.d for o in out] == ["其他", "舒适层", "其他", "尊重层", "其他"]
    assert out[2].s == "正面"  # the first containment test wins
    assert out[4].s == "中性"


def test_factor_parse_and_sentinels(spark):
    df = spark.createDataFrame([("列车空调， 安检,,超长的要素名称词",), ("无",), (None,)], "reply string")
    got = [r.f for r in df.select(X.or_default_list(X.split_factors("reply")).alias("f")).collect()]
    assert got == [["列车空调", "安检"], ["无法提取"], ["无法提取"]]


def _factor_df(spark, rows):
    return spark.createDataFrame(rows, "row_id long, text string, demand string, sentiment string, factors array<string>")


def test_factor_counts_ties_and_sentinels(spark):
    rows = [
        (0, "t", "舒适层", "负面", ["列车空调", "无法提取"]),  # sentinel in second place: both counted
        (1, "t", "舒适层", "负面", ["无法提取"]),  # sentinel first: skipped
        (2, "t", "舒适层", "负面", ["车厢拥挤", "列车空调"]),
        (3, "t", "舒适层", "负面", ["座椅", "车厢拥挤"]),
    ] + [(10 + i, "t", "舒适层", "负面", [f"因素{i:02d}"]) for i in range(12)]
    df = _factor_df(spark, rows)
    c = FA.factor_counts(df)
    counts = {r.factor: r.n for r in c.collect()}
    assert counts["无法提取"] == 1 and counts["列车空调"] == 2 and counts["车厢拥挤"] == 2
    assert c.first().group_total == 2 + 1 + 2 + 1 + 12
    top = FA.top_factors(c, 10).orderBy("rank").collect()
    # ties keep first-seen order: 列车空调 (row 0) before 车厢拥挤 (row 2); then 无法提取 (row 0, pos 1)
    assert [r.factor for r in top[:5]] == ["列车空调", "车厢拥挤", "无法提取", "座椅", "因素00"]
    assert len(top) == 10


def test_factor_rows_null_text_is_error_row(spark):
    df = _factor_df(spark, [(0, None, "其他", "中性", ["无法提取"]), (1, "x" * 150, "其他", "中性", ["安检服务"])])
    out = {r.row_id: r for r in FA.factor_rows(df).collect()}
    assert out[0].error is not None and out[0].factors_text is None
    assert out[1].preview == "x" * 100 + "..." and out[1].ordinal == 2 and out[1].n_factors == 1


def test_metrics_zero_denominators_and_half_even(spark):
    # label c is never predicted, label d never true
    rows = [(i, "a", "a") for i in range(31)] + [(31, "c", "d")]
    pairs = spark.createDataFrame(rows, "row_id long, truth string, pred string")
    m = {r.label: r for r in E.class_metrics(pairs).collect()}
    assert m["c"].precision == 0.0 and m["c"].recall == 0.0 and m["c"].f1 == 0.0 and m["c"].support == 1
    assert m["d"].precision == 0.0 and m["d"].support == 0
    acc = E.accuracy(pairs).first()
    assert acc.accuracy == 31 / 32 and acc.support == 32
    one = spark.createDataFrame([(1 / 32,)], "x double").select(X.round_even("x", 4).alias("r")).first().r
    assert one == 0.0312
    cm = E.confusion_long(pairs).collect()
    assert sum(r.n for r in cm) == 32 and len(cm) == 9
    rep = E.evaluation_report(pairs).collect()
    assert sum(r.support for r in rep if not r.is_total) == 32
    assert [r for r in rep if r.is_total][0].support == 32


def test_truth_of_another_length_raises(spark):
    pred = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, pred string")
    truth = spark.createDataFrame([(0, "a")], "row_id long, truth string")
    with pytest.raises(ValueError):
        E.align(pred, truth, require_same_rows=True)


def test_sentiment_rule_golden_examples(spark):
    cases = [
        ("南京地铁工作人员服务态度很热情", "正面"), ("车站的指引标识非常清晰易懂", "正面"),
        ("乘车环境干净舒适，体验很好", "正面"), ("熟悉的南京地铁味", "正面"),
        ("安检效率太低，耽误时间", "负面"), ("车厢空调温度太低，很不舒服", "负面"), ("高峰期拥挤得让人窒息", "负面"),
        ("南京地铁3号线有29个车站", "中性"), ("请问首班车是几点发车？", "中性"), ("明日南京地铁将调整运营时间", "中性"),
        ("比以前好多了", "正面"), ("不如上海地铁", "负面"), ("不如南京地铁", "正面"), ("希望改进服务", "负面"),
        ("夏天车厢很凉快", "正面"), ("冬天车厢太冷了", "负面"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "row_id long, text string")
    got = {r.row_id: r.sentiment for r in SC.label_with_rules(df, S.sentiment_taxonomy(), "text", "sentiment").collect()}
    assert [got[i] for i in range(len(cases))] == [lab for _, lab in cases]


def test_pluggable_scorer_isolates_failures(spark):
    def scorer(prompts: pd.Series) -> pd.Series:
        if any("boom" in p for p in prompts):
            if len(prompts) == 1:
                raise RuntimeError("service down")
            raise RuntimeError("batch failed")
        return prompts.map(lambda p: "舒适层" if "空调" in p else "基础层。")

    df = spark.createDataFrame([(0, "空调太冷"), (1, "boom"), (2, "  "), (3, "安检")], "row_id long, text string")
    out = {r.row_id: r for r in SC.label_with_scorer(df, scorer, S.demand_taxonomy(), "text", "demand").collect()}
    assert out[0].demand == "舒适层" and out[0].score_error is None
    assert out[1].demand == "其他" and "service down" in out[1].score_error
    assert out[2].demand == "其他" and out[2].is_blank
    assert out[3].demand == "其他"  # '基础层。' is not exactly a label
    dd = SC.label_with_scorer(df, scorer, S.demand_taxonomy(), "text", "demand", dedupe=True)
    assert {r.row_id: r.demand for r in dd.collect()} == {k: v.demand for k, v in out.items()}


def test_cue_factor_extraction(spark):
    df = spark.createDataFrame([(0, "列车空调冷得像冰窖，空调太冷"), (1, "安检员帮我找回了钱包"), (2, "今天")],
                               "row_id long, text string")
    got = {r.row_id: r.factors for r in SC.extract_factors(df).collect()}
    assert got == {0: ["列车空调"], 1: ["安检服务"], 2: ["无法提取"]}


def test_fallback_name_and_top_factor(spark):
    df = spark.createDataFrame([(0, 1, "abc"), (1, 2, "播报温暖，守护陪伴"), (2, 2, "播报温暖，情感共鸣"), (3, 2, "情感共鸣")],
                               "row_id long, cluster_id long, text string")
    got = {r.cluster_id: r.name for r in NM.top_factor_names(df, split=True).collect()}
    assert got[2] == "播报温暖"  # 2 each, 播报温暖 seen first
    assert got[1] == "abc"
    fb = spark.createDataFrame([("abc",)], "t string").select(NM.fallback_name(F.col("t")).alias("n")).first().n
    assert fb == "【自动生成】abc..."


def test_cosine_pairs_and_silhouette_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    lab = np.repeat(np.arange(4), 15)
    df = spark.createDataFrame([(i, x[i].tolist(), int(lab[i])) for i in range(60)], "id long, v array<float>, c int")
    pairs = V.cosine_pairs(df, "id", "v", block_rows=16).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sim = u @ u.T
    assert len(pairs) == 60 * 59 // 2
    assert max(abs(p.sim - sim[p.i, p.j]) for p in pairs) < 1e-9
    d = np.maximum(1 - sim, 0)
    np.fill_diagonal(d, 0)
    s = []
    for i in range(60):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    got = V.silhouette(V.normalize(df, "v", "u"), "u", "c")
    assert abs(got - float(np.mean(s))) < 1e-9


def test_cooccurrence_and_communities(spark):
    rows = [(i, "t", "舒适层", "负面", f) for i, f in enumerate([
        ["a", "b"], ["a", "b"], ["b", "c"], ["a", "c"], ["x", "y"], ["y", "z"], ["x", "z"], ["x", "y"], ["c", "x"]])]
    df = _factor_df(spark, rows)
    e = NW.cooccurrence(df)
    w = {(r.a, r.b): r.weight for r in e.collect()}
    assert w[("a", "b")] == 2 and w[("x", "y")] == 2 and w[("c", "x")] == 1
    comm = NW.communities(e)
    cm = {r.node: r.community for r in comm.collect()}
    assert cm["a"] == cm["b"] == cm["c"] and cm["x"] == cm["y"] == cm["z"] and cm["a"] != cm["x"]
    assert NW.modularity(e, comm) > 0.3


def test_community_levels_contract(spark):
    """A ring of 12 triangles: the second level joins neighbouring triangles only if that raises Q."""
    edges = []
    for c in range(12):
        a, b, d = (f"n{c:02d}{x}" for x in "abd")
        edges += [(a, b, 3), (a, d, 3), (b, d, 3), (min(d, f"n{(c + 1) % 12:02d}a"), max(d, f"n{(c + 1) % 12:02d}a"), 1)]
    e = spark.createDataFrame(edges, "a string, b string, weight long")
    comm, levels = NW.community_levels(e)
    got = {r.node: r.community for r in comm.collect()}
    assert len(got) == 36 and all(got[f"n{c:02d}a"] == got[f"n{c:02d}b"] == got[f"n{c:02d}d"] for c in range(12))
    assert levels == sorted(levels) and abs(levels[-1] - NW.modularity(e, comm)) < 1e-9 and levels[-1] > 0.75


def test_text_vectors_unit_and_equal(spark):
    df = spark.createDataFrame([(0, "列车空调"), (1, "列车空调"), (2, "安检服务")], "row_id long, text string")
    v = {r.row_id: np.array(r.embedding) for r in V.text_vectors(df).collect()}
    assert np.allclose(v[0], v[1]) and abs(np.linalg.norm(v[2]) - 1) < 1e-5


def test_pca_centred(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6)) + 5
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "id long, embedding array<double>")
    p = V.pca_2d(df, "embedding", "id").toPandas()
    assert abs(p.pc1.mean()) < 1e-9 and abs(p.pc2.mean()) < 1e-9
    assert p.pc1.var() >= p.pc2.var()


def test_weighted_silhouette_equals_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist(), int(i % 4), int(1 + i % 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>, c int, w int")
    got = V.silhouette(df, "v", "c", "w")
    x = np.array([v for _, v, _, w in rows for _ in range(w)])
    c = np.array([k for _, _, k, w in rows for _ in range(w)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(1 - u @ u.T, 0)
    np.fill_diagonal(d, 0)
    s = []
    for i in range(len(u)):
        own = c == c[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == k].mean() for k in set(c) if k != c[i])
        s.append((b - a) / max(a, b))
    assert abs(got - float(np.mean(s))) < 1e-9


def test_literal_trie_equals_alternation():
    import random
    import re

    rnd = random.Random(3)
    for _ in range(500):
        ws = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 8))]
        a, t = S.literal_alternation(ws), S.literal_trie(ws)
        for _ in range(20):
            text = "".join(rnd.choice("abcx") for _ in range(25))
            assert re.findall(a, text) == re.findall(t, text)


def test_cosine_pairs_copy_no_vector_into_a_shuffle(spark):
    """Any number of blocks: each pair once, and no grouping by pairs of blocks."""
    x = np.random.default_rng(1).normal(size=(50, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    for blocks in (4, 5):
        pairs = V.cosine_pairs(df, min_blocks=blocks)
        assert "FlatMapGroups" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.i, r.j) for r in pairs.collect()) == [(i, j) for i in range(50) for j in range(i + 1, 50)]


def test_late_calls_wait_side_by_side(spark):
    import time

    def scorer(prompts):
        if prompts.str.contains("late").any():
            time.sleep(60)
        return prompts

    df = spark.createDataFrame([(i, "late" if i % 4 == 0 else "ok") for i in range(32)], "row_id long, text string").coalesce(1)
    patience = SC.Patience(limit=1.0, at_once=8)
    began = time.time()
    got = SC.score_replies(df, scorer, F.col("text"), call_rows=4, patience=patience).collect()
    assert time.time() - began < 12  # 8 calls of 2 waits each: 16 s one after the other
    assert [(r.row_id, r._reply is None) for r in sorted(got)] == [(i, i % 4 == 0) for i in range(32)]
    with pytest.raises(ValueError):
        SC.Patience(at_once=2, give_up=1)


def _late_or_ok(prompts):
    import time

    if prompts.str.contains("late").any():
        time.sleep(60)
    return "r" + prompts


def _scored(texts, scorer, call_rows, **patience):
    from voxpop.operators.calls import score_batches

    batches = (pd.Series(t, dtype=object) for t in texts)
    return list(score_batches(batches, scorer, call_rows, SC.Patience(**patience)))


def test_rows_of_late_calls_wait_side_by_side():
    import time

    texts = [[f"{'late' if i % 2 else 'ok'}{i}" for i in range(n)] for n in (64, 0, 7)]
    began = time.time()
    got = _scored(texts, _late_or_ok, 16, limit=0.5, retries=1, pause=0.01, at_once=2, rows_at_once=64)
    assert time.time() - began < 8  # the rows of each call one after the other: 18 s and more
    for batch, (replies, errors) in zip(texts, got, strict=True):
        assert replies == [None if "late" in t else f"r{t}" for t in batch]
        assert errors == ["TimeoutError: no reply within 0.5 s" if "late" in t else None for t in batch]
    for wrong in ({"rows_at_once": 0}, {"rows_at_once": 2, "give_up": 1}):
        with pytest.raises(ValueError):
            SC.Patience(**wrong)


def test_late_calls_leave_nothing_behind(tmp_path, monkeypatch):
    import multiprocessing
    import os
    import threading

    from voxpop.operators import calls as CA

    monkeypatch.setattr(CA, "MOST_LATE", 8)

    def scorer(prompts):
        with open(tmp_path / str(os.getpid()), "a") as f:
            f.write(f"{threading.active_count()}\n")
        return _late_or_ok(prompts)

    before = threading.active_count()
    (_, errors), = _scored([["late"] * 64], scorer, 8, limit=0.2, at_once=2, rows_at_once=8)
    assert errors == ["TimeoutError: no reply within 0.2 s"] * 64
    assert threading.active_count() == before and not multiprocessing.active_children()
    seen = [[int(n) for n in p.read_text().split()] for p in tmp_path.iterdir()]
    assert len(seen) > 2 and sum(map(len, seen)) == 8 + 64
    assert max(map(max, seen)) <= 2 + 8 + 2 + 8  # its two threads, the late calls, and as many as may be under way


def test_errors_and_order_of_calls_side_by_side():
    def scorer(prompts):
        if prompts.str.contains("bad").any():
            raise RuntimeError("no reply")
        return prompts * 50_000

    texts = [[f"{'bad' if i % 5 == 0 else 'x'}{i}" for i in range(41)] for _ in range(3)]
    got = _scored(texts, scorer, 4, at_once=4, rows_at_once=3)
    assert got == _scored(texts, scorer, 4)
    assert [e for e in got[2][1] if e] == ["RuntimeError: no reply"] * 9


def test_stream_files_grow_with_the_input(spark, monkeypatch):
    from voxpop.plans import queries as Q

    assert Q._files(spark.range(10, numPartitions=1)) == 4
    assert Q._files(spark.range(10, numPartitions=9)) == 9


def test_factor_clusters_drop_unseen_columns(spark):
    from voxpop.operators import clustering as CL

    unit = [[0.0] * 6 + [0.6, 0.8], [0.0] * 6 + [1.0, 0.0]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(unit)], "id long, unit array<double>")
    assert [r.unit for r in CL._seen_columns(df).orderBy("id").collect()] == [[0.6, 0.8], [1.0, 0.0]]
    assert CL._seen_columns(df.where("false")).count() == 0
