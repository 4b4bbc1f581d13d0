"""A namer of large clusters gets bounded prompts that together hold every text."""

import re

import pandas as pd

import __spark_entry__ as E
from tests.conftest import SF
from voxpop.operators import naming as NM


def _named(spark, monkeypatch, fail=False):
    monkeypatch.setattr(NM, "PROMPT_LINES", 7)
    monkeypatch.setattr(NM, "PROMPT_CHARS", 60)
    rows = [(0 if i % 4 else 1, i, f"text {i % 331}") for i in range(1200)] + [(2, 5000, "alone"), (2, 5001, "alone"), (3, 6000, None)]

    def namer(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            lines = p.split("\n")
            if len(lines) > 7 or len(p) > 200:
                raise RuntimeError(f"a prompt of {len(lines)} lines and {len(p)} characters")
            if fail and "text 17 (" in p:
                raise RuntimeError("no reply")
            out.append(f"{sum(int(re.search(r'x([0-9]+)[)]$', x)[1]) for x in lines)}")
        return pd.Series(out)

    df = spark.createDataFrame(rows, "cluster_id long, row_id long, text string")
    return {r.cluster_id: r for r in NM.name_with_scorer(df, namer).collect()}


def test_every_text_reaches_a_bounded_prompt(spark, monkeypatch):
    got = _named(spark, monkeypatch)
    assert {c: (r.cluster_size, r["name"], r.score_error) for c, r in got.items()} == {
        0: (900, "900", None), 1: (300, "300", None), 2: (2, "2", None), 3: (1, "1", None)}


def test_a_failed_range_keeps_its_rows_and_its_error(spark, monkeypatch):
    got = _named(spark, monkeypatch, fail=True)
    assert got[0]["name"] == "900" and got[0].score_error == "RuntimeError: no reply"
    assert got[2].score_error is None


def test_registered_on_real_texts(spark):
    got = E.queries()["scored_text_names"](spark, SF).collect()
    assert all(r["name"] == f"{r.cluster_size} rows" and r.score_error is None for r in got)
