import random

import numpy as np
import pytest

from voxpop.llm import quality as Q
from voxpop.llm import toxicity as X
from voxpop.llm.common import held_out

SF = "/root/testdata/sf0.1"


def test_factorization_machine_learns_an_interaction():
    """Toxic only if an insult and a group come together: no linear weights separate that."""
    rng = random.Random(1)
    docs, y = [], []
    for _ in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        docs.append(X.terms(" ".join(["badword"] * insult + ["people"] * group + [f"w{rng.randrange(40)}" for _ in range(4)])))
        y.append(insult and group)
    fm = X.FactorizationMachine.fit(docs, np.array(y, float), epochs=200, l2=1e-5)
    score = lambda t: fm.score(X.terms(t))
    assert score("badword people") > 0.5 > max(score("badword"), score("people"), score(""))


def test_fold_is_crc32(spark):
    import zlib

    got = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


@pytest.mark.parametrize(("name", "label", "least"), [("op7_toxicity_fm", "toxic", 0.97), ("op3_quality_pu", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    from voxpop.llm.queries import registry

    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = registry()[name](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= least
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("operator", [X.score_toxicity, Q.score_quality])
def test_edge_rows(spark, operator):
    schema = "doc_id long, text string, score string, terms int"
    rows = [(1, None, "s", 0), (2, "", "s", 0), (2, "", "s", 0), (None, "a b", "s", 0), (4, "word, " * 50_000, "s", 0), (5, "e", None, None)]
    rows += [(i, f"text number {i} is fine", "s", 0) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10, 40)] + [(10, 0, 0), (None, 1, 1), (11, None, None)], "doc_id long, toxic int, quality int")
    got = operator(docs, labels, ~held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    scores = {(r.doc_id, r.text): r.score for r in got}
    assert scores[1, None] == scores[2, ""]
    assert operator(docs.where("false"), labels, ~held_out()).count() == 0
    none = operator(docs, labels.where("false"), ~held_out()).collect()
    assert {r.score for r in none} == {0.5}


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, (2000, 2))
    u = np.vstack([rng.normal(2, 1, (1400, 2)), rng.normal(-2, 1, (600, 2))])
    assert abs(Q.estimated_prior(p, u) - 0.7) < 0.1
    m = Q.PuModel.fit(p, u, 0.7)
    assert m.score(rng.normal(2, 1, (500, 2))).mean() > 0.8 > 0.2 > m.score(rng.normal(-2, 1, (500, 2))).mean()


def test_pair_of_neutral_words_stays_in_the_model():
    """Both words are commoner in clean texts; only together they are toxic, in 4 % of the toxic texts."""
    rng = random.Random(3)
    docs, y = [], []
    for _ in range(12_000):
        toxic = rng.random() < 0.11
        words = [f"w{int(rng.paretovariate(0.7)) % 4000}" for _ in range(40)]
        if toxic:
            words += ["badword", "people"] if rng.random() < 0.04 else [rng.choice(["slur1", "slur2", "slur3"])]
        elif (r := rng.random()) < 0.2:
            words.append("badword" if r < 0.1 else "people")
        docs.append(X.terms(" ".join(words)))
        y.append(float(toxic))
    fm = X.FactorizationMachine.fit(docs, np.array(y))
    score = lambda t: fm.score(X.terms(t))
    assert score("badword people") > 0.5 > max(score("badword"), score("people"), score(""))
    assert len(fm.ids) < 40  # the ordinary words stay out


def test_interacting_terms_by_plain_counts():
    """The screen against a count of every pair."""
    rng = np.random.default_rng(4)
    x = rng.random((600, 12)) < 0.3
    y = ((x[:, 0] & x[:, 1]) | (rng.random(600) < 0.05)).astype(float)
    row, col = np.nonzero(x)
    known = np.zeros(12, bool)
    n, have = x.sum(axis=0), x.T @ y
    logit = lambda h, k: np.log((h + 0.5) / (k - h + 0.5))
    single, base = logit(have, n), logit(y.sum(), 600)
    least = np.zeros(12, bool)
    for i in range(12):
        for j in range(i):
            both = x[:, i] & x[:, j]
            p = 1 / (1 + np.exp(-(single[i] + single[j] - base)))
            off = abs(y[both].sum() - both.sum() * p) / np.sqrt(both.sum() * p * (1 - p) + 1)
            if both.sum() >= X.MIN_DOCS and both.sum() < 0.9 * min(n[i], n[j]) and off >= X.PAIR_DEVIATIONS:
                least[[i, j]] = True
    assert (X.interacting(row, col, y, 12, known) == least).all()


def test_negative_labels_are_not_read(spark):
    good, bad = "A calm sentence, number {}, ends here.", "$$$ || !!! {} %%% ###"
    docs = spark.createDataFrame([(i, (good if i % 4 else bad).format(i)) for i in range(400)], "doc_id long, text string")
    labels = [(i, int(i % 4 > 0)) for i in range(0, 400, 3)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    scores = lambda rows: sorted((r.doc_id, r.score) for r in Q.score_quality(docs, table(rows), ~held_out()).collect())
    assert scores(labels) == scores([x for x in labels if x[1]])
