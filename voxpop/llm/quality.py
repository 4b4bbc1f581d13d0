"""Quality: positive-unlabelled learning (operator 3).

The learner sees trusted positives and unlabelled web text, never a negative.
It minimises the non-negative unbiased risk of Kiryo et al. (2017),

    pi * E_p[l(g, +)] + max(0, E_u[l(g, -)] - pi * E_p[l(g, -)]),

with the logistic loss and a linear score over properties of the writing (the
share of symbols, capitals, repeated words and lines, and so on, and their
squares). Where the inner risk turns negative, the step goes against it.

The class prior pi comes from the positives and the unlabelled rows alone, by
the Elkan-Noto estimator; rows labelled as negative are not read. Both samples are bounded by parameters
(``POSITIVES``, ``UNLABELLED``), are taken in the order of a hash of the id
and travel as a few dozen numbers a row. Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop.llm.common import hash_of_id, lowest_hashes
from voxpop.llm.toxicity import labelled_sample
from voxpop.session import ship_package

POSITIVES, UNLABELLED = 10_000, 20_000
_UPPER = bytes(range(65, 91))
_PUNCT = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_SYMBOLS = (b"%", b"*", b"&", b"#", b"$", b"!", b"|")
#: Numbers that ``properties`` gives.
N_PROPERTIES = 16


def properties(text: str | None) -> np.ndarray:
    """What the writing of a whole text looks like; an empty or null text gives zeros."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return np.zeros(N_PROPERTIES)
    n, m = len(b), len(words)
    lines = [x for x in b.split(b"\n") if x]
    long = np.fromiter(map(len, words), np.int64, m)
    repeats = sum(x == y for x, y in zip(words, words[1:], strict=False))
    return np.array([
        (n - len(b.translate(None, _PUNCT))) / n,
        sum(map(b.count, _SYMBOLS)) / n,
        (n - len(b.translate(None, _UPPER))) / n,
        sum(map(bytes.isupper, words)) / m,
        repeats / m,
        len(set(words)) / m,
        np.log(n), np.log(m), np.log(1 + len(lines)),
        len(set(lines)) / max(1, len(lines)),
        b.count(b"|") / m, b.count(b"!!") / m, b.count(b".") / m, b.count(b",") / m,
        long.mean(), np.log(long.max()),
    ])


class PuModel:
    """A linear score over standardised properties and their squares."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z**2])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))

    @staticmethod
    def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 1500, rate: float = 0.03, l2: float = 1e-4) -> PuModel:
        """Adam on the non-negative risk. Without positives or unlabelled rows every score is 0.5."""
        both = np.vstack([positive, unlabelled])
        mean = both.mean(axis=0) if len(both) else np.zeros(N_PROPERTIES)
        scale = both.std(axis=0) + 1e-6 if len(both) else np.ones(N_PROPERTIES)
        model = PuModel(mean, scale, np.zeros(1 + 2 * len(mean)))
        if not len(positive) or not len(unlabelled):
            return model
        p, u, w = model.inputs(positive), model.inputs(unlabelled), model.weights
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            zp, zu = p @ w, u @ w
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            inner = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_inner = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
            g_positive = prior * (p.T @ (sp - 1)) / len(p)
            grad = (g_positive + g_inner if inner >= 0 else -g_inner) + l2 * w
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Elkan and Noto (2008): fit labelled against unlabelled, divide the mean score of the unlabelled by that of the positives."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    x = np.vstack([positive, unlabelled])
    model = PuModel(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(1 + 2 * x.shape[1]))
    z, y = model.inputs(x), np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    for _ in range(500):
        model.weights -= 0.3 * (z.T @ (1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30))) - y) / len(y) + 1e-3 * model.weights)
    c = model.score(positive).mean()
    odds = model.score(unlabelled)
    odds = (1 - c) / c * odds / np.maximum(1e-9, 1 - odds)
    return float(np.clip(np.minimum(1, odds).mean(), 0.05, 0.98))


def _sampled(rows: DataFrame) -> pd.DataFrame:
    """The properties of a bounded sample (text and the columns before it), on the driver: some 150 bytes a row."""

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "y": f["y"], "x": [properties(t) for t in f["text"]]})

    return rows.select("id", "y", "text").mapInPandas(described, "id long, y int, x array<double>").toPandas().sort_values("id")


def fit(docs: DataFrame, labels: DataFrame, learn, *, label: str, id_col: str, text_col: str, positives: int, unlabelled: int) -> PuModel:
    ship_package(docs.sparkSession)
    trusted = _sampled(labelled_sample(docs, labels.where(F.col(label) > 0), label, id_col, text_col, positives, learn))
    web = docs.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    web = lowest_hashes(web, unlabelled, 1).distinct().orderBy(hash_of_id(1), "id").limit(unlabelled).withColumn("y", F.lit(0))
    web = _sampled(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(web), "id")
    )
    of = lambda f: np.stack(f["x"].to_list()) if len(f) else np.empty((0, N_PROPERTIES))
    p, u = of(trusted), of(web)
    return PuModel.fit(p, u, estimated_prior(p, u))


def score_quality(
    docs: DataFrame, labels: DataFrame, learn, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, name: str = "score",
) -> DataFrame:
    """``docs`` with a score column from 0 to 1 (higher: ``label`` 1 likelier).

    ``learn`` says which rows may be learned from, for both samples. Only the
    text is an input of the score: null and blank texts score as the empty
    text, equal texts score equally, repeated rows stay, other columns are
    carried along (a column called ``name`` is replaced). Empty tables give an
    empty result; without positives every score is 0.5.
    """
    model = fit(docs, labels, learn, label=label, id_col=id_col, text_col=text_col, positives=positives, unlabelled=unlabelled)
    mean, scale, weights = model.mean, model.scale, model.weights  # some fifty numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(PuModel(mean, scale, weights).score(np.stack([properties(t) for t in texts])))

    return docs.withColumn(name, score(F.col(text_col)))
