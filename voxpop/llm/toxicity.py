"""Toxicity: a factorization machine over hashed terms (operator 7).

A text is the set of its hashed terms: words, and the first ``STEM`` bytes of
longer words, which stand for the inflected forms of a stem. The score is
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` (Rendle 2010): the linear part
learns single terms, the factors learn pairs, such as an insult together with
the mention of a group, that no sum of weights expresses.

The model is fitted on at most ``SAMPLE`` labelled rows, taken in the order of
a hash of the id; the bound is a parameter, and scoring covers every whole text. The fit
is one task over that bounded sample. Terms enter the model when at least
``MIN_DOCS`` sampled documents have them and either their shares among the two
classes differ by ``DEVIATIONS`` standard deviations, or some pair of theirs does
what its two terms together don't explain (:func:`interacting`). So the thousands
of ordinary words of a long text add no noise, and a word that is harmless alone
stays when it tells beside another. The model has at most ``2**BITS`` rows and is
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop.llm.common import hash_of_id, lowest_hashes
from voxpop.session import ship_package

#: Most labelled rows that the fit reads.
SAMPLE = 12_000
#: Hash space of the terms: 2**BITS buckets.
BITS = 20
#: Terms in fewer sampled documents carry no weight.
MIN_DOCS = 6
DEVIATIONS = 4.0
#: The same for pairs, of which there are millions.
PAIR_DEVIATIONS = 8.0
FACTORS = 4
STEM = 4
_PUNCT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def terms(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed terms of a text: letters and digits in lower case, all else separates."""
    if not text:
        return np.empty(0, np.int64)
    words = text.lower().encode("utf-8", "surrogatepass").translate(_PUNCT).split()
    words = set(words)
    words.update({w[:STEM] + b"*" for w in words if len(w) > STEM})
    return np.unique(np.fromiter(map(crc32, words), np.int64, len(words)) & ((1 << bits) - 1))


def interacting(row: np.ndarray, col: np.ndarray, y: np.ndarray, m: int, known: np.ndarray) -> np.ndarray:
    """Which of ``m`` terms belong to a pair with an effect of its own.

    ``row`` and ``col`` say which document has which term. A pair's share of
    class 1 is compared with the sum of the effects (in log odds) of its two
    terms; it counts when it differs by ``PAIR_DEVIATIONS``. Pairs of two
    ``known`` terms are not looked at. Every document is read once per term it has.
    """
    d = len(y)
    logit = lambda have, n: np.log((have + 0.5) / (n - have + 0.5))
    # frequent terms first, so that a pair is looked at once, from its rarer term
    by_n = np.argsort(-np.bincount(col, minlength=m), kind="stable")
    rank = np.empty(m, np.int64)
    rank[by_n] = np.arange(m)
    col = rank[col]
    entries = np.lexsort((col, row))
    row, col, known = row[entries], col[entries], known[by_n]
    n = np.bincount(col, minlength=m)
    single = logit(np.bincount(col, y[row], m), n)
    base = logit(y.sum(), d)
    starts = np.searchsorted(row, np.arange(d + 1))
    places = np.split(np.argsort(col, kind="stable"), np.cumsum(n)[:-1]) if m else []
    found = np.zeros(m, bool)
    for j, at in enumerate(places):
        docs = row[at]
        beside = np.concatenate([col[starts[i] : end] for i, end in zip(docs, at, strict=True)])
        both = np.bincount(beside, minlength=j)
        toxic = np.bincount(beside, np.repeat(y[docs], at - starts[docs]), j)
        # a term that nearly always stands beside the other one makes no pair of its own
        i = np.flatnonzero((both >= MIN_DOCS) & (both < 0.9 * n[j]) & ~(known[:j] & known[j]))
        p = 1 / (1 + np.exp(-np.clip(single[i] + single[j] - base, -30, 30)))
        off = np.abs(toxic[i] - both[i] * p) / np.sqrt(both[i] * p * (1 - p) + 1)
        if (off >= PAIR_DEVIATIONS).any():
            found[i[off >= PAIR_DEVIATIONS]] = found[j] = True
    return found[rank]


class FactorizationMachine:
    """Weights of the active terms: ``ids`` (sorted), ``w``, ``v`` (a row each), and the bias ``w0``."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, v: np.ndarray, w0: float):
        self.ids, self.w, self.v, self.w0 = ids, w, v, w0

    def _find(self, found: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        return at[self.ids[at] == found]

    def score(self, found: np.ndarray) -> float:
        at = self._find(found)
        v = self.v[at]
        z = self.w0 + self.w[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    @staticmethod
    def fit(
        docs: list[np.ndarray], y: np.ndarray, *, factors: int = FACTORS, min_docs: int = MIN_DOCS, epochs: int = 80,
        rate: float = 0.05, l2: float = 2e-4, seed: int = 7,
    ) -> FactorizationMachine:
        """Full-batch Adam on the logistic loss, both classes weighing the same.

        No rows give a score of 0.5; one class only gives that class.
        """
        if not len(docs) or len(set(y.tolist())) < 2:
            w0 = 0.0 if not len(docs) else (30.0 if y[0] else -30.0)
            return FactorizationMachine(np.empty(0, np.int64), np.empty(0), np.empty((0, factors)), w0)
        flat = np.concatenate(docs)
        ids, where, n = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        n1 = y.sum()
        have, share = np.bincount(where, y[row], len(ids)), n / len(docs)
        spread = np.sqrt(share * (1 - share) * (1 / n1 + 1 / (len(docs) - n1))) + 1e-12
        apart = np.abs(have / n1 - (n - have) / (len(docs) - n1)) / spread
        often = n >= min(min_docs, max(1, len(docs) // 20))
        keep = often & (apart >= DEVIATIONS)
        at = (np.cumsum(often) - 1)[where[often[where]]]
        keep[often] |= interacting(row[often[where]], at, y, int(often.sum()), keep[often])
        row = row[keep[where]]
        col = (np.cumsum(keep) - 1)[where[keep[where]]]
        ids, d, m = ids[keep], len(docs), int(keep.sum())
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (d - y.sum()))
        rng = np.random.default_rng(seed)
        # the bias and every weight in one vector for Adam
        theta = np.concatenate([np.zeros(1 + m), rng.normal(0, 0.01, m * factors)])
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, epochs + 1):
            w0, w, v = theta[0], theta[1 : 1 + m], theta[1 + m :].reshape(factors, m)
            sums = [np.bincount(row, vf[col], d) for vf in v]
            z = w0 + np.bincount(row, w[col], d)
            z += 0.5 * sum(s**2 - np.bincount(row, vf[col] ** 2, d) for s, vf in zip(sums, v, strict=True))
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            each = g[row]
            per_term = np.bincount(col, each, m)
            grad = [np.array([g.sum()]), per_term + l2 * w]
            grad += [np.bincount(col, each * s[row], m) - vf * per_term + l2 * vf for s, vf in zip(sums, v, strict=True)]
            grad = np.concatenate(grad)
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            theta -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        return FactorizationMachine(ids, theta[1 : 1 + m].copy(), theta[1 + m :].reshape(factors, m).T.copy(), float(theta[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample: int, learn) -> DataFrame:
    """At most ``sample`` rows (id, text, y) of the fold ``learn``, by a hash of the id.

    Only the ids, at most ``sample`` longs, are broadcast, so the texts are
    filtered where they are read. A doubled label counts as its largest value.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learn)
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    chosen = lowest_hashes(known, sample).groupBy("id").agg(F.max("y").alias("y")).orderBy(hash_of_id(), "id").limit(sample)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")


def fit(sample: DataFrame, bits: int = BITS) -> FactorizationMachine:
    """Fits on rows (id, text, y): terms are hashed where the rows are, the bounded sample is fitted in one task."""
    ship_package(sample.sparkSession)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "y": f["y"], "terms": [terms(t, bits) for t in f["text"]]})

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        rows = pd.concat(parts) if parts else pd.DataFrame({"id": [], "y": [], "terms": []})
        rows = rows.drop_duplicates("id").sort_values("id")
        fm = FactorizationMachine.fit([np.asarray(t) for t in rows["terms"]], rows["y"].to_numpy(float))
        yield pd.DataFrame({"id": [-1], "w": [fm.w0], "v": [[]]})
        for at in range(0, len(fm.ids), 10_000):
            cut = slice(at, at + 10_000)
            yield pd.DataFrame({"id": fm.ids[cut], "w": fm.w[cut], "v": list(fm.v[cut])})

    rows = (
        sample.mapInPandas(hashed, "id long, y int, terms array<long>")
        .repartition(1)
        .mapInPandas(train, "id long, w double, v array<double>")
        .toPandas()
    )
    w0 = float(rows.loc[rows["id"] < 0, "w"].iloc[0])
    rows = rows[rows["id"] >= 0].sort_values("id")
    v = np.stack(rows["v"].to_list()) if len(rows) else np.empty((0, FACTORS))
    return FactorizationMachine(rows["id"].to_numpy(), rows["w"].to_numpy(), v, w0)


def score_column(spark, model: FactorizationMachine, bits: int = BITS):
    """A pandas UDF text -> score; the model is broadcast (at most 2**bits terms)."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.ids, model.w, model.v, model.w0))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fm = FactorizationMachine(*shared.value)
        for batch in texts:
            yield pd.Series([fm.score(terms(t, bits)) for t in batch], dtype=float)

    return score


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    sample: int = SAMPLE, name: str = "score",
) -> DataFrame:
    """``docs`` with a score column from 0 to 1 (higher: ``label`` 1 likelier).

    ``learn`` says which labelled rows may be learned from. Only the text is an
    input of the score: a null text scores as an empty one (the bias alone),
    equal texts score equally, repeated rows stay, other columns are carried
    along (a column called ``name`` is replaced). Empty tables give an empty
    result; without labels every score is 0.5.
    """
    model = fit(labelled_sample(docs, labels, label, id_col, text_col, sample, learn))
    return docs.withColumn(name, score_column(docs.sparkSession, model)(F.col(text_col)))
