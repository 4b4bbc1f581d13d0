"""Document fingerprints by closed syncmers (operator 6).

A k-mer of code points is a closed syncmer (Edgar 2021) if the smallest of its
s-mers, in a hashed order, is its first or its last. Whether a k-mer is chosen
depends on the k-mer alone, never on what stands around it, so equal passages
give the same anchors wherever they stand. The fingerprint of a text is the
``SIZE`` smallest hashes of its distinct syncmers, and the likeness of two
fingerprints estimates the share of common syncmers (Jaccard). Texts under
``SHORT`` code points have k-mers of another length; a pair with such a text is
compared on the short k-mers of both texts, however long the other is.

:func:`anchors` gives the positions for matching passages; :func:`edited`
pairs every document with its successor in the order of ids, by one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxpop.session import ship_package

K, S = 16, 8  # K = 2 * S
#: Texts shorter than ``SHORT`` have too few long k-mers; they take k-mers of 4 and s-mers of 2.
SHORT, SHORT_S = 64, 2
SIZE = 64
#: Rows that a range of ids holds on average, and most ranges.
RANGE_ROWS, RANGES = 5000, 2000
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.uint64]:
    out = [_B]
    with np.errstate(over="ignore"):
        for _ in range(3):
            out.append(out[-1] * out[-1])
    return out


_POWERS = _powers()  # B, B^2, B^4, B^8


def syncmers(text: str | None, s: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and hashes of the closed syncmers; a text shorter than a k-mer is one anchor, an empty one none.

    ``s``: the length of the s-mers, half a k-mer; by the length of the text if None.
    """
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    s = s or (S if len(h) >= SHORT else SHORT_S)
    if len(h) < 2 * s:
        acc = np.zeros(1, np.uint64)
        for c in h:
            acc = _mix(acc * _B + c)
        return np.zeros(1, np.int64), acc
    doublings = s.bit_length() - 1
    for i in range(doublings):  # polynomial hashes of 2, 4, ... s code points
        h = h[: -(1 << i)] * _POWERS[i] + h[1 << i :]
    whole = _mix(h[:-s] * _POWERS[doublings] + h[s:])
    order = _mix(h)
    low = order
    for i in range(doublings):
        low = np.minimum(low[: -(1 << i)], low[1 << i :])
    low = np.minimum(low[:-1], order[s:])  # over the s + 1 s-mers of a k-mer
    at = np.flatnonzero((order[:-s] == low) | (order[s:] == low))
    return at, whole[at]


def _smallest(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SIZE]


class Sketch:
    """The smallest distinct 32-bit hashes of a text's syncmers, sorted, and those on the short scale where a comparison asks for them.

    Without its ``text`` a sketch counts as one of a long text, to be compared with long ones only.
    """

    def __init__(self, own: np.ndarray, text: str | None):
        self.own, self._text = own, text
        self.is_short = text is not None and len(text) < SHORT

    @cached_property
    def short(self) -> np.ndarray:
        return self.own if self.is_short else _smallest(syncmers(self._text, SHORT_S)[1])


def sketch(text: str | None) -> Sketch:
    return Sketch(_smallest(syncmers(text)[1]), text or "")


def likeness(x: Sketch, y: Sketch) -> float:
    """Estimated Jaccard similarity of two syncmer sets of one scale; 1 if both are empty, 0 if one is."""
    if not len(x.own) or not len(y.own):
        return float(len(x.own) == len(y.own))
    a, b = (x.short, y.short) if x.is_short or y.is_short else (x.own, y.own)
    union = np.union1d(a, b)[:SIZE]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def printed(s: Sketch) -> str:
    return s.own.astype(">u4").tobytes().hex()


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, anchor): one row per closed syncmer, for positional matching by a join on the anchor.

    Null and empty texts have none; repeated rows repeat theirs.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<struct<position:long,anchor:long>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([
            [{"position": p, "anchor": a} for p, a in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
            for at, h in map(syncmers, texts)
        ])

    return docs.select(F.col(id_col), F.explode(found(F.col(text_col))).alias("a")).select(id_col, "a.position", "a.anchor")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last third (rounded down) replaced by the first as
    many code points of the next document in descending id (after the last: the
    first; a single document follows itself). Returns (id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one
    row per input row. A null text counts as empty. Rows that repeat an id
    follow each other in the order of their texts; a row with a null id has no
    place in the order, so an empty text follows it. Other columns are not read.

    One shuffle: ids are cut into ranges, and the first document of a range is
    also sent to the range before it, as a guest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.where("id is not null").select("id")
    n = ids.count()
    ranges = int(min(RANGES, max(1, n // RANGE_ROWS)))
    cuts = np.unique(ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)) if ranges > 1 else np.empty(0)

    @F.pandas_udf("int")
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, values.to_numpy(np.float64), "right")).astype("int32")

    # at most RANGES rows: the first document, in descending order, of each range
    first = {r["r"]: r["m"] for r in ids.groupBy(range_of("id").alias("r")).agg(F.max("id").alias("m")).collect()}
    order = sorted(first, reverse=True)
    host = {first[r]: before for r, before in zip(order, order[-1:] + order[:-1], strict=True)}

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts = pd.Series(host, dtype="float64")
        for f in frames:
            if not len(f):
                continue
            lone = f.pop("lone").to_numpy(bool)
            place = np.searchsorted(cuts, f["id"].to_numpy(np.float64), "right")
            f = f.assign(kind=np.where(lone, 2, 0), part=np.where(lone, np.arange(len(f)) % ranges, place), mark=[sketch(t).own.tobytes() for t in f["text"]])
            guests = f[f["id"].isin(hosts.index).to_numpy() & ~lone]
            yield f
            if len(guests):
                yield guests.assign(kind=1, part=guests["id"].map(hosts).astype("int64"))

    # no null may reach pandas, where it would make doubles of the ids: 0 stands for it, and kind 2 tells
    told = rows.select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), "text", F.col("id").isNull().alias("lone"))
    laid = told.mapInPandas(dealt, "id long, text string, kind int, part long, mark binary")
    w = Window.partitionBy("part").orderBy("kind", F.desc("id"), "text")
    real = F.col("kind") == 0
    both = laid.select(
        F.when(F.col("kind") < 2, F.col("id")).alias("id"), "kind", "text", "mark",
        F.when(real, F.lead("text").over(w)).alias("next"), F.when(real, F.lead("mark").over(w)).alias("next_mark"),
    ).where("kind <> 1")
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    both = both.withColumn(
        "edited",
        F.concat(F.expr("substring(text, 1, int(n_chars) - cut)"), F.expr("substring(coalesce(next, ''), 1, cut)")),
    )
    # whole texts are needed only where one of a pair is short (the edited text is never longer than the text)
    n_next = F.length(F.coalesce("next", F.lit("")))
    both = both.withColumn("own", F.when(F.least(F.length("edited"), n_next) < SHORT, F.col("text")))
    both = both.withColumn("after", F.when(F.least("n_chars", n_next) < SHORT, F.coalesce("next", F.lit(""))))
    both = both.select("id", "n_chars", "edited", "mark", "next_mark", "own", "after")

    @F.pandas_udf("fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    def compared(text: pd.Series, mark: pd.Series, next_mark: pd.Series, own: pd.Series, after: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b, o, n in zip(text, mark, next_mark, own, after, strict=True):
            a, b, e = Sketch(np.frombuffer(a, np.uint32), o), Sketch(np.frombuffer(b or b"", np.uint32), n), sketch(t)
            out.append((printed(a), printed(e), likeness(a, e), likeness(a, b)))
        return pd.DataFrame(out, columns=["fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return both.withColumn("c", compared("edited", "mark", "next_mark", "own", "after")).select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "c.*"
    )
