"""MinHash near-duplicates with odd sketches (operator 2).

Every document becomes the set of its distinct word shingles. Equal sets are
one numbered node, so an id that repeats with different texts is one node per
set. The nodes carry 128 MinHash samples: 32 bands of
4 samples name the buckets in which candidates meet, and an odd sketch
(Mitzenmacher, Pagh and Pham 2014) folds the samples into a parity bitmap, so
that the population count of the XOR of two bitmaps estimates their similarity.
Pairs whose estimate is far below the threshold (over five standard
deviations) are dropped; all others are confirmed on the full shingle sets.

Buckets are never expanded into all their pairs. Confirmed links only have to
give the right components, so candidates are taken in three steps:

1. each bucket has a pseudo-random leader; a document is confirmed against the
   leader with the closest sketch;
2. the other (document, leader) pairs that still lie in different components;
3. all other pairs of one bucket that still lie in different components: a
   blocked self-join with at most ``BLOCK`` rows of a bucket on one side. Its
   condition compares set sizes, the sketches, and finer sketches of 2048
   samples that only these documents get, and lets a pair pass in its first
   common bucket only (told by 32 bits of its key, wrong once in 10^6 pairs at
   most). So groups of thousands of documents that resemble each
   other without being near-duplicates give few pairs.

After step 3 every banded pair that the sketches let pass is confirmed,
refused, or already connected, so no cap on buckets exists. A pair of
similarity 0.8 shares no bucket with probability (1 - 0.8^4)^32 < 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop.llm.common import connected_components, written
from voxpop.session import ship_package

BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
#: Samples and bits of the finer sketch.
FINE_SAMPLES, FINE_BITS = 2048, 8192
#: Rows of a bucket that one block of the self-join holds on average, at most.
BLOCK = 1000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, split at space and the control characters 9 to 13; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, size: int) -> frozenset:
    words = words_of(text)
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[j:] for j in range(size)), strict=False))


@lru_cache(maxsize=32)
def _recent(text: str | None, size: int) -> frozenset:
    return shingle_set(text, size)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    acc = _mix(h[:n] + np.uint64(size))
    for j in range(1, size):
        acc = _mix(acc * _GOLD + h[j : j + n])
    return np.unique(acc)


def _params(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return (
        rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
        rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32),
    )


def minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit minimum per hash function, in bounded blocks."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    step = max(1, 2**19 // len(a))
    for at in range(0, len(x), step):
        np.minimum(out, (x[None, at : at + step] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of the (position, value) samples, as 64-bit integers."""
    where = _mix(samples.astype(np.uint64) + np.arange(len(samples), dtype=np.uint64) * _GOLD) >> np.uint64(32)
    parity = np.bincount((where % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for column in samples.reshape(BANDS, ROWS).T.astype(np.uint64):
        acc = _mix(acc + column)
    return acc.view(np.int64)


def most_flips(percent: int, n: int, bits: int, deviations: float) -> int:
    """Population count of an XOR beyond which a pair is surely below the threshold.

    The number of samples in which a pair of that similarity differs is
    binomial; so many deviations more, each flipping two random bits, give the
    expected count.
    """
    t = percent / 100
    differ = n * (1 - t) + deviations * (n * t * (1 - t)) ** 0.5
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ)))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, mark (a hash of the text), n_shingles, set_key (null without words), bands array<long>, sketch array<long>."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _params(BANDS * ROWS)
        for batch in batches:
            n, key, bands, sketch = [], [], [], []
            for text in batch.column(2):
                h = shingle_hashes(words_of(text.as_py()), size)
                n.append(len(h))
                if len(h):
                    samples = minhash(h, a, b)
                    key.append(xxhash.xxh3_128_digest(h.tobytes()))
                    bands.append(band_keys(samples))
                    sketch.append(odd_sketch(samples))
                else:
                    key.append(None)
                    bands.append(np.empty(0, np.int64))
                    sketch.append(np.empty(0, np.int64))
            lists = [
                pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate(x or [[]]).astype(np.int64))
                for x in (bands, sketch)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), *lists],
                ["id", "mark", "n_shingles", "set_key", "bands", "sketch"],
            )

    ship_package(docs.sparkSession)
    return _marked(docs, id_col, text_col).mapInArrow(
        sign, "id long, mark long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"
    )


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): the mark tells the texts of a repeated id apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def fine_sketches(texts: DataFrame, size: int) -> DataFrame:
    """(id, size, fine array<long>) of rows (id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _params(FINE_SAMPLES)
        for batch in batches:
            n, found = [], []
            for text in batch.column(1):
                h = shingle_hashes(words_of(text.as_py()), size)
                n.append(len(h))
                found.append(odd_sketch(minhash(h, a, b), FINE_BITS))
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            fine = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, FINE_BITS // 64, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), fine], ["id", "size", "fine"])

    return texts.select("id", "text").mapInArrow(sign, "id long, size long, fine array<long>")


def _flips(a: str, b: str):
    """Population count of the XOR of two sketches, as one compiled expression."""
    out = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        out = out + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return out


def _fine_flips(a: str, b: str):
    """The same for the longer sketches, too long to be spelled out."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = _recent(x, size), _recent(y, size)
            both = len(x & y)
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").where(linked("ta", "tb")).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable by links (100 * intersection
    >= ``percent`` * union of the shingle sets), itself included; ``kept`` is
    whether it is the own id. Texts with fewer than ``size`` words count as one
    shingle. Null, empty and blank texts have no shingles and link with
    nothing. Links hold between texts: a row that repeats an id with another
    text has the class of its own text, whatever the order of the rows; a null id is never linked and is
    always kept (component_id null). Other columns of ``docs`` are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sig, _ = written(signatures(docs, id_col, text_col, size), "minhash")
    known = sig.where("id is not null and set_key is not null")
    reps = known.groupBy("set_key").agg(F.min("id").alias("rep"))
    # one row per distinct set, numbered once: the numbers are the nodes and stand as "id" up to the classes
    nodes = (
        known.join(reps, (known.id == reps.rep) & (known.set_key == reps.set_key), "left_semi")
        .dropDuplicates(["id", "set_key"])
        .select("set_key", F.col("id").alias("rep"), "mark", "bands", "sketch", F.monotonically_increasing_id().alias("node"))
    )
    nodes, _ = written(nodes, "nodes")
    first = nodes.select(F.col("node").alias("id"), "bands", "sketch")
    rows = first.select("id", F.explode("bands").alias("bucket"))
    # the smallest id XOR bucket is a pseudo-random member, and gives its id back
    leaders = (
        rows.groupBy("bucket")
        .agg(F.min(F.col("id").bitwiseXOR(F.col("bucket"))).alias("x"), F.count("*").alias("n"))
        .where("n > 1")
        .select("bucket", F.col("x").bitwiseXOR(F.col("bucket")).alias("leader"), "n")
    )
    members, _ = written(rows.join(leaders, "bucket"), "members")
    sketches = first.select("id", "sketch")
    limit = most_flips(percent, BANDS * ROWS, SKETCH_BITS, 6)

    star = members.where("id <> leader").select("id", "leader").distinct()
    star = (
        star.join(sketches.withColumnRenamed("sketch", "sa"), "id")
        .join(sketches.select(F.col("id").alias("leader"), F.col("sketch").alias("sb")), "leader")
        .withColumn("flips", _flips("sa", "sb"))
        .where(F.col("flips") <= limit)
        .select("id", "leader", "flips")
    )
    star, _ = written(star, "star")
    ids = members.select("id").distinct()
    texts, _ = written(
        _marked(docs, id_col, text_col)
        .join(nodes.join(ids, nodes.node == ids.id, "left_semi").select(F.col("rep").alias("id"), "mark", "node"), ["id", "mark"])
        .dropDuplicates(["node"])
        .select(F.col("node").alias("id"), "text"),
        "texts",
    )

    closest = star.groupBy("id").agg(F.min_by("leader", "flips").alias("leader"))
    pairs = closest.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    links, _ = written(_confirmed(pairs, texts, size, percent), "links")
    comps, _ = written(connected_components(links), "comps")

    def placed_pairs(df: DataFrame) -> DataFrame:
        """Pairs (a, b) with their components so far, ca and cb."""
        of = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        both = df.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))

    def apart(df: DataFrame) -> DataFrame:
        """The pairs (a, b) in different components so far."""
        return placed_pairs(df).where("ca <> cb").select("a", "b")

    def more(pairs: DataFrame) -> None:
        """Confirms pairs and merges the components, which are the nodes of a small graph."""
        nonlocal comps
        found, _ = written(_confirmed(pairs, texts, size, percent), "links")
        if found.isEmpty():
            return
        found = placed_pairs(found)
        merged = connected_components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        merged = merged.select(F.col("node").alias("component"), F.col("component").alias("_new"))
        named = comps.unionByName(found.select(F.col("a").alias("node"), F.col("ca").alias("component")))
        named = named.unionByName(found.select(F.col("b").alias("node"), F.col("cb").alias("component"))).distinct()
        named = named.join(merged, "component", "left").select("node", F.coalesce("_new", "component").alias("component"))
        comps, _ = written(named, "comps")

    more(apart(star.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()))

    # what is left: pairs of one bucket in different components, neither of them its leader
    placed = (
        members.where("n > 2 and id <> leader")
        .join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("bucket", "n", "id", F.coalesce("component", "id").alias("comp"))
    )
    # in most buckets one component is far the largest: only the other rows have to meet all rows
    held = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    held = held.groupBy("bucket").agg(F.max_by("comp", "c").alias("main"), F.count("*").alias("comps"))
    placed, _ = written(placed.join(held.where("comps > 1").select("bucket", "main"), "bucket"), "placed")
    if not placed.isEmpty():
        fine = fine_sketches(texts.join(placed.select("id").distinct(), "id", "left_semi"), size)
        short = F.transform("bands", lambda k: F.shiftright(k, 32).cast("int")).alias("keys")
        traits, _ = written(fine.join(first.select("id", short), "id"), "traits")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        named = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("id", "comp", "size", "fine", "keys")]
        rows = placed.join(traits, "id")
        left = rows.where("comp <> main").select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *named("a"))
        right = rows.select(
            "bucket", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), (F.col("comp") == F.col("main")).alias("b_main"), *named("b")
        )
        band = F.array_position("a_keys", F.shiftright("bucket", 32).cast("int")).cast("int")
        parts = FINE_BITS // SKETCH_BITS
        rest = left.join(right, ["bucket", "block"]).where(
            (F.col("b_main") | (F.col("a_id") < F.col("b_id")))
            & (F.col("a_comp") != F.col("b_comp"))
            & (100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))
            & (_flips("a_fine", "b_fine") <= most_flips(percent, FINE_SAMPLES // parts, SKETCH_BITS, 6))
            & ~F.arrays_overlap(F.slice("a_keys", F.lit(1), band - 1), F.slice("b_keys", F.lit(1), band - 1))
            & (_fine_flips("a_fine", "b_fine") <= most_flips(percent, FINE_SAMPLES, FINE_BITS, 5))
        )
        rest = rest.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
        rest, _ = written(rest, "rest")
        if not rest.isEmpty():
            more(rest)

    # a component is called by its smallest id, a set without links by its own
    placed_sets = nodes.select("set_key", "rep", "node").join(comps, "node", "left")
    least = placed_sets.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    classes = placed_sets.join(least, "component", "left").select("set_key", F.coalesce("least", "rep").alias("component_id"))
    out = sig.where("set_key is not null and id is not null").join(classes, "set_key").select("id", "n_shingles", "component_id")
    alone = sig.where("set_key is null or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the near-duplicates of a document with a smaller id.

    Rows that repeat an id stay or go together: they go when none of them is kept.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.groupBy(id_col).agg(F.bool_or("kept").alias("stays")).where("not stays").select(id_col)
    return docs.join(gone, id_col, "left_anti")
