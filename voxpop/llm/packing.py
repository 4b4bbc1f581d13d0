"""Best-fit packing with large-item matching (operator 4).

Documents become token ids and are packed into sequences of ``CAPACITY``
tokens. Only longer documents are cut: full pieces from the end, so that the
first piece takes the remainder.

How a piece is packed depends on its length alone, so the plan is made from
the histogram of lengths, at most ``CAPACITY`` counts whatever the size of the
corpus. Pieces longer than a third of the capacity fit at most twice into a
bin and are matched greedily, the longest with the longest that still fits;
shorter pieces then best-fit the remaining gaps in decreasing length, and
what is left over opens new bins. The plan says for each range of ranks among
the pieces of one length to which bins and offsets it goes; its size is
bounded by the capacity too, and it is broadcast.

Ranks are numbered without a large group: pieces of one length are split into
hashed buckets, counted, and numbered inside their bucket.

The ids are those of the library ``tokenizers`` with the vocabulary
``byte_bpe_50k.json``. They are computed with ``tiktoken`` on the same
vocabulary (``byte_bpe_50k.tiktoken``), five times as fast; a test holds both
against each other.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxpop.llm.common import written
from voxpop.session import ship_package

CAPACITY = 1024
END = 2
#: Pieces of one length that a numbering bucket holds on average, at most.
BUCKET = 100_000
VOCABULARY = "byte_bpe_50k"


#: tiktoken's pattern runs out of stack in white space far longer than this; tokenizers' doesn't.
_LONG_GAP = re.compile(r"\s{2000}")


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY) -> Callable[[str], list[int]]:
    """A function text -> list of ids, of a vocabulary in the installed public tokenizers, as the library gives them: its special strings are ids of their own."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    plain = plain_encoder(name)

    def encode(text: str) -> list[int]:
        if any(s in text for s in plain.special) or len(text) >= 2000 and _LONG_GAP.search(text):
            return plain(text)
        return fast(text)

    return encode


@lru_cache(maxsize=4)
def plain_encoder(name: str = VOCABULARY) -> Callable[[str], list[int]]:
    """The same by ``tokenizers``."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    def encode(text: str) -> list[int]:
        return t.encode(text, add_special_tokens=False).ids

    encode.special = [a.content for a in t.get_added_tokens_decoder().values()]
    return encode


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens: full pieces at the end, the remainder first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, start, length, ids): the pieces of every document, ids as little-endian unsigned 32-bit integers.

    A null or empty text is one piece with the end id alone. Rows that repeat
    an id, and rows with a null id, are documents like others.
    """
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            names, numbers, starts, lengths, blobs = [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for k, (start, length) in enumerate(cut_lengths(len(ids), capacity)):
                    names.append(name)
                    numbers.append(k)
                    starts.append(start)
                    lengths.append(length)
                    blobs.append(ids[start : start + length].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())],
                [id_col, "piece", "start", "length", "ids"],
            )

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(
        cut, f"`{id_col}` long, piece int, start long, length long, ids binary"
    )


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, bins, first bin, offset) for the pieces counted by length.

    Pieces of the length with ranks from ``first rank`` on go one each to
    ``bins`` bins from ``first bin`` on, at ``offset``. Bins with the same
    content are one group, so the work depends on the capacity only.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups (first bin, bins)
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        slots.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def group(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1  # the longest that fits beside it
        while at >= 0 and not (left[large[at]] - (large[at] == a) > 0):
            at -= 1
        if at < 0:
            n, fill = left[a], a
            put(a, n, bins, 0)
        else:
            b = large[at]
            n, fill = (left[a] // 2 if a == b else min(left[a], left[b])), a + b
            put(a, n, bins, 0)
            put(b, n, bins, a)
        group(capacity - fill, bins, n)
        bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= s):
            each = gap // s  # the tightest gap stays the tightest until no more fits
            waiting = gaps.pop(gap)
            while waiting and left[s]:
                first, n = waiting.pop()
                full = min(n, left[s] // each)
                for k in range(each if full else 0):
                    put(s, full, first, capacity - gap + k * s)
                group(gap - each * s, first, full)
                if full < n and 0 < left[s] < each:
                    rest = left[s]
                    for k in range(rest):
                        put(s, 1, first + full, capacity - gap + k * s)
                    group(gap - rest * s, first + full, 1)
                    full += 1
                if full < n:
                    waiting.append((first + full, n - full))
            if waiting:
                gaps.setdefault(gap, []).extend(waiting)
            if not left[s]:
                break
        each = capacity // s
        while left[s]:
            n, k = (left[s] // each, each) if left[s] >= each else (1, left[s])
            for j in range(k):
                put(s, n, bins, j * s)
            group(capacity - k * s, bins, n)
            bins += n
    return slots


def place(rows: DataFrame, *, key: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with a column ``length`` from 1 to ``capacity``) with sequence_id and offset.

    ``rows`` is read twice (to count and to number), so give a written table.
    Rows that repeat a key are packed one by one. An empty table gives an empty
    result; a length beyond the capacity is an error.
    """
    spark = rows.sparkSession
    ship_package(spark)
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` numbers
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(slots)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = shared.value
        lo = np.searchsorted(s[:, 0] * 2**40 + s[:, 1], length.to_numpy() * 2**40 + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": s[lo, 3] + rank.to_numpy() - s[lo, 1], "offset": s[lo, 4]})

    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    before = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = before.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select(F.col("length").alias("_length"), F.col("_bucket").alias("_b"), F.coalesce("_before", F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*key)) - 1
    ranked = dealt.withColumn("_rank", number.cast("long")).join(
        before, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b"))
    )
    return ranked.withColumn("_at", placed("length", F.col("_rank") + F.col("_before"))).select(
        *rows.columns, "_at.sequence_id", "_at.offset"
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Tokenises, cuts and packs: the written pieces with their ids, and the place of each piece.

    The second table is (id, piece, start, length, ids_crc32, sequence_id,
    offset); the ids stay where they were written until :func:`sequences`
    brings them together.
    """
    cut, _ = written(pieces(docs, id_col, text_col, capacity=capacity, vocabulary=vocabulary), "pieces")
    light = cut.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return cut, place(light, key=(id_col, "piece"), capacity=capacity)


def sequences(cut: DataFrame, places: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences (sequence_id, ids, lengths): ids of all pieces in the order of their offsets.

    A sequence holds at most the capacity, so no group is large. ``id_col``
    must be unique here.
    """
    both = places.select(id_col, "piece", "sequence_id", "offset").join(cut, [id_col, "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return both.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
        F.col("p.length").alias("lengths"),
    )
