"""Source divergence audit on a single-pass in-memory index (operator 11).

One pass over the texts builds block postings, counts by (lang, term, source)
and documents by (lang, term), until ``BLOCK`` of them fill the memory, then
spills them as a run: per hash shard of (lang, term) the terms in order, in
segments of about ``SEGMENT`` postings. Spark deals the segments by shard and
sorts them by their first term; the task of a shard merges them through a heap,
opening a segment only when the merge reaches its first term, so it holds about
one segment of each run. Out come whole terms with their postings, kept from a
number of documents on.

From a group's smoothed shares p and another's q, a term's divergence is
(p-q)^2 / (p+q) in whole numbers. Two sources differ by the sum over all kept
terms of their language, most of which occur in neither: the sum is the number
of terms times the value for two absent terms, plus corrections for the terms
that occur in one or both. Corrections stream from the postings into matrices
of ``WIDTH`` x ``WIDTH`` sources.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxpop.llm.common import rows_of, settled, summed, written
from voxpop.operators.ordering import top_k_within
from voxpop.session import drop_scratch

#: Postings and terms that a task holds before it spills a run, and postings of a segment.
BLOCK, NAMES, SEGMENT = 1_000_000, 200_000, 4096
#: Sources on a side of a matrix of corrections; postings of a cell and terms laid out at once.
WIDTH, CELL_ROWS, TERMS = 512, 200_000, 512
#: A term is kept from this number of a language's documents on.
MIN_DOCS = 10
SCALE = 1_000_000_000
#: Letters A-Z in lower case; every other byte up to 0x7F that is no letter ends a term.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split()


class Block:
    """Postings in memory: dictionaries number the terms of each lang, arrays hold (group, term) -> count.

    Group 0 stands for the documents of a term, the others for a (lang, source) each.
    """

    def __init__(self) -> None:
        numbers = count()
        self.ids: dict[bytes, dict[bytes, int]] = defaultdict(lambda: defaultdict(numbers.__next__))
        self.groups: dict[tuple[bytes, bytes], int] = {}
        self._texts: list[tuple[int, np.ndarray]] = []  # group and term numbers of texts not yet summed
        self._waiting = 0
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0  # postings, those of the parts counted once each

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        found = terms(text)
        group = self.groups.setdefault((lang, source), len(self.groups) + 1)
        self._texts.append((group, np.fromiter(map(self.ids[lang].__getitem__, found), np.int64, len(found))))
        self._waiting += len(found)
        if self._waiting >= 1 << 17:
            self._sum()

    def _sum(self) -> None:
        sizes = [len(t) for _, t in self._texts]
        ids = np.concatenate([t for _, t in self._texts])
        seen, n = summed(np.repeat(np.arange(len(sizes)) << 32, sizes) | ids, np.ones(len(ids), np.int64))
        ids, group = seen & 0xFFFFFFFF, np.array([g for g, _ in self._texts])[seen >> 32]
        self._parts.append(summed(np.r_[group << 32 | ids, ids], np.r_[n, np.ones(len(ids), np.int64)]))
        self._texts, self._waiting = [], 0
        if len(self._parts) > 3:  # all into one
            self._parts = [summed(*map(np.concatenate, zip(*self._parts, strict=True)))]
        self.held = sum(len(k) for k, _ in self._parts)

    def run(self, shards: int, size: int) -> Iterator[tuple]:
        """(shard, lang, a segment's columns): the terms of every shard in order, about ``size`` postings a segment."""
        if self._texts:
            self._sum()
        if not self.held:
            return
        keys, counts = summed(*map(np.concatenate, zip(*self._parts, strict=True)))
        langs = list(self.ids)
        words = [(i, w, n) for i, lang in enumerate(langs) for w, n in sorted(self.ids[lang].items())]
        start = [zlib.crc32(lang) for lang in langs]
        shard = np.array([zlib.crc32(w, start[i]) % shards for i, w, _ in words])
        order = np.argsort(shard, kind="stable")  # shard, lang, term
        place = np.empty(len(words), np.int64)
        place[np.array([n for _, _, n in words])[order]] = np.arange(len(words))
        source = [b"", *(s for _, s in self.groups)]
        at, group = place[keys & 0xFFFFFFFF], keys >> 32
        in_order = np.argsort(at * (len(source) + 1) + group)
        at, group, counts = at[in_order], group[in_order], counts[in_order]
        head = np.flatnonzero(group == 0)  # one per term, before its postings
        docs, bounds = counts[head], np.r_[head, len(group)]
        which = shard[order] * len(langs) + np.array([i for i, _, _ in words])[order]
        chunk = np.r_[True, (which[1:] != which[:-1])]
        first = np.flatnonzero(chunk)
        inside = bounds[:-1] - np.repeat(bounds[first], np.diff(np.r_[first, len(words)]))
        chunk[1:] |= inside[1:] // size != inside[:-1] // size
        cuts = np.r_[np.flatnonzero(chunk), len(words)].tolist()
        for x, y in pairwise(cuts):
            part = [words[o][1] for o in order[x:y]]
            of_segment = np.ones(bounds[y] - bounds[x], bool)
            of_segment[bounds[x:y] - bounds[x]] = False
            names, places = np.unique(group[bounds[x] : bounds[y]][of_segment], return_inverse=True)
            yield (
                int(which[x]) // len(langs), langs[int(which[x]) % len(langs)], part, docs[x:y], np.diff(bounds[x : y + 1]) - 1,
                places, counts[bounds[x] : bounds[y]][of_segment], [source[g] for g in names.tolist()],
            )


class Segment:
    """A part of a run: terms in order, their documents, their numbers of postings, and the postings: place in ``names`` and count."""

    def __init__(self, words: list[bytes], docs: np.ndarray, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray, names: list[bytes]):
        self.words, self.docs, self.sizes, self.places, self.counts, self.names = words, docs, sizes, places, counts, names
        self.starts = np.r_[0, np.cumsum(sizes)]


def merge(segments: Iterator[tuple[object, Segment]], min_docs: int) -> Iterator[tuple[object, bytes, list[bytes], list[int]]]:
    """Merges the segments (group, segment) of sorted runs, which come by group and first term: (group, term, sources,
    counts) of the terms in ``min_docs`` documents, in order. The heap holds the open segments by their next term; what
    lies below the first term of the segment to be opened is taken off together."""
    heap: list[tuple[bytes, int, int, Segment]] = []
    group, number, names = None, 0, {}

    def below(limit: bytes | None):
        taken = []
        while heap and (limit is None or heap[0][0] < limit):
            _, n, i, seg = heap[0]
            stop = len(seg.words) if limit is None else bisect_left(seg.words, limit, i)
            taken.append((seg, i, stop))
            if stop < len(seg.words):
                heapq.heapreplace(heap, (seg.words[stop], n, stop, seg))
            else:
                heapq.heappop(heap)
        if not taken:
            return
        words = [w for seg, i, stop in taken for w in seg.words[i:stop]]
        code = np.empty(len(words), np.int64)
        distinct, codes, last = [], [], None
        order = sorted(range(len(words)), key=words.__getitem__)  # of sorted runs: a merge
        for o in order:
            if words[o] != last:
                last = words[o]
                distinct.append(last)
            codes.append(len(distinct) - 1)
        code[order] = codes
        docs = np.zeros(len(distinct), np.int64)
        np.add.at(docs, code, np.concatenate([seg.docs[i:stop] for seg, i, stop in taken]))
        if not (docs >= min_docs).any():
            return
        of_posting = np.repeat(code, np.concatenate([seg.sizes[i:stop] for seg, i, stop in taken]))
        part = [slice(seg.starts[i], seg.starts[stop]) for seg, i, stop in taken]
        source = np.concatenate([
            np.array([names.setdefault(s, len(names)) for s in seg.names], np.int64)[seg.places[x]] for (seg, _, _), x in zip(taken, part, strict=True)
        ])
        counts = np.concatenate([seg.counts[x] for (seg, _, _), x in zip(taken, part, strict=True)])
        kept = docs[of_posting] >= min_docs
        keys, counts = summed(of_posting[kept] << 32 | source[kept], counts[kept])
        known = list(names)
        sources, counts = [known[i] for i in (keys & 0xFFFFFFFF).tolist()], counts.tolist()
        keys >>= 32
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for t, x, y in zip(keys[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            yield group, distinct[t], sources[x:y], counts[x:y]

    for g, seg in segments:
        if g != group:
            yield from below(None)
            group, names = g, {}
        elif heap and heap[0][0] < seg.words[0]:
            yield from below(seg.words[0])
        heapq.heappush(heap, (seg.words[0], number, 0, seg))
        number += 1
    yield from below(None)


_SEGMENT = "shard int, lang binary, terms array<binary>, docs array<long>, sizes array<long>, source array<long>, count array<long>, names array<binary>"


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, str]:
    """Index of ``docs(lang, source, text)``, no nulls: (lang, term, number, sources, counts) of every term in ``min_docs`` documents
    of its lang, and the path of that table. ``number`` is unique; ``sources`` are distinct."""
    spark = docs.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, names = pa.list_(pa.int64()), pa.list_(pa.binary())
        schema = pa.schema(zip(
            ["shard", "lang", "terms", "docs", "sizes", "source", "count", "names"],
            [pa.int32(), pa.binary(), names, longs, longs, longs, longs, names], strict=True,
        ))
        block = Block()
        for rows in rows_of(batches):
            for row in rows:
                block.add(*row)
                if block.held >= BLOCK or sum(map(len, block.ids.values())) >= NAMES:
                    yield from _batches(block.run(shards, SEGMENT), schema, 6)
                    block = Block()
        yield from _batches(block.run(shards, SEGMENT), schema, 6)

    as_bytes = [F.col(c).cast("binary").alias(c) for c in ("lang", "source", "text")]
    runs, runs_path = written(docs.select(*as_bytes).mapInArrow(blocks, _SEGMENT), "spimi-runs")
    out = pa.schema([
        ("lang", pa.binary()), ("term", pa.binary()), ("number", pa.int64()),
        ("sources", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
    ])

    def whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments():
            for b in batches:
                lists = [b.column(i).to_pylist() for i in (0, 1, 2, 7)]
                arrays = [[x.values.to_numpy() for x in b.column(i)] for i in (3, 4, 5, 6)]
                for shard, lang, words, names, docs, sizes, places, counts in zip(*lists, *arrays, strict=True):
                    yield (shard, lang), Segment(words, docs, sizes, places, counts, names)

        def kept():
            number = TaskContext.get().partitionId() << 33
            for (_, lang), term, sources, counts in merge(segments(), min_docs):
                yield lang, term, number, sources, counts
                number += 1

        yield from _batches(kept(), out, 4)

    dealt = runs.repartition("shard").sortWithinPartitions("shard", "lang", F.element_at("terms", 1))
    table = dealt.mapInArrow(whole_terms, "lang binary, term binary, number long, sources array<binary>, counts array<long>")
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "term")]
    table, path = written(table.select(*text, "number", F.col("sources").cast("array<string>").alias("sources"), "counts"), "spimi-terms")
    drop_scratch(spark, runs_path)
    return table, path


def _batches(rows: Iterator[tuple], schema: pa.Schema, at: int) -> Iterator[pa.RecordBatch]:
    """Batches of about 16 segments' postings; column ``at`` tells how many a row has."""

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 16 + len(row[at])
        if size >= 32_768:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _share(count: str, total: str):
    """1 + floor(SCALE * (count + 2) / total); the product may pass 64 bits."""
    wide = f"cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))"
    return F.expr(f"1 + ({wide}) div cast({total} as decimal(20,0))")


_F = "((p - q) * (p - q)) div (p + q)"


def corrections(key: tuple, postings: pd.DataFrame, shares: pd.DataFrame, width: int, terms: int) -> pd.DataFrame:
    """Sums over the terms of one cell of f(term) - f(absent in both), by pair of sources.

    ``key``: lang, block of rows, block of columns, salt. ``postings(number, idx, p, in_rows, in_cols)``,
    ``shares(idx, p0)``: shares of absent terms of all sources in both blocks (of
    ``width``). ``terms`` are laid out at once. A term that occurs in
    both sources of a pair counts once, in the row of the smaller index.
    """
    lang, a, b, _ = key
    p0 = shares.drop_duplicates("idx").set_index("idx")["p0"].sort_index()
    rows, cols = (p0[(p0.index >= x * width) & (p0.index < (x + 1) * width)] for x in (a, b))
    base = divergence(rows.to_numpy()[:, None], cols.to_numpy()[None, :])
    total = np.zeros_like(base)
    postings = postings.sort_values("number", kind="stable")
    number = postings["number"].to_numpy()
    at = np.cumsum(np.r_[False, number[1:] != number[:-1]]) if len(number) else np.empty(0, np.int64)
    idx, p = postings["idx"].to_numpy(), postings["p"].to_numpy()
    in_rows, in_cols = postings["in_rows"].to_numpy(bool), postings["in_cols"].to_numpy(bool)
    for t in range(0, int(at[-1]) + 1 if len(at) else 0, terms):
        part = slice(*np.searchsorted(at, [t, t + terms]))
        own, i, value, r, c = at[part] - t, idx[part], p[part], in_rows[part], in_cols[part]
        across = np.tile(cols.to_numpy(), (terms, 1))
        across[own[c], i[c] - b * width] = value[c]
        there = np.zeros(across.shape, bool)
        there[own[c], i[c] - b * width] = True
        own, i, value = own[r], i[r], value[r]
        for s in range(0, len(own), 2 * terms):
            o, j, v = own[s : s + 2 * terms], i[s : s + 2 * terms], value[s : s + 2 * terms]
            d = divergence(v[:, None], across[o]) - base[j - a * width]
            d[there[o] & (cols.index.to_numpy()[None, :] <= j[:, None])] = 0
            order = np.argsort(j, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(j[order]) != 0])
            total[j[order][first] - a * width] += np.add.reduceat(d[order], first, axis=0)
    x, y = np.nonzero(total)
    return pd.DataFrame({"lang": lang, "x": rows.index.to_numpy()[x], "y": cols.index.to_numpy()[y], "c": total[x, y]})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, min_docs: int = MIN_DOCS, top: int = 10) -> DataFrame:
    """How sources of a language differ: (lang, source, part, item, value, rank).

    Part ``pair`` lists for every (lang, source) all other sources of the lang by
    divergence, part ``term`` the ``top`` kept terms that it uses more than its
    lang does. Null lang, source and text count as ''. A group without terms has
    the shares of absent terms; a lang without kept terms has pairs of value 0 and no
    term rows. Repeated rows count each time; ties rank by item; an empty table
    gives an empty result. Other columns are not read.

    The result is a table written to the shared checkpoint folder.
    """
    blank = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*blank)
    index, path = frequencies(docs, min_docs)
    in_lang = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    known = index.select("lang", "term", "number", in_lang.alias("lang_count"), F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    known = known.select("lang", "term", "number", "lang_count", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    langs = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum(in_lang).alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(known.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + 2 * F.col("v")).alias("total"),
        (F.col("lang_n") + 2 * F.col("v")).alias("lang_total"),
    )
    # the output holds a row for every two sources of a lang, so numbering those of one lang in one task is small beside it
    groups = groups.withColumn("idx", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share("0L", "total"))).withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / WIDTH))
    groups, groups_path = written(groups, "spimi-groups")

    shared = known.join(groups, ["lang", "source"]).withColumn("p", _share("count", "total"))

    own = shared.withColumn("q", _share("lang_count", "lang_total")).where("p > q").withColumn("value", F.expr(_F))
    own = top_k_within(own.select("lang", "source", F.col("term").alias("item"), "value"), ["lang", "source"], [F.desc("value"), F.asc("item")], top, "item")

    size = index.agg(F.sum(F.size("sources"))).first()[0] or 0
    salts = max(1, math.ceil(size / CELL_ROWS))
    block = F.floor(F.col("idx") / WIDTH)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    cells = F.transform(every, lambda o: F.struct(block.alias("a"), o.alias("b"), F.lit(True).alias("in_rows"), (o == block).alias("in_cols")))
    mirror = F.transform(
        F.filter(every, lambda o: o != block),
        lambda o: F.struct(o.alias("a"), block.alias("b"), F.lit(False).alias("in_rows"), F.lit(True).alias("in_cols")),
    )
    keys = ["lang", "a", "b", "salt"]
    postings = shared.select("lang", "number", "idx", "p", F.pmod("number", F.lit(salts)).alias("salt"), F.explode(F.concat(cells, mirror)).alias("x"))
    postings = postings.select("lang", "number", "idx", "p", "salt", "x.*")
    shares = groups.where("p0 is not null").select("lang", "idx", "p0", F.explode(F.concat(cells, mirror)).alias("x"))
    shares = shares.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    # aliases: both sides of the cogroup come from one table
    shares = shares.select(*[F.col(c).alias(c.split(".")[-1]) for c in ("lang", "idx", "p0", "salt", "x.a", "x.b")])
    width, at_once = WIDTH, TERMS

    def fixed(key, left, right):
        return corrections(key, left, right, width, at_once)

    fixes = postings.groupBy(*keys).cogroup(shares.groupBy(*keys)).applyInPandas(fixed, "lang string, x long, y long, c long")
    fixes = fixes.groupBy("lang", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.sum("c").alias("c"))

    left = groups.select("lang", "source", "v", F.col("idx").alias("x"), F.col("p0").alias("p"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("y"), F.col("p0").alias("q"))
    pairs = left.join(right, "lang").where("x <> y").withColumn("lo", F.least("x", "y")).withColumn("hi", F.greatest("x", "y"))
    pairs = pairs.join(fixes, ["lang", "lo", "hi"], "left")
    value = F.coalesce(F.col("v") * F.expr(_F) + F.coalesce("c", F.lit(0)), F.lit(0)).cast("long")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", rank)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return settled(columns(pairs, "pair").unionByName(columns(own, "term")), "divergence", path, groups_path)
