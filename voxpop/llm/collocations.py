"""Phrase collocations by broadcast double-array tries (operator 12).

One pass counts words; a phrase can only be frequent if all its words are, so
texts are then written once as the numbers of their frequent words, with a
gap (-1) for any other word and between pieces. Level by level a double-array
trie of the candidates of that length is broadcast, and numpy advances the
states of all text positions at once, one word a step. Accepting states are
binned to the candidates' counts; where a candidate is followed by a frequent
word, the longer phrase is sighted, and those sighted often enough are the
candidates of the next level (Apriori: every prefix and word of a frequent
phrase is frequent). Spark sums the counts of all tasks.

A broadcast holds at most ``SHARD`` phrases, or ``WORDS`` words: larger sets are
cut by hash into shards with a pass each, whose counts are summed alike.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop.llm.common import rows_of, settled, summed, written
from voxpop.operators.ordering import top_k_within
from voxpop.session import drop_scratch

#: Most words of a phrase, and occurrences from which on it is a candidate.
LONGEST, MIN_COUNT = 4, 30
#: Words of a dictionary and phrases of a trie that are broadcast at once.
WORDS, SHARD = 500_000, 500_000
#: Distinct words or phrases that a task holds before it hands their counts on.
HELD = 300_000
#: Text positions that advance at once.
STEP = 1 << 18
SCORE = 2_000_000
#: Share of its occurrences (per cent) within one longer candidate from which on a candidate is dropped.
INSIDE = 80
UNKNOWN = "und"
#: A-Z in lower case; the signs .,;:!? and 0A-0D end a piece, space and tab a word.
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]


def pieces(text: bytes) -> list[list[bytes]]:
    """Words of the pieces of a UTF-8 text."""
    return [p.split() for p in text.translate(_FOLD).split(b"\n")]


class DoubleArray:
    """A trie of phrases of one length over numbers, in two arrays.

    The child of state s by symbol c is base[s] + c if check[base[s] + c] = s.
    State 0 is the root. Symbols are places in ``symbols``, the sorted numbers
    that occur; ``accept`` maps the states of whole phrases to their rows.
    """

    def __init__(self, phrases: np.ndarray, seed: int = 0):
        """``phrases``: distinct rows of numbers from 0 on."""
        self.phrases = phrases[np.lexsort(phrases.T[::-1])].astype(np.int32)
        self.symbols, codes = np.unique(self.phrases, return_inverse=True)
        codes = codes.reshape(self.phrases.shape)
        n, depth = codes.shape
        width = len(self.symbols)
        low = width + 1  # slots below belong to the root, so no base is negative
        size = low + 2 * n * depth + 2 * width + 64
        used = np.zeros(size, bool)
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        rng = np.random.default_rng(seed)

        def grow(more: int) -> None:
            nonlocal used
            used = np.r_[used, np.zeros(more, bool)]
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int32)], np.r_[self.check, np.full(more, -1, np.int32)]

        state = np.zeros(n, np.int64)  # of every phrase's prefix
        self.base[0] = 1
        for j in range(depth):
            symbol = codes[:, j]
            new = np.r_[True, (state[1:] != state[:-1]) | (symbol[1:] != symbol[:-1])] if n else np.empty(0, bool)
            parent, label = state[new], symbol[new]
            if j:
                first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
                sizes = np.diff(np.r_[first, len(parent)])
                for x in np.argsort(-sizes, kind="stable"):
                    if sizes[x] == 1:
                        break  # the rest take any free slot
                    row = label[first[x] : first[x] + sizes[x]]
                    while True:
                        tries = rng.integers(low, len(used) - width, 16)
                        fits = np.flatnonzero(~used[tries[:, None] + row].any(1))
                        if len(fits):
                            break
                        grow(len(used) // 2)
                    at = tries[fits[0]]
                    self.base[parent[first[x]]] = at
                    used[at + row] = True
                single = first[sizes == 1]
                if (~used[low : len(used) - width]).sum() < len(single):
                    grow(len(single) + width)
                free = low + np.flatnonzero(~used[low : len(used) - width])[: len(single)]
                self.base[parent[single]] = free - label[single]
                used[free] = True
            child = self.base[parent] + label
            self.check[child] = parent
            state = child[np.cumsum(new) - 1]
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[state] = np.arange(n)

    def walk(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a phrase starts, and its row. ``text`` holds numbers, -1 where none may pass."""
        symbol = np.searchsorted(self.symbols, text).clip(max=max(len(self.symbols) - 1, 0))
        symbol[self.symbols[symbol] != text] = -1
        at = np.flatnonzero(symbol >= 0)
        state = np.zeros(len(at), np.int64)
        for j in range(self.phrases.shape[1]):
            inside = at + j < len(text)
            at, state = at[inside], state[inside]
            step = symbol[at + j]
            child = self.base[state] + step
            ok = (step >= 0) & (self.check[child] == state)
            at, state = at[ok], child[ok]
        return at, self.accept[state]


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n), bytes, of ``docs(lang, text)``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed():
            for lang, found in held.items():
                words = list(found)
                for i in range(0, len(words), 100_000):
                    part = words[i : i + 100_000]
                    columns = [pa.array([lang] * len(part), pa.binary()), pa.array(part, pa.binary()), pa.array([found[w] for w in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

        held: dict[bytes, Counter] = defaultdict(Counter)
        for rows in rows_of(batches):
            for lang, text in rows:
                held[lang].update(text.translate(_FOLD).split())
                if sum(map(len, held.values())) > HELD:
                    yield from handed()
                    held.clear()
        yield from handed()

    # summed within tasks already: dealt before Spark's own sums, which then need no pass on the near side
    counts = docs.mapInArrow(counted, "lang binary, word binary, n long").repartition("lang", "word")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """A written table with a column ``code``: 0, 1, 2, ... in the order of its files."""
    placed = words.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count("*")).collect())  # one row per file split
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    starts = words.sparkSession.createDataFrame(starts, "_part long, _start long")
    placed = placed.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn("code", (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int")).drop("_at", "_part", "_start")


def as_codes(docs: DataFrame, words: DataFrame, n_words: int) -> tuple[DataFrame, str]:
    """``docs(lang, text)`` as ``codes``, 32-bit numbers of the ``words(lang, word, code)`` with -1 for others and between pieces.

    One pass for every ``WORDS`` words.
    """
    spark, path = docs.sparkSession, None
    table = docs.withColumn("codes", F.lit(None).cast("binary"))
    for low in range(0, max(n_words, 1), WORDS):
        chunk = words.where((F.col("code") >= low) & (F.col("code") < low + WORDS)).select("lang", "word", "code").toArrow()
        of_lang: dict[bytes, dict[bytes, int]] = defaultdict(dict)
        for lang, word, code in zip(*(c.to_pylist() for c in chunk.columns), strict=True):
            of_lang[lang][word] = code
        shared = spark.sparkContext.broadcast(dict(of_lang))
        last = low + WORDS >= n_words
        kept, kept_path = written(table.mapInArrow(_spell(shared, last), "codes binary" if last else "lang binary, text binary, codes binary"), "phrase-codes")
        shared.destroy()
        if path:
            drop_scratch(spark, path)
        table, path = kept, kept_path
    return table, path


def _spell(shared: Broadcast, last: bool):
    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            out = []
            for lang, text, before in rows:
                known = shared.value.get(lang, {})
                codes = []
                for words in pieces(text):
                    codes += [known.get(w, -1) for w in words]
                    codes.append(-1)
                codes = np.array(codes, np.int32)
                if before is not None:
                    codes = np.maximum(codes, np.frombuffer(before, np.int32))
                out.append(codes.tobytes())
            out = pa.array(out, pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([out], ["codes"])
            else:
                kept = [pa.array([r[j] for r in rows], pa.binary()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, out], ["lang", "text", "codes"])

    return spelled


def _laid(batches: Iterator[pa.RecordBatch], depth: int, step: int) -> Iterator[tuple[np.ndarray, int]]:
    """The texts one after the other in arrays of about ``step`` numbers, and how many positions of each are its own: the
    last ones of a cut text are there again, for phrases across the cut."""
    gap, held, size = np.full(1, -1, np.int32), [], 0
    for rows in rows_of(batches):
        for (codes,) in rows:
            text = np.frombuffer(codes, np.int32)
            while len(text) > step:
                yield text[: step + depth], step
                text = text[step:]
            held += [text, gap]
            size += len(text) + 1
            if size >= step:
                yield np.concatenate(held), size
                held, size = [], 0
    if held:
        yield np.concatenate(held), size


def _level(shared: Broadcast, longer: bool):
    """Counts the trie's phrases and, with ``longer``, the phrases of one frequent word more that are sighted: (key, n), the
    row of the phrase in the trie shifted by 32, and the next word's number, 0xFFFFFFFF for none."""
    limit, step = HELD, STEP  # bound here: tasks see the driver's values

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: DoubleArray = shared.value
        n, depth = trie.phrases.shape
        totals, parts, held = np.zeros(n, np.int64), [], 0

        def handed(keys, counts):
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), pa.array(counts[i : i + 200_000])], ["key", "n"])

        for text, own in _laid(batches, depth, step):
            at, row = trie.walk(text)
            mine = at < own
            at, row = at[mine], row[mine]
            totals += np.bincount(row, minlength=n)
            if longer:
                inside = at + depth < len(text)
                after, row = text[at[inside] + depth], row[inside]
                keys = row[after >= 0].astype(np.int64) << 32 | after[after >= 0]
                parts.append(summed(keys, np.ones(len(keys), np.int64)))
                held += len(parts[-1][0])
                if held > limit:
                    parts = [summed(*map(np.concatenate, zip(*parts, strict=True)))]
                    held = len(parts[0][0])
                    if held > limit // 2:
                        yield from handed(*parts.pop())
                        held = 0
        if parts:
            yield from handed(*summed(*map(np.concatenate, zip(*parts, strict=True))))
        there = np.flatnonzero(totals)
        yield from handed(there << 32 | 0xFFFFFFFF, totals[there])

    return counted


def _words_of(shared: Broadcast):
    """The keys of :func:`_level` as the words' numbers, -1 beyond the last."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value.phrases
        depth = phrases.shape[1]
        for batch in batches:
            keys = batch.column(0).to_numpy()
            rows = np.full((len(keys), LONGEST + 1), -1, np.int32)
            rows[:, :depth] = phrases[keys >> 32]
            rows[:, depth] = (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            columns = [pa.array(np.ascontiguousarray(rows[:, j])) for j in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], [*_COLUMNS, "n"])

    return told


def count_phrases(codes: DataFrame, n_words: int, min_count: int = MIN_COUNT) -> tuple[DataFrame, list[str]]:
    """(c, n) of all phrases of 2 to ``LONGEST`` frequent words that occur ``min_count`` times; ``c`` is the array of their numbers."""
    spark = codes.sparkSession
    words = spark.range(n_words).select(F.col("id").cast("int").alias("w1"), *[F.lit(-1).alias(c) for c in _COLUMNS[1:]])
    level, size, found, paths = words, n_words, [], []
    schema = ", ".join(f"{c} int" for c in _COLUMNS) + ", n long"
    for depth in range(1, LONGEST + 1):
        shards = math.ceil(size / SHARD)
        tallies = []
        for shard in range(shards):
            mine = F.pmod(F.xxhash64(*_COLUMNS), F.lit(shards)) == shard
            rows = level.where(mine).select(*_COLUMNS[:depth]).toArrow()
            if not rows.num_rows:
                continue
            trie = DoubleArray(np.column_stack([c.to_numpy() for c in rows.columns]))
            shared = spark.sparkContext.broadcast(trie)
            part = codes.mapInArrow(_level(shared, depth < LONGEST), "key long, n long").repartition("key")
            part = part.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
            tally, path = written(part.mapInArrow(_words_of(shared), schema), "phrase-tally")
            shared.destroy()
            tallies.append(tally)
            paths.append(path)
        if not tallies:
            break
        tally = tallies[0]
        for other in tallies[1:]:
            tally = tally.unionByName(other)
        long_enough = F.col(_COLUMNS[depth]) >= 0 if depth < LONGEST else F.lit(False)
        if depth > 1:
            found.append(tally.where(~long_enough))
        level = tally.where(long_enough)
        size = level.count() if depth < LONGEST else 0
    if not found:
        found = [words.where("false").withColumn("n", F.lit(0).cast("long"))]
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every.select(F.filter(F.array(*_COLUMNS), lambda x: x >= 0).alias("c"), "n"), paths


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, min_count: int = MIN_COUNT, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of every lang: (lang, rank, phrase, a, l, r, n, score).

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut
    (the first of equal ones), ``n`` all words of the lang; the score is
    floor(SCORE * a / (l + r)). A candidate that lies inside a longer one with
    ``INSIDE`` per cent of its count or more is dropped. Null langs count as
    ``UNKNOWN``, null texts as empty; repeated rows count each time; ties rank by
    phrase; an empty table gives an empty result. Other columns are not read.

    The result is a table written to the shared checkpoint folder.
    """
    docs = docs.select(
        F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).cast("binary").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    counted, all_path = written(count_words(docs), "phrase-all-words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent, frequent_path = written(counted.where(F.col("n") >= min_count), "phrase-words")
    words, words_path = written(numbered(frequent), "phrase-words")
    n_words = words.count()
    codes, codes_path = as_codes(docs, words, n_words)
    phrases, paths = count_phrases(codes, n_words, min_count)

    known = phrases.unionByName(words.select(F.array("code").alias("c"), "n"))
    cuts = phrases.select("c", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("c") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(c, 1, k)")).withColumn("right", F.expr("slice(c, k + 1, size(c) - k)"))
    cuts = cuts.join(known.select(F.col("c").alias("left"), F.col("n").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("c").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr(f"(cast({SCORE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("c", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("c", "a", "x.*")

    size = F.size("c")
    starts = F.expr(
        "flatten(transform(sequence(2, size(c) - 1), m -> transform(sequence(1, size(c) - m + 1), i -> slice(c, i, m))))"
    )
    inner = phrases.where(size > 2).select(F.explode(starts).alias("c"), "n").groupBy("c").agg(F.max("n").alias("most"))
    stay = scored.join(inner, "c", "left").where(F.expr(f"most is null or 100 * most < {INSIDE} * a"))
    spelled = stay.select("*", F.posexplode("c").alias("i", "code")).join(words.select("code", "lang", "word"), "code")
    spelled = spelled.groupBy("c", "a", "l", "r", "score", "lang").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("s"))
    phrase = F.array_join(F.transform("s", lambda x: x["word"].cast("string")), " ")
    spelled = spelled.join(totals, "lang").select(F.col("lang").cast("string").alias("lang"), phrase.alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")
    best = top_k_within(spelled, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    best = best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return settled(best, "collocations", all_path, frequent_path, words_path, codes_path, *paths)
