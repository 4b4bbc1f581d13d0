import random
from zlib import crc32

import numpy as np
import pytest

from voxpop.llm import packing as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("seed", range(40))
def test_plan_fills_bins_without_gaps(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 7, 10, 30, 64])
    counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(0, 12))}
    seen, bins = set(), {}
    for length, rank, n, first, offset in P.plan(counts, cap):
        for i in range(n):
            assert (length, rank + i) not in seen
            seen.add((length, rank + i))
            bins.setdefault(first + i, []).append((offset, length))
    assert seen == {(n, r) for n, c in counts.items() for r in range(c)}
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= cap
        assert sum(3 * n > cap for _, n in content) <= 2


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, rng.lognormal(5.5, 1, 50_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    bins = max(first + n for _, _, n, first, _ in P.plan(counts, 1024))
    assert bins <= 1.01 * lengths.sum() / 1024 + 1


def test_ids_equal_the_tokenizers_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += ["", " ", "<|endoftext|> a", "é😀　x", "a" * 5000, " " * 30_000 + "b", "\n" * 3000, "12345 don't\r\n\tx"]
    for t in texts:
        assert P.encoder()(t) == P.plain_encoder()(t)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x", None, None, None), (4, "word " * 4000, "en", "s", 0), (5, "a b", "", "", 0), (5, "a b", "", "", 0)],
])
def test_pack_round_trip(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "ids").withColumnRenamed("source", "length")
    cut, places = P.pack(docs)
    got = places.collect()
    assert places.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    blobs = {(r.doc_id, r.piece): np.frombuffer(r.ids, "<u4") for r in cut.collect()}
    for i, text, *_ in rows:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        ids = [*P.plain_encoder()(text or ""), 2]
        assert np.concatenate([blobs[i, k] for k in sorted({r.piece for r in own})]).tolist() == ids
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == crc32(part.tobytes()) and r.length <= 1024
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in full.values():
        assert [o for o, _ in sorted(content)] == np.cumsum([0, *[n for _, n in sorted(content)][:-1]]).tolist()
    unique = [r for r in rows if r[0] not in (None, 5)]
    cut2, places2 = P.pack(spark.createDataFrame(unique, SCHEMA))
    for r in P.sequences(cut2, places2).collect():
        assert len(r.ids) == 4 * sum(r.lengths) <= 4 * 1024
