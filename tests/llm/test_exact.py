import hashlib
import random

import pytest

from voxpop.llm import exact

SCHEMA = "doc_id long, text string, ref long, id string, keep_id string, `group` int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y", 1) for i, t in rows], SCHEMA)


def brute(rows, largest=True):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_trie_against_a_dict():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(3000)] + [b"a" * 100_000, b"a" * 99_999 + b"b", b""]
    trie, seen = exact.Patricia(), {}
    for k in keys:
        node = trie.terminal(k)
        assert (node.value or 0) == seen.get(k, 0)
        node.value = seen[k] = seen.get(k, 0) + 1
    assert trie.held <= sum(map(len, set(keys)))
    popped = dict(trie.pop(trie.heaviest()))
    assert popped and len({k[:1] for k in popped}) == 1
    rest = dict(trie.clear())
    assert {**popped, **rest} == seen and not popped.keys() & rest.keys() and trie.held == 0


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("budget", [64 << 20, 40])
def test_against_brute_force(spark, monkeypatch, largest, budget):
    monkeypatch.setattr(exact, "TRIE_BYTES", budget)  # the small one spills all the time
    rng = random.Random(2)
    words = ["Ab", "aB", "é", "É", "x", "", "\x00", " ", "\n", "ﬀ", "K"]
    rows = [(i, "".join(rng.choices(words, k=rng.randrange(4)))) for i in range(600)]
    rows += [(1000 + i, "Hot Text" * 50) for i in range(300)] + [(2000, None), (2001, ""), (2002, "w" * 300_000), (2003, "W" * 300_000)]
    rng.shuffle(rows)
    got = exact.exact_duplicates(frame(spark, rows).repartition(7), keep="largest" if largest else "smallest")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert result(got) == brute(rows, largest)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


def test_a_hash_alone_makes_nothing_equal():
    trie = exact.Patricia()
    for i, t in enumerate([b"ab", b"cd", b"ab", b"ce", b"cd"]):  # the second pass would hold them in one group if their hashes met
        node = trie.terminal(t)
        node.value = [*(node.value or []), i]
    assert dict(trie.clear()) == {b"ab": [0, 2], b"cd": [1, 4], b"ce": [3]}


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (5, "B"), (5, "b"), (2**60 + 1, "c"), (2**60 + 3, "C"), (7, None)]
    got = exact.exact_duplicates(frame(spark, rows).repartition(3))
    assert result(got) == brute(rows)
    kept = [(r.doc_id, r.text_sha256) for r in got.where("kept").collect()]
    assert len(kept) == len(set(kept)) == 4  # one row of each group
    assert exact.exact_duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact.exact_duplicates(frame(spark, rows), keep="first")
