import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxpop.llm import collocations as P

SCHEMA = "doc_id long, text string, lang string, n long, codes string, w1 int, word string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, 1, "c", 2, "w", "r") for i, (la, t) in enumerate(rows)], SCHEMA)


def brute(rows, least, top):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                count[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        found = []
        for p in candidates:
            a = f[p]
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = (q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(100 * f[q] >= 80 * a for q in inside):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "日本", "x\x1cy", "it's", "\x00"]
    fixed = ["New York City Hall", "new york city hall", "of the", "a a a a a", "in spite of the", "é 日本"]
    rows = []
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!"]) for w in words)
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("de", "rare words here"), ("en", "a " * 50_000)]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_trie_against_a_set(depth):
    rng = np.random.default_rng(depth)
    text = rng.zipf(1.5, 5000).clip(max=400).astype(np.int32) * 3 - 4  # numbers from -1 on
    grams = np.lib.stride_tricks.sliding_window_view(text, depth)
    grams = np.unique(grams[(grams >= 0).all(1)], axis=0)
    chosen = grams[rng.random(len(grams)) < 0.5]
    trie = P.DoubleArray(rng.permutation(chosen))
    at, row = trie.walk(text)
    known = {tuple(p) for p in chosen.tolist()}
    expect = [(i, tuple(text[i : i + depth].tolist())) for i in range(len(text) - depth + 1) if tuple(text[i : i + depth].tolist()) in known]
    assert [(i, tuple(p)) for i, p in zip(at.tolist(), trie.phrases[row].tolist(), strict=True)] == expect


def test_trie_grows():
    phrases = np.array([(a, b) for a in range(60) for b in range(60) if (a * b) % 3 != 1], np.int32)
    trie = P.DoubleArray(phrases)
    at, row = trie.walk(np.c_[phrases, np.full(len(phrases), -1)].ravel().astype(np.int32))
    assert np.array_equal(trie.phrases[row], phrases) and np.array_equal(at, 3 * np.arange(len(phrases)))


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # several dictionaries and tries, counts handed on early
        for name, value in {"WORDS": 20, "SHARD": 15, "HELD": 10, "STEP": 7}.items():
            monkeypatch.setattr(P, name, value)
    rows = made(5, 150 if small else 600)
    got = P.collocations(frame(spark, rows).repartition(4), min_count=8, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expect = brute(rows, 8, 25)
    assert len(expect) > 20 and sorted(tuple(r) for r in got.collect()) == expect


def test_scores_beyond_64_bits(spark):
    a = 9 * 10**12  # times SCORE passes 2^63
    assert P.SCORE * a > 2**63
    one = spark.sql(f"select (cast({P.SCORE} as decimal(10,0)) * cast({a}L as decimal(20,0))) div (cast({a}L as decimal(20,0)) + cast({a + 3}L as decimal(20,0)))")
    assert one.first()[0] == P.SCORE * a // (2 * a + 3)


def test_empty_table(spark):
    assert P.collocations(frame(spark, [])).count() == 0
    assert P.collocations(frame(spark, [("en", None), (None, "one two")])).count() == 0
