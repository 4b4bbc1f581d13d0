import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxpop.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, idx long, p long, term string, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 5, 6, "x", 9) for i, (la, s, t) in enumerate(rows)], SCHEMA)


def brute(rows, min_docs=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    kept = {la: [t for t, n in docs[la].items() if n >= min_docs] for la in {g[0] for g in groups}}

    def share(count, terms):
        total = sum(count[t] for t in terms) + 2 * len(terms)
        return {t: 1 + 10**9 * (count[t] + 2) // total for t in terms}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    p = {g: share(counts[g], kept[g[0]]) for g in groups}
    for lang, source in groups:
        ts = kept[lang]
        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())
        q = share(whole, ts)
        mine = p[lang, source]
        pair = [(s, sum(f(mine[t], p[lang, s][t]) for t in ts)) for la, s in groups if la == lang and s != source]
        term = [(t, f(mine[t], q[t])) for t in ts if counts[lang, source][t] and mine[t] > q[t]]
        order = lambda x: (-x[1], x[0].encode())
        out += [(lang, source, "pair", s, v, i) for i, (s, v) in enumerate(sorted(pair, key=order), 1)]
        out += [(lang, source, "term", s, v, i) for i, (s, v) in enumerate(sorted(term, key=order)[:top], 1)]
    return sorted(out)


def made(seed, n, sources):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "é", "É", "日本", "x\x00y", "don't", "z9z", "ﬀ"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for _ in range(n):
        la = rng.choice(["en", "en", "en", "fr", None, "a\x00b", "a\x00\x01b"])
        s = "hot" if rng.random() < 0.3 else f"s{rng.randrange(sources)}"
        rows.append((la, s, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rng.randrange(30)))))
    return rows + [("de", "only", "one two"), ("de", "other", None), ("de", None, ""), ("xx", "lone", "a " * 100_000), (None, None, None)]


def test_terms():
    assert D.terms("Ab1É-éx\x00[z]日本 ~".encode()) == [t.encode() for t in ("ab", "É", "éx", "z", "日本")]


def test_merge_of_runs_is_a_sorted_sum():
    rng = random.Random(4)
    total, found, segments = Counter(), Counter(), []
    for r in range(20):
        block = D.Block()
        for _ in range(30):
            source, words = b"s%d" % rng.randrange(3), [b"w" + bytes([97 + rng.randrange(26), 97 + rng.randrange(20)]) for _ in range(9)]
            block.add(b"en", source, b" ".join(words))
            total.update((w, source) for w in words)
            found.update(set(words))
        segments += [D.Segment(*columns) for _, _, *columns in block.run(1, 5)]
    segments.sort(key=lambda s: s.words[0])
    one = np.ones(1, np.int64)
    last = D.Segment([b"a"], 9 * one, one, 0 * one, 5 * one, [b"x"])
    got = list(D.merge(iter([((0, b"en"), s) for s in segments] + [((1, b"en"), last)]), 6))
    assert [(g, t) for g, t, _, _ in got] == [((0, b"en"), t) for t, n in sorted(found.items()) if n >= 6] + [((1, b"en"), b"a")]
    sums = {(t, s): n for _, t, sources, counts in got[:-1] for s, n in zip(sources, counts, strict=True)}
    assert sums == {k: n for k, n in total.items() if found[k[0]] >= 6}


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many runs, segments, cells, blocks of sources and chunks
        for name, value in {"BLOCK": 40, "NAMES": 30, "SEGMENT": 3, "WIDTH": 3, "CELL_ROWS": 50, "TERMS": 2}.items():
            monkeypatch.setattr(D, name, value)
    rows = made(7, 400, 7)
    got = D.audit(frame(spark, rows).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_counts_beyond_64_bits_of_the_product(spark):
    n = 3 * 10**10  # n * SCALE passes 2^63
    row = spark.range(1).selectExpr(f"cast({n} as long) as c", f"cast({2 * n + 7} as long) as t").select(D._share("c", "t")).first()
    assert row[0] == 1 + 10**9 * (n + 2) // (2 * n + 7)


def test_empty_table(spark):
    assert D.audit(frame(spark, [])).count() == 0
    only = D.audit(frame(spark, [("en", "a", "x"), ("en", "b", "y")])).collect()  # no kept term: pairs of value 0
    assert sorted((r.source, r.part, r.item, r.value, r["rank"]) for r in only) == [("a", "pair", "b", 0, 1), ("b", "pair", "a", 0, 1)]
