import hashlib

import numpy as np

from voxpop.llm import fingerprints as P


def brute(text):
    """Closed syncmers by the definition, with the module's hashes."""
    codes = [ord(c) + 1 for c in text]
    mask = 2**64 - 1

    def poly(part):
        h = 0
        for c in part:
            h = (h * int(P._B) + c) & mask
        return h

    mix = lambda x: int(P._mix(np.array([x], np.uint64))[0])
    out = []
    k, s = (P.K, P.S) if len(text) >= P.SHORT else (2 * P.SHORT_S, P.SHORT_S)
    for i in range(len(codes) - k + 1):
        order = [mix(poly(codes[j : j + s])) for j in range(i, i + k - s + 1)]
        if min(order) in (order[0], order[-1]):
            out.append((i, mix(poly(codes[i : i + k]))))
    return out


def test_syncmers_follow_the_definition():
    for text in ("the quick brown fox jumps over the lazy dog " * 3, "é😀x" * 20, "a" * 40, "0123456789abcdef", "abcd", "x" * 64, "y" * 63):
        at, h = P.syncmers(text)
        assert list(zip(at.tolist(), h.tolist(), strict=True)) == brute(text)


def test_context_free_and_likeness():
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    inside = set(P.syncmers(passage)[1].tolist())
    assert inside <= set(P.syncmers("xyz " + passage + " other words")[1].tolist())
    a = P.sketch(passage)
    assert P.likeness(a, a) == 1 and P.likeness(a, P.sketch("")) == 0 and P.likeness(P.sketch(""), P.sketch(None)) == 1
    assert P.likeness(a, P.sketch("q" * 10)) == 0


def test_edited_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(0, 400, 300)]
    rows = [(int(i) * 3 - 100, t, "x") for i, t in enumerate(texts)]
    rows += [(5000, None, "y"), (5001, "", "y"), (5002, "é😀" * 50, "y"), (5003, "w" * 200_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edited string")
    old, P.RANGE_ROWS = P.RANGE_ROWS, 20
    try:
        got = {r.doc_id: r for r in P.edited(df).collect()}
    finally:
        P.RANGE_ROWS = old
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (i, t, _), (_, after, _) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == P.printed(P.sketch(t)) and r.edited_fingerprint == P.printed(P.sketch(e))
        assert r.near_next == P.likeness(P.sketch(t), P.sketch(after)) and r.near_edited == P.likeness(P.sketch(t), P.sketch(e))


def test_small_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert P.edited(df([])).count() == 0
    only = P.edited(df([(1, "abc")])).first()
    assert only.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and only.near_next == 1
    got = P.edited(df([(1, "abc"), (1, "abc"), (None, "xyz"), (None, None)])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None", "None"]
    assert next(r for r in got if r.doc_id is None and r.n_chars == 3).edited_sha256 == hashlib.sha256(b"xy").hexdigest()
    assert P.anchors(df([(1, "abc"), (2, None), (3, "")])).count() == 1
