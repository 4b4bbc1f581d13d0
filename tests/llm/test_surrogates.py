import re

from voxpop.llm import surrogates as S


def luhn(s):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(s))) % 10 == 0


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_private int")
    return {r.doc_id: r for r in S.replace_private(df, **options).collect()}


def test_types_formats_and_coreference(spark):
    texts = [
        "mail Bob.Smith42@Mail8.example.com or bob.smith42@mail8.example.com, call +1 (386) 555-3733.",
        "call +1 386-555-3733 or +1 (386) 555-3734; ip 61.131.143.218 and 192.168.4.5; v 1.2.3 and 4.0.",
        "card 4944339490429605, again 4944 3394 9042 9605 and 123-45-6789",
        "Mrs. Anna Smith met Mr Smith and Dr. Иван Петров; Frau Müller left",
        "nothing here, a 1234 number", None, "", "x@y",
        "61.131.143.218",
    ]
    got = run(spark, texts)
    assert len(got) == len(texts)
    for i in (4, 5, 6, 7):
        assert got[i].text == texts[i] and got[i].n_private == 0
    a, b = re.findall(r"[\w.]+@[\w.]+\w", got[0].text)
    assert a == b and a.endswith(".com") and "smith" not in a
    m = re.fullmatch(r"mail (\S+) or \1, call (\+1 \(\d{3}\) \d{3}-\d{4})\.", got[0].text)
    one = re.sub(r"\D", "", m[2])
    n = re.fullmatch(r"call (\+1 \d{3}-\d{3}-\d{4}) or (\+1 \(\d{3}\) \d{3}-\d{4}); ip (\S+) and (192\.168\.\d+\.\d+); v 1\.2\.3 and 4\.0\.", got[1].text)
    assert re.sub(r"\D", "", n[1]) == one != re.sub(r"\D", "", n[2]) and one != "13865553733"
    assert got[8].text == n[3] != "61.131.143.218"
    c = re.fullmatch(r"card (4\d{15}), again (4\d{3}) (\d{4}) (\d{4}) (\d{4}) and (\d{3}-\d\d-\d{4})", got[2].text)
    assert "".join(c.group(2, 3, 4, 5)) == c[1] != "4944339490429605" and luhn(c[1]) and c[6] != "123-45-6789"
    p = re.fullmatch(r"Mrs\. ([A-Z][a-z]+a) ([A-Z][a-z]+) met Mr ([A-Z][a-z]+) and Dr\. ([А-Я][а-я]+) ([А-Я][а-я]+); Frau ([A-Z][a-z]+) left", got[3].text)
    assert p[2] == p[3] != "Smith" and p[6] != p[2]
    assert [got[i].n_private for i in range(4)] == [3, 4, 3, 6]
    assert run(spark, texts, key="other")[8].text != got[8].text
    assert {i: r.text for i, r in run(spark, texts).items()} == {i: r.text for i, r in got.items()}


def test_distinct_entities_stay_distinct(spark):
    # far more entities than one-letter addresses have surrogates of their shape
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{x}@{y}.de" for x in letters for y in letters]
    got = run(spark, texts)
    new = [r.text for r in got.values()]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)


def test_small_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [None, ""])[0].text is None
    long = "w" * 200_000 + " a@b.org " + "é😀" * 50_000
    df = spark.createDataFrame([(None, long), (None, long), (1, long)], "doc_id long, text string")
    rows = S.replace_private(df).collect()
    assert len(rows) == 3 and len({r.text for r in rows}) == 1 and "a@b.org" not in rows[0].text
    assert len(rows[0].text) >= len(long) and {r.n_private for r in rows} == {1}
