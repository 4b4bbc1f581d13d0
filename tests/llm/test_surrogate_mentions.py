import re

from tests.llm.test_surrogates import luhn, run
from voxpop.llm import surrogates as S


def test_names_without_a_title_of_their_own(spark):
    got = run(spark, [
        "Dr. Anna Smith came. Smith said that SMITH's dog and Anna left; Smithers and Paris stayed. Mail Smith@x.org",
        "Mr McDonald met Mr O'Brien and Frau Jean-Luc. McDonald, O'Brien and Jean-Luc left",
        "Smith without a title here, but Herr Dr. Müller",
    ])
    t = got[0].text
    m = re.fullmatch(r"Dr\. ([A-Z]\w+) ([A-Z]\w+) came\. (\w+) said that (\w+)'s dog and (\w+) left; Smithers and Paris stayed\. Mail \S+@\S+\.org", t)
    assert m and m[2] == m[3] and m[4] == m[2].upper() and m[5] == m[1] and "Smith" not in (m[2], m[3])
    assert got[0].n_private == 6
    m = re.fullmatch(r"Mr (\w+) met Mr (\w+) and Frau (\w+)\. (\w+), (\w+) and (\w+) left", got[1].text)
    assert m and m.group(1, 2, 3) == m.group(4, 5, 6) and not {"McDonald", "Luc", "Brien"} & set(m.groups())
    assert got[1].n_private == 6
    assert got[2].text.startswith("Smith without a title here, but Herr Dr. ") and "Müller" not in got[2].text


def test_plain_phones_and_other_cards(spark):
    texts = ["call 555-123-4567, (555) 123-4567 or 1-555-123-4567", "pay 378282246310005 or 3782 822463 10005",
             "pay 2223003122003222, 2223 0031 2200 3222 or 30569309025904", "no 12-555-123-4567-8 or 1234-5678"]
    got = {i: r.text for i, r in run(spark, texts).items()}
    m = re.fullmatch(r"call (\d{3}-\d{3}-\d{4}), (\(\d{3}\) \d{3}-\d{4}) or 1-(\d{3}-\d{3}-\d{4})", got[0])
    assert m[1] == m[3] != "555-123-4567" and re.sub(r"\D", "", m[1]) == re.sub(r"\D", "", m[2])
    m = re.fullmatch(r"pay (37\d{13}) or (37\d\d \d{6} \d{5})", got[1])
    assert m[1] == m[2].replace(" ", "") != "378282246310005" and luhn(m[1])
    m = re.fullmatch(r"pay (2223\d{12}), (2223 \d{4} \d{4} \d{4}) or (305\d{11})", got[2])
    assert m[1] == m[2].replace(" ", "") != "2223003122003222" and luhn(m[1]) and luhn(m[3])
    assert got[3] == texts[3]


def test_a_full_private_range_spills(spark):
    rows = [("ipv4", f"192.168.{i}.{j}") for i in range(256) for j in range(256)]
    done = S.assign(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    new = {r.stand_in for r in done}
    assert len(done) == len(new) == len(rows) and all(x.startswith("10.") for x in new)
