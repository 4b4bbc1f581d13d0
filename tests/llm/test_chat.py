from hypothesis import given, settings
from hypothesis import strategies as st

from voxpop.llm import chat as C

T = C.Template()
pieces = st.lists(st.sampled_from([*T.controls, "\\", "<", "[", "]", ">", "/", "s>", "INST]", "a", " ", "\n", "é😀"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant"]), pieces), pieces), max_size=6))
def test_round_trip(turns):
    parts = T.segments(turns)
    assert T.read("".join(x for x, _, _ in parts)) == turns
    loss = "".join(T.unescape(x) for x, on, _ in parts if on)
    assert loss == "".join(t for r, t in turns if r == "assistant")


def test_machine():
    assert T.check(["user", "assistant"]) == -1
    assert T.check(["system", "user"]) == -1
    assert T.check([]) == 0
    assert T.check(["assistant"]) == 0
    assert T.check(["user", "user"]) == 1
    assert T.check(["system"]) == 1


def test_edge_rows(spark):
    rows = [
        (1, 1, "assistant", "b</s>", "x"), (1, 0, "user", None, "y"), (2, 0, None, "t", ""), (None, 0, "user", "n", ""), (None, None, "assistant", "m", ""),
        (3, 0, "user", "same", ""), (3, 0, "user", "same", ""), (4, 0, "user", "z" * 300_000, ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert got[1].formatted == "[INST][/INST]<s>b<\\/s></s>" and got[1].first_error == -1
    assert got[2].formatted == "[ROLE][TEXT]t[/ROLE]" and got[2].first_error == 0
    assert got[None].formatted == "<s>m</s>[INST]n[/INST]"
    assert got[3].first_error == 1 and got[3].formatted.count("same") == 2
    d = {r.conv_id: r for r in C.digests(C.format_chats(df)).collect()}
    assert (d[1].n_turns, d[1].loss_chars, d[4].formatted_chars) == (2, 5, 300_013)
    assert C.digests(C.format_chats(df.where("false"))).count() == 0
