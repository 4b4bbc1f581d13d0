"""Edge cases that once gave wrong results or took the JVM down."""

from pyspark.sql import functions as F

from voxpop.llm import chat, fingerprints, packing, secrets, surrogates

BIG = [2**60 + 1, 2**60 + 3]


def test_a_million_labels_are_no_address(spark):
    labels = "x@" + "a." * 1_000_000 + "com"
    long_names = "y@" + "label." * 200_000 + "com and ann@mail.example.org"
    rows = [(1, labels), (2, long_names), (3, "bob@a-1.b2.example.com.. and c@d.e1.org2"), (4, "z@" + "q." * 125 + "net")]
    got = {r.doc_id: r.text for r in surrogates.replace_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == labels
    assert not got[2].startswith("y@label.") and got[2].count("@") == 2 and "ann@mail.example.org" not in got[2]  # its first 127 labels are an address
    assert "bob@" not in got[3] and got[3].count("@") == 2 and ".. and" in got[3]
    assert got[4] != rows[3][1]


def test_special_strings_get_the_ids_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder()
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext |>", "a" * 3000 + "<|endoftext|>"):
        assert list(encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_large_ids_beside_a_null(spark):
    rows = [(BIG[0], 0, "user", "a"), (BIG[1], 0, "user", "b"), (None, 0, "user", "c")]
    got = chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1)))
    assert got.schema["conv_id"].dataType.simpleString() == "bigint"
    assert {r.conv_id for r in got.collect()} == {*BIG, None}
    docs = spark.createDataFrame([(BIG[0], "one text"), (BIG[1], "another text"), (None, "none"), (0, "zero")], "doc_id long, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in fingerprints.edited(docs).collect()) == sorted(map(str, [*BIG, None, 0]))


def test_a_ledger_left_empty_by_a_dead_run(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    (tmp_path / "ledger").mkdir()
    versions = spark.createDataFrame([("p", 0, "password = abcdefghijkl1234")], "path string, version int, text string")
    assert secrets.scan(versions, ledger).where(F.size("spans") > 0).count() == 1
    assert secrets.scan(versions, ledger).count() == 1


def test_columns_named_like_the_operators_own(spark):
    """Columns called _blob, _spans or row keep their values in rows with findings."""
    from voxpop.llm import secrets, surrogates

    rows = [(1, "password = abcdefghijkl123 and bob@example.org", "mine", 7, "x"), (2, None, "b", None, None), (3, "nothing", "c", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _blob string, _spans int, row string")
    for got in (secrets.redact(docs), surrogates.replace_private(docs, key="k")):
        kept = {r.doc_id: (r._blob, r._spans, r.row) for r in got.collect()}
        assert kept == {1: ("mine", 7, "x"), 2: ("b", None, None), 3: ("c", 9, "z")}
        assert got.where("doc_id = 1").first().text != rows[0][1]
