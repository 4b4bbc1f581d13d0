import random

import public_tokenizers
import pytest
import sentencepiece

from voxpop.llm import transducer as T

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.MODEL))
PARTS = ["a", "b", "th", "e", "in", " ", "  ", "\n", "\t", "é", "😀", "ß", "x", "1", "0", ".", ",", "the", "ing", "▁", "日本", "ñ", "    ", "A", "\x00"]


@pytest.mark.parametrize("seed", range(8))
def test_ids_and_texts_equal_the_library(seed):
    rng, machine = random.Random(seed), T.compiled()
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        ids = machine.encode(text)
        assert ids == LIBRARY.encode(text), text
        assert machine.decode(ids) == LIBRARY.decode(ids), text


def test_long_texts():
    for text in ("a" * 20_000, " " * 20_000 + "b", "é😀" * 5000, "word " * 20_000):
        assert T.compiled().encode(text) == LIBRARY.encode(text)


def test_query_over_documents(spark):
    import hashlib
    import zlib

    import numpy as np

    from voxpop.llm.queries import op5_sentencepiece_wfst

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_sentencepiece_wfst(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, " ")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in T.decode(T.encode(df)).collect()) == [("1", ""), ("1", ""), ("2", " "), ("None", "")]
    assert T.encode(df.where("false")).count() == 0
