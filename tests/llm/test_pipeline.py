import corpus_pipeline as C
from voxpop.llm import minhash, quality, toxicity
from voxpop.llm.common import held_out

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    a = C.drop_toxic(spark, docs, SF)
    assert a.columns == docs.columns
    assert ids(a) == ids(toxicity.score_toxicity(docs, labels, ~held_out()).where("score < 0.5"))
    b = C.drop_poor(spark, a, SF)
    assert b.columns == docs.columns
    assert ids(b) == ids(quality.score_quality(a, labels, ~held_out()).where("score >= 0.3"))
    c = C.drop_near_duplicates(spark, b, SF)
    assert ids(c) == ids(minhash.near_duplicates(b, size=5, percent=80).where("kept"))
    d = C.cut_secrets(spark, c, SF)
    assert d.columns == docs.columns and ids(d) == ids(c)
    assert all(r.n_chars == len(r.text) and "AKIA" not in r.text for r in d.collect())
    e = C.pack(spark, d, SF)
    assert set(ids(e)) == set(ids(d))


def test_run_and_empty(spark, tmp_path):
    assert C.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0
