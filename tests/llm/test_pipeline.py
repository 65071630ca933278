import hashlib

import corpus_pipeline
from conftest import DATA
from fichero.llm import bpe


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-1, "", "en", None, 0)], docs.schema))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        assert out.columns == docs.columns or name == "tokens"
        docs = corpus_pipeline.Scratch(spark).write(out)
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5]
    assert docs.filter("size(ids) <> n_tokens").isEmpty()
    for name, stage in corpus_pipeline.STAGES:
        none = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(0)
        assert stage(spark, none, f"{DATA}/sf0.001").count() == 0, name


def test_run(spark):
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").count() > 0


def test_tokens_are_decoded(spark):
    docs = spark.createDataFrame([(1, "One text, twice over.", "a"), (2, None, "b"), (3, "Ünï [SEP] 12,5", None)], "doc_id long, text string, source string")
    encoder = bpe.Encoder(bpe.Vocabulary.read(bpe.default_path()))
    rows = corpus_pipeline.tokens(spark, docs, "").collect()
    assert len(rows) == 3 and all(r["decoded_sha256"] == hashlib.sha256(encoder.decode(r["ids"]).encode()).hexdigest() for r in rows)
    digests = {r["doc_id"]: r["decoded_sha256"] for r in bpe.encode(docs, encoder.vocab, output="digest").collect()}
    assert digests == {r["doc_id"]: r["decoded_sha256"] for r in rows}
