import random

import pytest
from conftest import DATA

from fichero.llm import bpe


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    return bpe.Vocabulary.read(path), Tokenizer.from_file(path)


def test_same_as_library(both):
    vocab, library = both
    rnd = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), *range(0x300, 0x400), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x130, 0x4E2D, 0xAC00, 0x1100, 0x1161, 0xBD, 0xB2, 0x660, 0x10400, 0x1F600, 0xFEFF]]
    texts = ["".join(rnd.choice([*pool, *"  abcdeABC'''123" * 8]) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["", "a<|startoftext|>B c<|endoftext|>", "<|endoftext|><|endoftext|>", " <|STARTOFTEXT|> x", "it's I'LL we'Re 'T", "a" * 700, "ΣΑΣ ΟΔΟΣ", "İstanbul", "x\x1cy\x1fz", " \n "]
    encoder = bpe.Encoder(vocab)
    for text, ids, want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids == want.ids, repr(text)
        assert encoder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_tables(spark, both):
    vocab, library = both
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None), (-1, "", "s"), (-1, "", "s")], docs.schema))
    rows = bpe.encode(docs, vocab, others=("source",)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count() and all(r["ids"] == library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in rows)
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, vocab), vocab).collect()}
    assert all(decoded[r["doc_id"]] == library.decode(r["ids"], skip_special_tokens=False) for r in rows)
    assert bpe.encode(docs.limit(0), vocab, output="digest").count() == 0
