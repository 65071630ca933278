"""Each stage of the pipeline against a plain version of it, on all documents of a small table with extra columns."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_line_dedup import plain as plain_lines
from test_mixing import plain_targets
from test_near_dups import plain as plain_groups

from fichero.llm import bpe, classifier

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = [(None, "a row without id, which is kept as it is", "en", None, 40), (-2, None, None, "src0", 0), (-1, "", "en", None, 0), (-1, "", "en", None, 0), (-3, "word " * 100_000, "en", "src0", 500_000)]
    out = rows.unionByName(spark.createDataFrame(more, rows.schema)).withColumn("rep", F.lit("x")).withColumn("size", F.col("doc_id")).withColumn("__gone", F.lit(1.5))
    return corpus_pipeline.Scratch(spark).write(out)


def of(df):
    return [r.asDict() for r in df.collect()]


def test_quality(spark, docs):
    model = classifier.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    terms = classifier.Terms()
    want = Counter((r["doc_id"], r["text"]) for r in of(docs) if model.score([terms.counts(r["text"])])[0] >= classifier.THRESHOLD)
    out = corpus_pipeline.quality(spark, docs, FOLDER)
    assert out.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in of(out)) == want
    labels = {r["doc_id"]: r["quality"] for r in of(spark.read.parquet(f"{FOLDER}/labels.parquet"))}
    kept = {i for i, _ in want}
    assert sum((i in kept) == bool(y) for i, y in labels.items()) >= 0.9 * len(labels)


def test_lines(spark, docs):
    given = of(docs)
    gone = plain_lines([(r["doc_id"], r["text"]) for r in given], least=1)
    want = Counter()
    for r in given:
        lines = (r["text"] or "").split("\n")
        left = [x for k, x in enumerate(lines) if not gone.get((r["doc_id"], k), False)]
        if len(left) == len(lines):
            want[r["doc_id"], r["text"], r["n_chars"]] += 1
        elif any(x.strip("\x20\t\x0b\x0c\r") for x in left):
            want[r["doc_id"], "\n".join(left), len("\n".join(left))] += 1
    out = corpus_pipeline.lines(spark, docs, FOLDER)
    assert out.columns == docs.columns and Counter((r["doc_id"], r["text"], r["n_chars"]) for r in of(out)) == want


def test_near_duplicates(spark, docs):
    given = of(docs)
    label = plain_groups([(r["doc_id"], r["text"]) for r in given])
    want = Counter({(r["doc_id"], r["text"]): 1 for r in given if r["doc_id"] is None or label[r["doc_id"]][2]})
    out = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert out.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in of(out)) == want


def test_mixture(spark, docs):
    given = of(docs)
    size = lambda r: len((r["text"] or "").encode().split())
    per, taken, most = Counter(), Counter(), Counter()
    for r in given:
        per[r["source"]] += size(r)
        most[r["source"]] = max(most[r["source"]], size(r))
    out = corpus_pipeline.mixture(spark, docs, FOLDER)
    assert out.columns == docs.columns
    copies = Counter()
    for r in of(out):
        taken[r["source"]] += size(r)
        copies[tuple(sorted(r.items(), key=str))] += 1
    rows = Counter(tuple(sorted(r.items(), key=str)) for r in given)
    assert all(n <= 2 * rows[k] for k, n in copies.items())  # no row that was not given, none more than twice
    for s, goal in plain_targets(dict(per)).items():
        assert abs(taken[s] - goal) <= most[s] + 1


def test_tokens(spark, docs):
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(bpe.default_path())
    plain.no_truncation()
    plain.no_padding()
    want = Counter()
    for r in of(docs):
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], tuple(ids), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in of(corpus_pipeline.tokens(spark, docs, FOLDER))) == want


def test_the_driver_holds_the_sample_once():
    import tracemalloc

    import numpy as np

    from fichero.llm import classifier

    draw = np.random.default_rng(3)
    rows = [(np.sort(draw.choice(classifier.TERMS, 200, replace=False)).astype(np.int16), draw.random(200, np.float32), i % 2) for i in range(2000)]
    tracemalloc.start()
    try:
        classifier.Model(rows, {0: 1000, 1: 1000})
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * len(rows) * classifier.TERMS * 4
