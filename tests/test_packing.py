import random
import time

import numpy as np
from conftest import DATA

from fichero.operators import chunking
from fichero.plans.catalogue import ORACLE_SQL, QUERIES


def fold(tokens, size, overlap):
    """Paragraph by paragraph."""
    done, current, n = [], [], 0
    for i, t in enumerate(tokens):
        if n + t > size and current:
            done.append((current[0], current[-1] + 1))
            kept, held = [], 0
            for j in reversed(current):
                if held + tokens[j] > overlap:
                    break
                kept.insert(0, j)
                held += tokens[j]
            current, n = kept, held
        current.append(i)
        n += t
    return done + ([(current[0], current[-1] + 1)] if current else [])


def test_cuts_as_by_a_fold():
    rnd = random.Random(7)
    for _ in range(3000):
        tokens = [rnd.choice((0, 0, 1, 2, 5, 9, 30)) for _ in range(rnd.randrange(25))]
        size, overlap = rnd.randrange(1, 40), rnd.randrange(0, 30)
        assert chunking.cuts(np.array(tokens, np.int64), size, overlap) == fold(tokens, size, overlap)


def test_a_million_paragraphs():
    tokens = np.random.default_rng(1).integers(0, 60, 1_000_000)
    began = time.time()
    assert len(chunking.cuts(tokens, 800, 150)) > 40_000
    assert time.time() - began < 5


def test_same_as_sql(spark, compare):
    assert spark.createDataFrame([(None,), ("",), (" \n\n ",), ("a\n\nb",)], "t string").select(chunking.pack("t").alias("c")).toPandas()["c"].map(lambda c: None if c is None else list(c)).tolist() == [None, [], [], ["a\n\nb"]]
    compare(QUERIES["chunk_pack_overlap"], ORACLE_SQL["chunk_pack_overlap"], f"{DATA}/sf0.001")


def test_python_sees_no_texts(spark):
    """Only counts, of texts longer than a chunk; chunks are those of the cuts."""
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice((" ", "\t", "")) + "x" * rnd.randrange(30) + rnd.choice((" ", " ", "")) for _ in range(rnd.randrange(12))) for _ in range(60)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.pack("t", 10, 3, "\n").alias("c"))
    for r in out.collect():
        parts = [p for p in (p.strip() for p in r["t"].split("\n")) if p]
        assert r["c"] == ["\n".join(parts[a:b]) for a, b in fold([len(p) // 4 for p in parts], 10, 3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "run(CASE WHEN (length(" in plan
