import pickle
import tracemalloc

import numpy as np
from fichero.llm import classifier, line_dedup
from fichero.llm.common import Marks, give_back, marked_slots


def test_sample_is_no_matrix():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(classifier.TERMS, 40, False)), rng.random(40, np.float32), i % 2) for i in range(classifier.SAMPLE)]
    tracemalloc.start()
    model = classifier.Model(rows, {0: 10, 1: 30})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # the matrix alone has 117 MB
    x = np.zeros((len(rows), classifier.TERMS))
    for i, (at, value, _) in enumerate(rows):
        x[i, at] = value * model.weights[at]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ model.projection
    assert np.allclose(model.vectors, y / np.linalg.norm(y, axis=1, keepdims=True), atol=1e-4)
    assert np.allclose(model.projection.T @ model.projection, np.eye(classifier.RANK), atol=1e-4)


def test_marks_are_packed(spark):
    slots = [0, 7, 1 << 15, (1 << 27) - 1]
    marks = marked_slots(spark.createDataFrame([(s,) for s in [*slots, 7]], "slot long"), 27)
    assert isinstance(marks, Marks) and len(pickle.dumps(marks)) < 10_000  # as a table, 16 MB
    assert np.flatnonzero(np.unpackbits(marks.table)).tolist() == slots
    assert not marked_slots(spark.createDataFrame([], "slot long"), 20).table.any()


def test_rarity_is_packed(spark):
    packed = line_dedup.rarity(spark.createDataFrame([("a b a\nc a",), (None,)], "text string"))
    assert len(pickle.dumps(packed)) < 10_000  # as a table, 16 MB
    level = line_dedup.unpacked_levels(packed, line_dedup.SLOT_BITS)
    assert level[level > 0].tolist() == [line_dedup._level(np.array([3]))[0]]


def test_jvm_gives_memory_back(spark):
    assert give_back(spark).startswith("Trim native heap")
