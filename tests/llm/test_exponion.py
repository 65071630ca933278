import hashlib
import random

import numpy as np
import pytest
from conftest import DATA

from fichero.llm import exponion
from fichero.llm.exponion import Block, Centroids, cluster, integers, squares


def plain(rows, k, rounds, dims, scale):
    """Every distance in every round, in Python integers."""
    floor = lambda x: int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale))
    some = [(i, [floor(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in some if i is not None)[:k]
    now = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        own = [min(range(len(now)), key=lambda c: (far(v, now[c]), c)) for _, v in some] if now else []
        if turn < rounds:
            now = [[sum(t) // own.count(c) for t in zip(*(v for (_, v), o in zip(some, own) if o == c))] if c in own else now[c] for c in range(len(now))]
    return sorted((str(i), c, min(far(v, now[c]), 2**63 - 1)) for (i, v), c in zip(some, own)), now


def rows_of(n, dims, seed, spread=0.3, step=1 / 8):
    rnd = random.Random(seed)
    middle = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    return [(i, [round((m + rnd.gauss(0, spread)) / step) * step for m in rnd.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_against_plain(spark, k):
    rows = rows_of(300, 4, k)  # a coarse grid: many ties
    rows += [(1000, None), (1001, [1.0]), (1002, [1.0, None, 0.0, 0.0]), (1003, [1.0, float("nan"), 0.0, 0.0]), (1004, [float("inf"), 0.0, 0.0, 0.0]), (1005, [0.0] * 5), rows[0], rows[0], (7, [9.0, 9.0, 9.0, 9.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", exponion.F.lit("clash")).repartition(3)
    got, centroids, scanned = cluster(frame, k=k, dims=4)
    want, now = plain(rows, k, 3, 4, 64)
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == want
    assert centroids.tolist() == now
    assert scanned <= 4 * len(want) * (k + 1)


def test_few_none_and_huge(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, [0.0, 1.0])], [(1, None)], [(None, [0.0, 0.0])], [(1, [1e200, 0.0]), (2, [-1e200, 3.0]), (3, [0.25, -0.3]), (4, [1e17, 5.0]), (5, [1.7e308, -1.7e308])], [(i, [2.0, 2.0]) for i in range(20)]):
        got, centroids, _ = cluster(frame(rows), k=3, dims=2)
        want, now = plain(rows, 3, 3, 2, 64)
        assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == (want if now else [])
        assert centroids.tolist() == now


def test_bounds_spare_distances_and_keep_ties():
    x = integers(np.array([v for _, v in rows_of(4000, 8, 3, 0.05, 1 / 64)]))
    now = x[:40].copy()
    block = Block(x, np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), -np.inf))
    to = Centroids(now, np.zeros(len(now)))
    for turn in range(6):
        before = block.scanned
        block.move(to)
        far = np.array([squares(x, c) for c in to.now])
        assert (block.cluster == far.argmin(0)).all()  # argmin: the first of equal ones
        assert (block.upper >= np.sqrt(far.min(0))).all() and (block.lower <= np.sqrt(np.partition(far, 1, 0)[1]) + 1e-6).all()
        if turn:
            assert block.scanned - before < 0.5 * len(x) * len(now)
        means = np.array([x[block.cluster == c].sum(0) // max(1, (block.cluster == c).sum()) if (block.cluster == c).any() else to.now[c] for c in range(len(now))])
        to = Centroids.after(to.now, means)


def test_same_as_sql(compare):
    compare(exponion.op11_exponion, exponion.oracle(), f"{DATA}/sf0.001")
