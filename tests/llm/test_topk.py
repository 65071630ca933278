import math
import random

from conftest import DATA

from fichero.llm import topk
from fichero.llm.queries import ORACLE_SQL, QUERIES


def plain(rows, queries, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if queries(i)}):
        own = min((v for i, v in rows if i == q and v is not None), default=None)
        w = [math.floor(256 * x) for x in own]
        best = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def test_against_plain(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice((rnd.gauss(0, 1), rnd.gauss(0, 0.05))) for _ in range(12)]) for i in range(700)]
    rows += [(700 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (950, []), (951, [1.0] * 5), (952, [1e9] * 12), (None, [1.0] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in frame.collect()]
    for few, shard in ((topk.FEW, topk.SHARD), (3, 50)):
        topk.FEW = few
        got = topk.search(topk.index(frame, shard=shard), frame.filter("vec_id % 50 = 0"), 5, block=7)
        assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 50 == 0, 5)
    assert topk.search(topk.index(frame.limit(0)), frame.limit(0)).count() == 0
    assert topk.search(topk.index(frame.limit(3)), frame.filter("vec_id = 0")).count() <= 3


def test_sql(compare):
    compare(QUERIES["op4_topk_impact"], ORACLE_SQL["op4_topk_impact"], f"{DATA}/sf0.001")
