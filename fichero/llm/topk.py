"""Operator 4: exact top-k inner products by an impact-ordered, score-at-a-time index.

Components become integer impacts, floor(256 * x). The index holds one row per shard of vectors: posting
segments by quantised impact (bits of its magnitude), each with (row, dimension, impact) of every posting of
that magnitude, and for each row the length of what the following segments still hold.

A search takes segments by descending magnitude and adds query weight times impact to the scores of a block
of queries. After a segment, what a row may still gain or lose is at most |query| * |rest of the row|
(Cauchy-Schwarz). Processing of a query stops in a shard only when all rows that may still be among its k best
(upper bound not below the k-th lower bound, or the k-th score of earlier shards) are few; those are scored
exactly from the index. So the result is exact, ties included.

Vectors that are null or hold a null or non-finite component take no part; an empty vector scores 0 against
all, and a shorter vector counts as padded with zeros. Rows with a null id take no part. Repeated rows are
candidates of their own; of repeated queries the least vector is asked. Scores beyond 64 bits are held at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SCALE = 256
SHARD = 4096
#: Queries of a block, and blocks whose best rows a task keeps while it goes over shards.
BLOCK, HELD = 1024, 64
#: A query leaves score-at-a-time processing in a shard once at most this many of its rows remain possible.
FEW = 32
_EXACT = 2**53


def _impacts(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors take part, and their impacts (int64, or object where 64 bits may not do)."""
    keep, out = [], []
    for v in vectors:
        ok = v is not None
        if ok:
            x = np.asarray(v, dtype=float) if len(v) else np.zeros(0)
            ok = bool(np.isfinite(x).all())
        keep.append(ok)
        if ok:
            y = np.floor(x * SCALE)
            out.append(y.astype(np.int64) if not len(y) or np.abs(y).max() < 2**30 else np.array([int(t) for t in y], dtype=object))
    return np.array(keep, bool), out


def _padded(rows: list[np.ndarray], dims: int) -> np.ndarray:
    wide = any(r.dtype == object for r in rows)
    out = np.zeros((len(rows), dims), dtype=object if wide else np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


INDEX = "ids array<bigint>, dims int, segments array<struct<magnitude:int,rows:array<int>,dims:array<int>,impacts:array<bigint>,rest:array<double>>>, wide array<string>"


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row per shard of at most `shard` vectors. Rows of impacts that need over 30 bits are kept as text in `wide`."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), shard):
                part = batch.iloc[at : at + shard]
                keep, rows = _impacts(list(part["vector"]))
                ids = part["key"].to_numpy()[keep].astype(np.int64)
                big = [r.dtype == object for r in rows]
                for wide in (False, True):
                    some = [r for r, b in zip(rows, big) if b == wide]
                    if some:
                        yield _shard_row(ids[np.array(big) == wide], some, wide)

    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).mapInPandas(build, INDEX)


def _shard_row(ids: np.ndarray, rows: list[np.ndarray], wide: bool) -> pd.DataFrame:
    dims = max(map(len, rows))
    if wide:
        return pd.DataFrame({"ids": [ids], "dims": [dims], "segments": [[]], "wide": [[" ".join(map(str, r)) for r in rows]]})
    m = _padded(rows, dims)
    magnitude = np.zeros(m.shape, np.int64)
    magnitude[m != 0] = np.floor(np.log2(np.abs(m[m != 0]))).astype(np.int64) + 1
    squares, left, segments = m.astype(float) ** 2, None, []
    left = squares.sum(1)
    for level in sorted(set(magnitude[magnitude > 0].tolist()), reverse=True):
        here = magnitude == level
        left = left - np.where(here, squares, 0).sum(1)
        r, d = np.nonzero(here)
        segments.append({"magnitude": int(level), "rows": r.astype(np.int32), "dims": d.astype(np.int32), "impacts": m[r, d], "rest": np.sqrt(np.maximum(left, 0)) * (1 + 1e-12)})
    return pd.DataFrame({"ids": [ids], "dims": [dims], "segments": [segments], "wide": [[]]})


class _Best:
    """The k best (score, then smaller id) of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def floor(self) -> np.ndarray:
        return np.array([r[-1][0] if len(r) == self.k else -np.inf for r in self.rows], float)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > 4 * self.k:  # ties at the k-th score stay
            floor = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= floor], scores[scores >= floor]
        best = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        self.rows[q] = sorted([*self.rows[q], *((scores[i], ids[i]) for i in best)], key=lambda x: (-x[0], x[1]))[: self.k]


def search_shard(row, own: np.ndarray, queries: np.ndarray, best: _Best, few: int = FEW) -> int:
    """Offer a shard's vectors to a block of queries. Returns how many (query, segment) steps were saved."""
    ids = np.asarray(row.ids, np.int64)
    n, k = len(ids), best.k
    dims = max(int(row.dims), queries.shape[1])
    reach = float(np.abs(queries.astype(float)).sum(1).max(initial=0)) * 2.0 ** max((x["magnitude"] for x in row.segments), default=0)
    if len(row.wide) or queries.dtype == object or reach >= _EXACT:
        rows = [np.array([int(x) for x in t.split()], dtype=object) for t in row.wide] if len(row.wide) else list(_dense(row, n, dims, row.segments).astype(object))
        q_rows = _padded([np.asarray(q, dtype=object) for q in queries], dims)
        v_rows = _padded(rows, dims)
        for q in range(len(own)):
            scores = np.array([sum(int(a) * int(b) for a, b in zip(q_rows[q], v)) for v in v_rows], dtype=object)
            best.add(q, ids[ids != own[q]], scores[ids != own[q]])
        return 0
    weights = _padded(list(queries), dims).astype(float)
    lengths = np.sqrt((weights**2).sum(1)) * (1 + 1e-12)
    active = np.arange(len(own))
    score = np.zeros((len(own), n))
    whole, saved = None, 0
    exact = lambda q, may: (whole[may] @ weights[q].astype(np.int64)).astype(np.int64)
    for at, segment in enumerate(row.segments):
        m = _dense(row, n, dims, [segment]).astype(float)
        if len(active) == len(own):
            score += weights @ m.T
        else:
            score[active] += weights[active] @ m.T
        rest, stop = np.asarray(segment["rest"]), []
        if at + 1 == len(row.segments) or not len(active):
            break
        seen = best.floor()
        slack = lengths[active, None] * rest[None, :] + 1e-6
        lower = score[active] - slack
        lower[own[active, None] == ids[None, :]] = -np.inf
        kth = np.partition(lower, max(0, n - k), 1)[:, max(0, n - k)] if n > k else np.full(len(active), -np.inf)
        floor = np.maximum(kth, seen[active])
        possible = score[active] + slack >= floor[:, None]
        counts = possible.sum(1)
        for i in np.nonzero(counts <= few)[0]:
            q = active[i]
            may = possible[i] & (ids != own[q])
            if may.any():
                whole = _dense(row, n, dims, row.segments) if whole is None else whole
                best.add(q, ids[may], exact(q, may))
            stop.append(i)
            saved += len(row.segments) - at - 1
        active = np.delete(active, stop)
    for q in active:
        may = ids != own[q]
        best.add(q, ids[may], np.rint(score[q][may]).astype(np.int64))
    return saved


def _dense(row, n: int, dims: int, segments) -> np.ndarray:
    m = np.zeros((n, dims), np.int64)
    for s in segments:
        m[np.asarray(s["rows"]), np.asarray(s["dims"])] = np.asarray(s["impacts"])
    return m


def search(built: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of the index for each query but the query's own id.

    Queries are packed into rows of at most `block`, which meet the rows of the index inside tasks: none passes
    through the driver, and the plan does not grow with their number.
    """
    asked = queries.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.min(vector).alias("vector"))
    # few rows on either side, each a block: Spark sends the smaller side to all tasks if its size allows
    pairs = _blocks(asked, block).withColumn("block", F.monotonically_increasing_id()).crossJoin(built)
    found = pairs.mapInPandas(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(asked: DataFrame, block: int) -> DataFrame:
    """own (ids), width, weights (their impacts, padded): blocks of at most `block` queries; as text where 64 bits may not do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for wide, ids, rows in _gathered(batches, block):
            if wide:
                yield pd.DataFrame({"own": [ids], "width": [max(map(len, rows))], "weights": [b""], "text": [[" ".join(map(str, r)) for r in rows]]})
            else:
                m = _padded(rows, max(map(len, rows)))
                yield pd.DataFrame({"own": [ids], "width": [m.shape[1]], "weights": [m.astype("<i8").tobytes()], "text": [[]]})

    return asked.mapInPandas(run, "own array<bigint>, width int, weights binary, text array<string>")


def _gathered(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[bool, list[int], list[np.ndarray]]]:
    """(whether 64 bits may not do, ids, impacts) of runs of at most `most` queries."""
    held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
    for batch in batches:
        keep, rows = _impacts(list(batch["vector"]))
        for i, r in zip(batch["key"].to_numpy()[keep].tolist(), rows):
            ids, own = held[r.dtype == object]
            ids.append(i)
            own.append(r)
            if len(ids) == most:
                yield r.dtype == object, ids, own
                held[r.dtype == object] = ([], [])
    for wide, (ids, own) in held.items():
        if ids:
            yield wide, ids, own


def _searcher(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.itertuples():
                if row.block not in held:
                    if len(held) == HELD:
                        yield _rows(*held.pop(next(iter(held))))
                    held[row.block] = (np.asarray(row.own, np.int64), _Best(len(row.own), k))
                own, best = held[row.block]
                queries = _padded([np.array([int(x) for x in t.split()], dtype=object) for t in row.text], row.width) if len(row.text) else np.frombuffer(row.weights, "<i8").reshape(len(own), row.width)
                for at in range(0, len(own), 512):  # bounds the scores held at once
                    part = _Best(0, k)
                    part.rows = best.rows[at : at + 512]
                    search_shard(row, own[at : at + 512], queries[at : at + 512], part)
                    best.rows[at : at + 512] = part.rows
        for own, best in held.values():
            yield _rows(own, best)

    return run


def _rows(own: np.ndarray, best: _Best) -> pd.DataFrame:
    top = 2**63 - 1
    out = [(int(own[q]), int(i), int(min(max(s, -top - 1), top))) for q, rows in enumerate(best.rows) for s, i in rows]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def op4_topk_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by integer inner product, of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    built = Scratch(spark).write(index(vectors))
    return search(built, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS s
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(s AS BIGINT) AS score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
