"""Vector functions: cosine similarity as an expression, embedders and blocks of top-k search in NumPy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..shared import settled


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in double precision, in the JVM; 0 where one has no length. For single pairs, not for search."""
    x, y = (F.transform(F.col(v) if isinstance(v, str) else v, lambda e: e.cast("double")) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    length = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(length > 0, dot(x, y) / length).otherwise(0.0)


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    size: int

    def embed(self, texts: list[str | None]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic stand-in for an embedding model: signed hashes of words, of unit length."""

    def __init__(self, size: int = 768):
        self.size = size

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        slots: dict[str, int] = {}  # of each word: where it counts up, or beyond size where it counts down
        for row, text in zip(out, texts):
            at = []
            for word in re.findall(r"\w+", (text or "").lower()):
                slot = slots.get(word)
                if slot is None:
                    h = zlib.crc32(word.encode())
                    slot = slots[word] = h % self.size + (0 if h >> 31 else self.size)
                at.append(slot)
            up = np.bincount(np.array(at, int), minlength=2 * self.size)
            row[:] = up[: self.size] - up[self.size :]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(text: Column | str, embedder: Embedder | None = None) -> Column:
    """The vectors of a text column, in Arrow batches."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.embed([t if isinstance(t, str) else None for t in texts])))

    return run(F.col(text) if isinstance(text, str) else text)


#: Queries of a block, bytes of vectors of a shard, and cosines that a task holds at once.
BLOCK, SHARD_BYTES, TILE = 2048, 4 << 20, 1 << 20
#: Cosines of single precision that are looked through while a core's cache holds them.
CACHED = 1 << 18
#: Bytes of queries up to which a single block of them is sent to all tasks; shards of a partition that others meet.
SENT_BYTES, SHARDS = 16 << 20, 16
#: Rows of an Arrow batch of vectors, and of one of blocks and shards.
ROWS, PAIRS = 1000, 1


def _packed(rows: DataFrame, most: int | None) -> DataFrame:
    """Rows (id, v, tipo) packed: ids, tipos, dim, vectors (of unit length). A packed row holds vectors of one length, `most` or SHARD_BYTES of them.

    Vectors that are null or empty, or hold a null or non-finite component, take no part.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}

        def row(dim: int) -> pd.DataFrame:
            ids, kinds, vs = zip(*held.pop(dim))
            return pd.DataFrame({"ids": [list(ids)], "tipos": [list(kinds)], "dim": [dim], "vectors": [unit(np.stack(vs)).tobytes()]})

        for batch in batches:
            for i, v, t in zip(batch["id"], batch["v"], batch["tipo"]):
                x = np.asarray(v if v is not None else [], float)
                if len(x) and np.isfinite(x).all():
                    own = held.setdefault(len(x), [])
                    own.append((i, t, x))
                    if len(own) >= (most or max(1, SHARD_BYTES // (8 * len(x)))):
                        yield row(len(x))
        for dim in list(held):
            yield row(dim)

    return rows.filter("id is not null and v is not null").mapInPandas(run, f"ids array<{kind}>, tipos array<string>, dim int, vectors binary")


class _Kind:
    """The k nearest rows of one kind of a block of queries: columns (numbers of queries, ids, shown, similarities), and each query's k-th so far."""

    def __init__(self, n: int):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.more = 0
        self.last = np.full(n, -np.inf)

    def add(self, k: int, *part: np.ndarray) -> None:
        """Rows that may be among the k; settled as soon as they are as many as all that are to stay."""
        self.parts.append(part)
        self.more += len(part[0])
        if self.more >= max(self.held, k * len(self.last) // 2):
            self.settle(k)

    def settle(self, k: int) -> None:
        q, ids, shown, similarity = (np.concatenate(c) for c in zip(*self.parts))
        n = np.bincount(q, minlength=len(self.last))
        order, first = np.lexsort((-shown, q)), np.cumsum(n) - n
        full = n >= k
        self.last[full] = shown[order[first[full] + k - 1]]
        keep = shown >= self.last[q]
        over = np.bincount(q[keep], minlength=len(n)) > k
        tied = np.flatnonzero(over[q] & (shown == self.last[q]))
        if len(tied):  # of these only the least ids stay
            tied = tied[np.lexsort((ids[tied], q[tied]))]
            above = np.bincount(q[shown > self.last[q]], minlength=len(n))
            t = np.bincount(q[tied], minlength=len(n))
            turn = np.arange(len(tied)) - (np.cumsum(t) - t)[q[tied]]
            keep[tied[turn + above[q[tied]] >= k]] = False
        self.parts, self.more = [(q[keep], ids[keep], shown[keep], similarity[keep])], 0
        self.held = len(self.parts[0][0])


class _Best:
    """The k nearest rows of each kind of a block of queries so far.

    Cosines are taken in single precision first: what stays below a query's k-th so far by more than their error can be
    no hit. Only the others are computed in double precision, which alone decides.
    """

    def __init__(self, ids, dim: int, vectors: bytes):
        self.ids, self.dim = list(ids), dim
        self.unit = np.frombuffer(vectors).reshape(len(self.ids), dim)
        self.rough = self.unit.astype(np.float32)
        # of sums of dim products of rounded numbers, twice over
        self.error = (dim + 8) * 2.0**-23
        self.kinds: dict[str | None, _Kind] = {}
        self.cosines, self.near = np.empty(CACHED, np.float32), np.empty(CACHED, bool)

    def offer(self, ids, tipos, vectors: bytes, k: int) -> None:
        self.k = k
        rows, keys, kinds = np.frombuffer(vectors).reshape(len(ids), self.dim), np.asarray(ids), np.asarray(tipos, object)
        rough = rows.astype(np.float32)
        none = np.array([t is None for t in tipos], bool)
        step = max(1, min(CACHED, TILE // len(self.ids)))
        for name in set(tipos):
            kind = self.kinds.setdefault(name, _Kind(len(self.ids)))
            at = np.flatnonzero(none if name is None else ~none & (kinds == name))
            for low in range(0, len(at), step):
                self._offer(kind, rows, rough, keys, at[low : low + step])

    def _offer(self, kind: _Kind, rows: np.ndarray, rough: np.ndarray, keys: np.ndarray, at: np.ndarray) -> None:
        floor = np.nextafter((kind.last - self.error).astype(np.float32), np.float32(-np.inf))[:, None]
        across, n, turn = rough[at].T, len(at), CACHED // len(at)
        hits, found = [], 0
        for low in range(0, len(self.ids), turn):
            asked = self.rough[low : low + turn]
            cosines, near = (x[: len(asked) * n].reshape(len(asked), n) for x in (self.cosines, self.near))
            np.matmul(asked, across, out=cosines)
            np.greater_equal(cosines, floor[low : low + turn], out=near)
            hits.append(np.flatnonzero(near) + low * n)
            found += len(hits[-1])
            if found > len(self.ids) * n // 16:
                break
        if found > len(self.ids) * n // 16:  # the first rows, or ties
            at = at[np.argsort(keys[at], kind="stable")]  # of equal ones the first are the least ids
            best = self._tile(0, self.unit @ rows[at].T, keys[at], self.k)
            kind.add(self.k, best["q"].to_numpy(), best["id"].to_numpy(), -best["shown"].to_numpy(), best["similarity"].to_numpy())
            return
        q, j = np.divmod(np.concatenate(hits), n)
        some = max(1, TILE // (4 * self.dim))
        for low in range(0, len(q), some):
            own, row = q[low : low + some], at[j[low : low + some]]
            similarity = np.einsum("ij,ij->i", self.unit[own], rows[row])
            shown = np.round(similarity, 9)
            keep = shown >= kind.last[own]
            kind.add(self.k, own[keep], keys[row[keep]], shown[keep], similarity[keep])

    @staticmethod
    def _tile(low: int, cosines: np.ndarray, keys: np.ndarray, k: int) -> pd.DataFrame:
        """The k nearest rows of each query of a tile; rows are in order of keys, to which ties go."""
        shown = np.round(cosines, 9)
        if shown.shape[1] > k:
            last = np.partition(shown, shown.shape[1] - k, 1)[:, [shown.shape[1] - k]]
            q, j = np.nonzero(shown >= last)
            if len(q) > k * len(shown):
                tied = shown[q, j] == last[q, 0]
                above = np.bincount(q[~tied], minlength=len(shown))
                # the turn of each tied row in its query
                turn = np.cumsum(tied) - 1
                first = np.zeros(len(shown), np.int64)
                first[1:] = np.cumsum(np.bincount(q[tied], minlength=len(shown)))[:-1]
                keep = ~tied | (turn - first[q] + above[q] < k)
                q, j = q[keep], j[keep]
        else:
            q, j = np.nonzero(np.ones(shown.shape, bool))
        return pd.DataFrame({"q": q + low, "id": keys[j], "shown": -shown[q, j], "similarity": cosines[q, j]})

    def result(self) -> Iterator[pd.DataFrame]:
        for name, kind in self.kinds.items():
            kind.settle(self.k)
            q, ids, _, similarity = kind.parts[0]
            yield pd.DataFrame({"same": [self.ids[i] for i in q], "id": ids, "tipo": pd.Series([name] * len(q), dtype=object), "similarity": similarity})


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector", row_id: str = "id", vector: str = "embedding", kind: str = "tipo") -> DataFrame:
    """query_id, id, tipo, similarity, rank: for each query the k rows of each kind with the greatest cosine.

    Equal vectors are compared once: queries of one vector share their hits, and of rows of one vector and kind only the
    k least ids can be hits. Blocks of at most BLOCK queries meet shards of vectors, each packed into one row, by pairs of
    partitions. A task holds TILE cosines and k rows per query of one block and kind, and only these are shuffled for the
    final ranks: no pair of vectors becomes a row, and none passes through the driver.
    Vectors of other length, null ones and those with null or non-finite components take no part. Ties (to 9
    decimals) go to the lesser id.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    id_type, q_type = (f.schema[c].dataType.simpleString() for f, c in ((rows, row_id), (queries, query_id)))
    # bounds what a worker gets at once, while the vectors, which may come from a model, are computed and written
    with _batches(spark, ROWS):
        plain = lambda v: F.to_json(F.transform(F.col(v).cast("array<double>"), lambda x: x + F.lit(0.0)))
        asking = settled(queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("v"), F.md5(plain(query_vector)).alias("same")), "asking").filter("query_id is not null and v is not null")
        alone = asking.groupBy("same").agg(F.first("v").alias("v"))
        # full blocks, however many partitions there were: a block reads all shards
        dealt = alone.repartition(max(1, -(-10 * asking.select("same").distinct().count() // (9 * BLOCK))))
        asked = settled(_packed(dealt.select(F.col("same").alias("id"), "v", F.lit(None).cast("string").alias("tipo")), BLOCK).drop("tipos"), "asked")
        # written before the filter, which would ask a model a second time
        own = settled(rows.select(F.col(row_id).alias("id"), F.col(vector).alias("v"), F.col(kind).cast("string").alias("tipo")), "own").filter("id is not null and v is not null")
        # told apart by the vector itself, behind a number that is sorted faster
        least = Window.partitionBy(F.xxhash64("v"), "v", "tipo").orderBy("id")
        unlike = own.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= k)
        held = settled(_packed(unlike.select("id", "v", "tipo"), None), "held")
    blocks, bytes_asked = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("vectors")), F.lit(0))).first()
    asked = asked.select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("asked"), F.col("dim").alias("size"), F.col("vectors").alias("weights"))
    if blocks <= 1 and bytes_asked <= SENT_BYTES:
        pairs = held.repartition(spark.sparkContext.defaultParallelism).crossJoin(F.broadcast(asked))
    else:
        # each block goes over the shards of a partition before the next one does; there are tasks for all cores
        cores, shards = spark.sparkContext.defaultParallelism, held.count()
        apart = max(1, min(shards, max(-(-shards // SHARDS), -(-2 * cores // blocks))))
        pairs = asked.repartition(min(blocks, 4 * cores)).hint("shuffle_replicate_nl").crossJoin(held.repartition(apart))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, best = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.size != r.dim:
                    continue
                if r.block != number:
                    if best is not None:
                        yield from best.result()
                    number, best = r.block, _Best(r.asked, r.dim, r.weights)
                best.offer(r.ids, r.tipos, r.vectors, k)
        if best is not None:
            yield from best.result()

    with _batches(spark, PAIRS):
        found = settled(pairs.mapInPandas(run, f"same string, id {id_type}, tipo string, similarity double"), "found")
    order = Window.partitionBy("same", "tipo").orderBy(F.round("similarity", 9).desc(), F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asking.select("query_id", "same").join(ranked, "same").select(F.col("query_id").cast(q_type), "id", "tipo", "similarity", "rank")


@contextmanager
def _batches(spark: SparkSession, rows: int):
    """Arrow batches of that many rows, and the session's own number again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
