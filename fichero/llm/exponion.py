"""Operator 11: k-means over integer vectors by exponion search.

Vectors become integers, floor(SCALE * x). Each keeps its centroid, an upper bound of the distance to it and a
lower bound of the distance to any other; as centroids move, the bounds widen by how far they went. A vector
whose upper bound is below its lower one, or below half the way from its centroid to the next, stays unseen.
Any other vector gets its exact distance, and, if that does not settle it, scans only the centroids inside a ball around its
own: those up to 2 * upper + (way to the next centroid), a prefix of the own centroid's list of centroids in
order of their distance. That ball holds the nearest centroid and the second. Its radius is inclusive and bounds are compared
with room for rounding, so ties are seen; distances that decide are exact integers, and of equal ones the lesser number wins.

Centroids (k x dims integers) are all that the driver holds and tasks are sent; each task adds up its vectors by
cluster, in parts of 32 bits, so sums are exact. Vectors and bounds travel in blocks, one row each, written
anew after each round to cut lineage.

Vectors that are null, of another length, or hold a null or non-finite component are left out. Rows with a null
id are clustered, but start no centroid. Repeated rows count each; of equal ids the lesser vector starts. With
fewer vectors than k there are as many centroids as vectors with an id; with none the result is empty. Integers
of any size are exact; a distance or inertia beyond 64 bits is held at the limit. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, trimmed

DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Room for rounding when bounds are compared.
SLACK = 1e-9
LIMIT = 2**63 - 1


def kept(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has `dims` components, none of them null or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~odd, F.lit(False))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); Python integers where 64 bits may not do."""
    if not x.size or np.abs(x).max() < 2.0**52 / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = [[scale * int(v) if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in row] for row in x.tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def _pack(m: np.ndarray) -> bytes:
    if m.dtype == object:
        return b"t" + " ".join(map(str, m.reshape(-1))).encode()
    most = int(np.abs(m).max(initial=0))
    kind = next(i for i in (1, 2, 4, 8) if most < 1 << (8 * i - 1))
    return b"%d" % kind + m.astype(f"<i{kind}").tobytes()


def _unpack(blob: bytes, rows: int) -> np.ndarray:
    if blob[:1] == b"t":
        return np.array([int(v) for v in blob[1:].split()], dtype=object).reshape(rows, -1)
    return np.frombuffer(blob[1:], f"<i{blob[:1].decode()}").astype(np.int64).reshape(rows, -1)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to y (a row, or a row for each)."""
    if x.dtype != object and y.dtype != object:
        most = int(np.abs(x).max(initial=0)) + int(np.abs(y).max(initial=0))
        if x.shape[1] * most**2 < 2**62:
            d = x - y
            return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - y.astype(object)
    return (d * d).sum(1)


def _roots(n: np.ndarray, beyond: float) -> np.ndarray:
    """Square roots as doubles; `beyond` where the number is too large for that."""
    if n.dtype != object:
        return np.sqrt(n.astype(float))
    return np.array([beyond if v > 10**300 else float(v) ** 0.5 for v in n])


@dataclass
class Centroids:
    """Centroids, how far each has moved, and each one's list of all in order of distance."""

    now: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.now)
        # a distance held too low only widens what is scanned
        self.ways = np.array([_roots(squares(self.now, c), 1e150) for c in self.now]).reshape(k, k)
        self.order = np.argsort(self.ways, axis=1, kind="stable")
        apart = np.where(np.eye(k, dtype=bool), np.inf, self.ways)
        self.next = apart.min(1, initial=np.inf)
        others = np.where(np.eye(k, dtype=bool), 0.0, self.moved[None, :])
        self.others_moved = others.max(1, initial=0.0)

    @classmethod
    def after(cls, old: np.ndarray, new: np.ndarray) -> Centroids:
        return cls(new, _roots(squares(new, old), np.inf) * (1 + SLACK))


@dataclass
class Block:
    """Vectors with their cluster and bounds; without: all are to be scanned."""

    x: np.ndarray
    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: int = 0

    def move(self, to: Centroids) -> None:
        """Assign each vector to its nearest centroid (ties: the lesser number)."""
        self.upper = self.upper + to.moved[self.cluster]
        self.lower = self.lower - to.others_moved[self.cluster]
        open_ = np.flatnonzero(self._open(np.arange(len(self.x)), to))
        if not len(open_):
            return
        own = squares(self.x[open_], to.now[self.cluster[open_]])
        self.scanned += len(open_)
        seen = np.isfinite(self.upper[open_])  # a new vector has no centroid of its own yet
        self.upper[open_] = np.where(seen, _roots(own, np.inf) * (1 + SLACK), np.inf)
        still = self._open(open_, to)
        open_, own = open_[still], own[still]
        start = self.cluster[open_]
        for a in np.unique(start).tolist():
            self._scan(open_[start == a], own[start == a], a, to)

    def _open(self, at: np.ndarray, to: Centroids) -> np.ndarray:
        bound = np.maximum(self.lower[at], to.next[self.cluster[at]] / 2)
        return ~(self.upper[at] * (1 + SLACK) + SLACK < bound)

    def _scan(self, at: np.ndarray, own: np.ndarray, a: int, to: Centroids) -> None:
        """Search the ball around centroid a for vectors `at`, whose exact squared distances to a are own."""
        radius = 2 * self.upper[at] + to.next[a]
        listed = to.order[a]
        reach = np.searchsorted(to.ways[a][listed], radius * (1 + SLACK) + SLACK, "right")
        by_reach = np.argsort(-reach, kind="stable")
        at, own, reach = at[by_reach], own[by_reach], reach[by_reach]
        best, number = own.copy(), np.full(len(at), a)
        second = np.full(len(at), None, dtype=object) if own.dtype == object else np.full(len(at), LIMIT)
        x = self.x[at]
        for r, j in enumerate(listed.tolist()):
            n = int(np.searchsorted(-reach, -r, "left"))  # the first n reach beyond r
            if not n:
                break
            if j == a:
                continue
            d = squares(x[:n], to.now[j])
            if d.dtype == object and best.dtype != object:
                best, second = best.astype(object), np.array([None if v == LIMIT else v for v in second.tolist()], dtype=object)
            self.scanned += n
            b = best[:n]
            wins = (d < b) | ((d == b) & (j < number[:n]))
            out = np.where(wins, b, d)
            if second.dtype == object:
                second[:n] = [o if s is None or o < s else s for o, s in zip(out, second[:n])]
            else:
                second[:n] = np.minimum(second[:n], out)
            best[:n] = np.where(wins, d, b)
            number[:n] = np.where(wins, j, number[:n])
        self.cluster[at] = number
        self.upper[at] = _roots(best, np.inf) * (1 + SLACK)
        if second.dtype == object:
            self.lower[at] = [np.inf if s is None else min(float(min(s, 10**300)) ** 0.5, 1e150) * (1 - SLACK) for s in second]
        else:
            self.lower[at] = np.where(second == LIMIT, np.inf, np.sqrt(second.astype(float)) * (1 - SLACK))


_STATE = "ids array<bigint>, vectors binary, cluster binary, upper binary, lower binary, scanned long, sums array<struct<cluster:int,dim:int,part:int,value:bigint>>"
_NAMES = ["ids", "vectors", "cluster", "upper", "lower", "scanned", "sums"]
_SUM = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("part", pa.int32()), ("value", pa.int64())]))


def _row(ids: list, vectors: bytes | None, cluster: bytes | None, upper: bytes | None, lower: bytes | None, scanned: int, sums: list) -> pa.RecordBatch:
    kinds = (pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), _SUM)
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((ids, vectors, cluster, upper, lower, scanned, sums), kinds)], _NAMES)


def blocks(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """Vectors that take part, packed, without bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                yield _row(batch.column(0).to_pylist(), _pack(integers(x, scale)), None, None, None, 0, [])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter(kept(F.col("vector"), dims)).mapInArrow(run, _STATE)


def _loaded(batch: pa.RecordBatch) -> Iterator[tuple[list, Block]]:
    for r in batch.to_pylist():
        n = len(r["ids"] or ())
        if not n:
            continue
        if r["cluster"] is None:
            held = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
        else:
            held = np.frombuffer(r["cluster"], "<i4").astype(np.int64), np.frombuffer(r["upper"]), np.frombuffer(r["lower"])
        yield r["ids"], Block(_unpack(r["vectors"], n), *held)


class _Sums:
    """Number and sum of the vectors of each cluster."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[int, np.ndarray]] = {}

    def add(self, block: Block) -> None:
        x = block.x
        if x.dtype != object and len(x) * int(np.abs(x).max(initial=0)) >= 2**62:
            x = x.astype(object)
        for c in np.unique(block.cluster).tolist():
            own = x[block.cluster == c]
            n, total = self.held.get(c, (0, 0))
            self.held[c] = n + len(own), total + own.sum(0).astype(object)

    def rows(self) -> list[dict]:
        out = []
        for c, (n, total) in self.held.items():
            for dim, value in enumerate([n, *total.tolist()], -1):
                for part, v in enumerate(_parts(value)):
                    out.append({"cluster": c, "dim": dim, "part": part, "value": v})
        return out


def _parts(value: int) -> list[int]:
    """A number as parts of 32 bits, the last signed."""
    out = []
    while not -(2**31) <= value < 2**31:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def _moved(state: DataFrame, to: Centroids) -> DataFrame:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for ids, block in _loaded(batch):
                block.move(to)
                sums.add(block)
                yield _row(ids, _pack(block.x), block.cluster.astype("<i4").tobytes(), block.upper.tobytes(), block.lower.tobytes(), block.scanned, [])
        yield _row([], None, None, None, None, 0, sums.rows())

    return state.mapInArrow(run, _STATE)


def _means(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor(sum / count), of empty clusters the old one."""
    parts = state.select(F.explode("sums").alias("s")).groupBy("s.cluster", "s.dim", "s.part").agg(F.sum("s.value").alias("value"))
    total: dict[int, dict[int, int]] = {}
    for r in parts.collect():  # k x (dims + 1) numbers, in parts
        own = total.setdefault(r["cluster"], {})
        own[r["dim"]] = own.get(r["dim"], 0) + (r["value"] << 32 * r["part"])
    rows = [[total[c][d] // total[c][-1] for d in range(old.shape[1])] if c in total else list(map(int, old[c])) for c in range(len(old))]
    return _matrix(rows, old.shape[1])


def _matrix(rows: list[list[int]], dims: int) -> np.ndarray:
    narrow = all(abs(v) < 2**62 for r in rows for v in r)
    return np.array(rows, dtype=np.int64 if narrow else object).reshape(len(rows), dims)


def first_centroids(vectors: DataFrame, key: str, vector: str, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:id`."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("key").isNotNull() & kept(F.col("vector"), dims))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    found = rows.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return _matrix([integers(np.array([r["vector"]], float), scale)[0].tolist() for r in found], dims)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, int]:
    """(id, cluster, distance of every vector; centroids; how many distances were computed) after `rounds` rounds and one more assignment."""
    scratch = Scratch(vectors.sparkSession)
    now = first_centroids(vectors, key, vector, k, dims, scale, seed)
    if not len(now):  # without a centroid there is nothing to be near
        empty = vectors.select(F.col(key).cast("long").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return empty, now, 0
    state, to, scanned = scratch.write(blocks(vectors, key, vector, dims, scale), rows=2000), Centroids(now, np.zeros(len(now))), 0
    for turn in range(rounds + 1):
        last, state = state, scratch.write(_moved(state, to), rows=64)
        scratch.drop(last)
        scanned += state.agg(F.sum("scanned")).first()[0] or 0
        if turn < rounds:
            to = Centroids.after(to.now, _means(state, to.now))

    def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = to.now) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in _loaded(batch):
                d = squares(block.x, now[block.cluster])
                d = np.array([min(v, LIMIT) for v in d], np.int64) if d.dtype == object else d
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(block.cluster, pa.int32()), pa.array(d, pa.int64())], [key, "cluster", "distance"])

    out = state.select(*_NAMES).mapInArrow(run, f"`{key}` long, cluster int, distance long")
    return scratch.write(out), to.now, scanned


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector, with its cluster's inertia and centroid."""
    found, centroids, _ = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    by = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    held = lambda n: F.lit(min(n, LIMIT)).cast("long")
    inertia = [held(by.get(c, 0)) for c in range(len(centroids))] or [held(0)]
    of = lambda values: F.array(*values)[F.col("cluster")]
    return found.select("vec_id", "cluster", "distance", of(inertia).alias("cluster_inertia"), held(sum(by.values())).alias("inertia"), of([F.lit(d) for d in digests] or [F.lit("")]).alias("centroid_sha256"))


def oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """The same by plain k-means: every distance, in every round."""
    finite = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND {finite})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v.e, c{t}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c{t}.c)) AS x FROM v CROSS JOIN c{t} GROUP BY r)")
        if t < rounds:
            steps.append(f"s{t} AS (SELECT x.c AS c, i, sum(v.e[i]) AS s, count(*) AS n FROM a{t} JOIN v USING (r), range(1, 65) AS g(i) GROUP BY x.c, i)")
            steps.append(f"m{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{t} GROUP BY c)")
            steps.append(f"c{t + 1} AS (SELECT c{t}.c, coalesce(m{t}.e, c{t}.e) AS e FROM c{t} LEFT JOIN m{t} ON m{t}.c = c{t}.c)")
    last = f"SELECT v.vec_id, x.c AS cluster, CAST(x.d AS BIGINT) AS distance, CAST(sum(x.d) OVER (PARTITION BY x.c) AS BIGINT) AS cluster_inertia, CAST(sum(x.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = x.c"
    return f"WITH {', '.join(steps)} {last}"
