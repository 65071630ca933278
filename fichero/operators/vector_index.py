"""Nearest vectors by an inverted file of cells: a search reads only cells that can hold a hit, and proves it.

Cells are those of spherical k-means, fitted on a bounded sample; every vector is then assigned to the cell of its
nearest centroid and written, packed, in the folder of its kind and cell (`slot`). Of each slot the index knows its size and its
radius: the widest angle between its centroid and a member. No member of a slot is nearer to a question than
the angle to the centroid less the radius. A search reads the nearest slots of each kind until these hold k vectors,
which bounds the k-th similarity, and then only those slots whose bound reaches it. So it is exact, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.vectors import unit
from ..shared import settled
from ..sources import sinks

#: Most cells, most vectors that they are fitted on, rounds of fitting.
CELLS, SAMPLE, ROUNDS = 4096, 8192, 8
#: Bytes of vectors of a packed row, and questions that are planned at once.
PACK_BYTES, BLOCK = 4 << 20, 256
#: Room for rounding of angles.
SLACK = 1e-6

_FINITE = "size(v) = {size} and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length; the sample's rows are of unit length. Cells that lose all members keep their centroid."""
    now = sample[:cells].copy()
    for _ in range(rounds):
        own = (sample @ now.T).argmax(1)
        sums = np.zeros_like(now)
        np.add.at(sums, own, sample)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        now[some] = unit(sums[some])
    return now


class VectorIndex:
    """An inverted file below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return sinks.exists(self.spark, f"{self.path}/slots/_SUCCESS")

    def build(self, rows: DataFrame, row_id: str = "id", vector: str = "embedding", kind: str = "tipo", cells: int | None = None, size: int | None = None) -> VectorIndex:
        """Write the index of rows. cells: by default the root of the number of vectors, CELLS at most. size: length of the vectors, by default the most frequent.

        Vectors that are null, of other length, or hold a null or non-finite component take no part; nor do rows without id.
        Kinds are few (a folder each); a null kind is one, too.
        """
        element = rows.schema[vector].dataType.elementType
        wide = isinstance(element, DoubleType)
        given = rows.select(F.col(row_id).alias("id"), F.col(vector).cast(ArrayType(DoubleType())).alias("v"), F.col(kind).cast("string").alias("tipo")).filter("id is not null and v is not null")
        if size is None:
            most = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
            size = most["n"] if most else 0
        given = given.filter(_FINITE.format(size=size))
        count = given.count()
        cells = max(1, min(cells or round(count**0.5), CELLS, count))
        sample = given.select("v").orderBy(F.xxhash64("id"), "id").limit(max(cells, SAMPLE)).collect()  # max(CELLS, SAMPLE) vectors at most
        centroids = fit(unit(np.array([r["v"] for r in sample], float)), cells) if sample else np.zeros((0, size))
        kinds = [r[0] for r in given.select("tipo").distinct().orderBy("tipo").collect()]
        number = F.coalesce(*[F.when(F.col("tipo").eqNullSafe(F.lit(k)), F.lit(i)) for i, k in enumerate(kinds)], F.lit(0))
        pack = "<f8" if wide else "<f4"
        id_type = given.schema["id"].dataType.simpleString()

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack(batch["v"].to_numpy())
                cell = np.concatenate([(unit(x[a : a + 1024]) @ centroids.T).argmax(1) for a in range(0, len(x), 1024)])
                yield pd.DataFrame({"slot": (batch["kind"] * cells + cell).astype("int32"), "id": batch["id"], "v": [r.tobytes() for r in x.astype(pack)]})

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []

            def row() -> pd.DataFrame:
                part = pd.concat(held)
                slot = int(part["slot"].iloc[0])
                x = np.frombuffer(b"".join(part["v"]), pack).reshape(len(part), -1).astype(float)
                low = float((unit(x) @ centroids[slot % cells]).min()) if size else 1.0
                return pd.DataFrame({"slot": [slot], "ids": [part["id"].tolist()], "vectors": [b"".join(part["v"])], "low": [low]})

            most = max(1, PACK_BYTES // max(1, 8 * size))
            for batch in batches:
                for _, part in batch.groupby("slot", sort=False):
                    for a in range(0, len(part), most):
                        some = part.iloc[a : a + most]
                        if held and (held[0]["slot"].iloc[0] != some["slot"].iloc[0] or sum(map(len, held)) + len(some) > most):
                            yield row()
                            held = []
                        held.append(some)
            if held:
                yield row()

        dealt = given.withColumn("kind", number).select("id", "v", "kind").mapInPandas(assign, f"slot int, id {id_type}, v binary")
        # adaptive execution cuts partitions that a large cell would overfill
        shards = dealt.hint("rebalance", "slot").sortWithinPartitions("slot").mapInPandas(packed, f"slot int, ids array<{id_type}>, vectors binary, low double")
        shards.write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/shards")
        schema = f"ids array<{id_type}>, vectors binary, low double, slot int"
        slots = self._read(schema).groupBy("slot").agg(F.min("low").alias("low"), F.sum(F.size("ids")).alias("n")) if count else self.spark.createDataFrame([], "slot int, low double, n long")
        named = F.get(F.array(*[F.lit(k).cast("string") for k in kinds] or [F.lit(None).cast("string")]), F.floor(F.col("slot") / cells).cast("int"))
        slots.withColumn("tipo", named).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/slots")
        meta = [(int(cells), int(size), pack, id_type, centroids.astype("<f8").tobytes())]
        self.spark.createDataFrame(meta, "cells int, size int, pack string, id_type string, centroids binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        return self

    def _read(self, schema: str, slots: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/shards")
        return rows if slots is None else rows.filter(F.col("slot").isin(slots))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector") -> tuple[DataFrame, DataFrame]:
        """(query_id, id, tipo, similarity, rank of the k rows of each kind with the greatest cosine; query_id, tipo, cells_read, cells, rows_read, rows).

        Like vectors.nearest, but for vectors of the index's length only. Centroids, sizes and radii of slots (kinds x
        CELLS at most) are read into the driver and go to all tasks.
        """
        meta = self.spark.read.parquet(f"{self.path}/centroids").first()
        slots = self.spark.read.parquet(f"{self.path}/slots").orderBy("slot").collect()
        cells, size, pack, id_type = meta["cells"], meta["size"], meta["pack"], meta["id_type"]
        q_type = queries.schema[query_id].dataType.simpleString()
        schema = f"ids array<{id_type}>, vectors binary, low double, slot int"
        kinds = list(dict.fromkeys(r["tipo"] for r in slots))
        if not slots:
            none = queries.select(F.col(query_id).alias("query_id"), F.lit(None).cast(id_type).alias("id"), F.lit("").alias("tipo"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
            return none, none.select("query_id", "tipo", *[F.lit(0).cast("long").alias(c) for c in ("cells_read", "cells", "rows_read", "rows")])
        centroids = np.frombuffer(meta["centroids"], "<f8").reshape(cells, size)
        slot, n = np.array([r["slot"] for r in slots]), np.array([r["n"] for r in slots])
        radius = np.arccos(np.clip([r["low"] for r in slots], -1, 1)) + SLACK
        of_kind = [np.flatnonzero([r["tipo"] == kind for r in slots]) for kind in kinds]

        given = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast(ArrayType(DoubleType())).alias("v")).filter("query_id is not null and v is not null").filter(_FINITE.format(size=size))
        asked = settled(given, "asked")

        def first_of(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            """Upper bounds of similarity (questions x slots), and for each kind which of its slots, by bound, are read at first."""
            bound = np.cos(np.maximum(0, np.arccos(np.clip(unit(x) @ centroids[slot % cells].T, -1, 1)) - radius))
            first = []
            for own in of_kind:
                order = np.argsort(-bound[:, own], axis=1, kind="stable")
                before = np.cumsum(n[own][order], axis=1) - n[own][order]
                take = np.zeros(order.shape, bool)
                np.put_along_axis(take, order, before < k, 1)
                first.append(take)
            return bound, first

        def plan(second: bool):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for a in range(0, len(batch), BLOCK):
                        part = batch.iloc[a : a + BLOCK]
                        x = np.stack(part["v"].to_numpy())
                        bound, first = first_of(x)
                        ids, blobs = part["query_id"].to_numpy(), unit(x)
                        for i, own in enumerate(of_kind):
                            take = first[i]
                            if second:
                                take = ~take & (bound[:, own] >= np.stack(part["least"].to_numpy())[:, [i]] - SLACK)
                            for j in np.flatnonzero(take.any(0)).tolist():
                                q = np.flatnonzero(take[:, j])
                                yield pd.DataFrame({"slot": pd.Series([slot[own[j]]], dtype="int32"), "asked": [ids[q].tolist()], "weights": [blobs[q].tobytes()]})

            return run

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list[pd.DataFrame] = []

            def cut() -> pd.DataFrame:
                every = pd.concat(best, ignore_index=True)
                return every.sort_values(["query_id", "tipo", "shown", "id"], kind="stable").groupby(["query_id", "kind"]).head(k)

            for batch in batches:
                for r in batch.itertuples(index=False):
                    held = unit(np.frombuffer(r.vectors, pack).reshape(len(r.ids), size).astype(float))
                    cosines = np.frombuffer(r.weights).reshape(-1, size) @ held.T
                    shown = np.round(cosines, 9)
                    # the k greatest, with all ties of the last
                    q, j = np.nonzero(shown >= np.partition(shown, len(r.ids) - k, 1)[:, [len(r.ids) - k]]) if len(r.ids) > k else np.nonzero(np.ones(shown.shape, bool))
                    kind = r.slot // cells
                    best.append(pd.DataFrame({"query_id": np.asarray(r.asked)[q], "id": np.asarray(r.ids)[j], "tipo": kinds[kind_of[kind]], "kind": kind, "shown": -shown[q, j], "similarity": cosines[q, j]}))
                if sum(map(len, best)) > 200_000:
                    best[:] = [cut()]
            if best:
                yield cut()[["query_id", "id", "tipo", "similarity"]]

        kind_of = {int(slot[own[0]] // cells): i for i, own in enumerate(of_kind)}

        def read(wanted: DataFrame) -> DataFrame:
            """Hits in the wanted slots: no other folder is read."""
            names = [r[0] for r in wanted.select("slot").distinct().collect()]  # kinds x CELLS at most
            pairs = wanted.join(self._read(schema, names).drop("low"), "slot")
            return pairs.select("slot", "asked", "weights", "ids", "vectors").mapInPandas(compare, f"query_id {q_type}, id {id_type}, tipo string, similarity double")

        order = Window.partitionBy("query_id", "tipo").orderBy(F.round("similarity", 9).desc(), F.col("id"))
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        wanted_schema = f"slot int, asked array<{q_type}>, weights binary"
        first = settled(asked.mapInPandas(plan(False), wanted_schema), "plan")
        found = settled(ranked(read(first)), "found")
        least = found.filter(F.col("rank") == k).groupBy("query_id")
        known = [F.coalesce(F.max(F.when(F.col("tipo").eqNullSafe(F.lit(kind)), F.col("similarity"))), F.lit(2.0)).alias(f"k{i}") for i, kind in enumerate(kinds)]
        # a kind with fewer than k hits has been read whole
        taus = least.agg(*known).select("query_id", F.array(*[f"k{i}" for i in range(len(kinds))]).alias("least"))
        second = settled(asked.join(taus, "query_id").mapInPandas(plan(True), wanted_schema), "plan")
        hits = ranked(found.drop("rank").unionByName(read(second)))

        sizes = self.spark.createDataFrame([(int(s), int(c), kinds.index(r["tipo"])) for s, c, r in zip(slot, n, slots)], "slot int, n long, kind int")
        of = sizes.groupBy("kind").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"))
        read_by = first.unionByName(second).select("slot", F.explode("asked").alias("query_id")).join(F.broadcast(sizes), "slot").groupBy("query_id", "kind").agg(F.count(F.lit(1)).alias("cells_read"), F.sum("n").alias("rows_read"))  # a row for each slot
        name = F.get(F.array(*[F.lit(kind).cast("string") for kind in kinds]), F.col("kind"))
        told = read_by.join(F.broadcast(of), "kind").select("query_id", name.alias("tipo"), "cells_read", "cells", "rows_read", "rows")
        return hits, told
