"""Streams: documents that arrive in a folder, and the product of each session."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def state_in_files(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, outside the heap, unless another store has been chosen; keyed state with a lifetime needs it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def once(stream: DataFrame, key: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key that a stream brings, told by keyed state.

    With an event time, keys are forgotten `delay` after the latest one, so the state is bounded; a row that
    comes twice must come within that time. Without one all keys are kept.
    """
    if event_time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def sync(stream: DataFrame, target: str, checkpoint: str, key: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, event_time: str | None = None, delay: str = "1 day", log: MetricsLog | None = None) -> StreamingQuery:
    """Take in all that has arrived, then stop: each key is appended once, by any number of runs with the same checkpoint.

    Which keys have come is the stream's own state (see `once`): the target is never read. The batch number is the folder's
    name, so a batch that is run again after a failure replaces its own files. log: gets rows and keys of each batch.
    """
    state_in_files(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = once(stream, key, event_time, delay)
    if log is not None:
        rows = rows.observe(log.name, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.struct(*key)).alias("keys"))
        log.follow(stream.sparkSession)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MetricsLog(StreamingQueryListener):
    """What a stream observed, a row for each batch: name, batch, rows, keys, seconds; written when the stream ends."""

    SCHEMA = "name string, run string, batch long, rows long, keys long, input_rows long, seconds double"

    def __init__(self, name: str, path: str):
        self.name, self.path, self.rows, self.spark, self.done = name, path, [], None, threading.Event()

    def follow(self, spark: SparkSession) -> None:
        self.spark = spark
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is not None:
            self.rows.append((self.name, str(p.runId), p.batchId, seen["rows"], seen["keys"], p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.done.set()

    def write(self, timeout: float = 60) -> DataFrame:
        """Append the rows of the stream that has ended to the path; the listener is taken off."""
        self.done.wait(timeout)
        self.spark.streams.removeListener(self)
        out = self.spark.createDataFrame(self.rows, self.SCHEMA)  # a row for each batch
        out.write.mode("append").parquet(self.path)
        return out


class _Products(StatefulProcessor):
    """The product of a session: that of its latest turn that named one, forgotten by a reset or when its lifetime ends."""

    def __init__(self, lifetime_ms: int | None):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.product = handle.getValueState("product", "product string", self.lifetime_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.product.get() if self.product.exists() else None
        known = held[0] if held is not None else None
        # of a batch's turns only number, product and reset are held, to be put in order
        parts = [(r["turn"].to_numpy(), r["product"].to_numpy(dtype=object), r["reset"].to_numpy(dtype=object)) for r in rows]
        turn, product, reset = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(turn, kind="stable")
        context = np.empty(len(order), dtype=object)
        for i in order.tolist():
            if reset[i] is True or reset[i] == 1:
                known = None
            context[i] = known
            known = product[i] if isinstance(product[i], str) else known
        if known is None:
            self.product.clear()
        else:
            self.product.update((known,))
        for a in range(0, len(order), ROWS):
            at = order[a : a + ROWS]
            yield pd.DataFrame({"session_id": key[0], "turn": turn[at], "product": product[at], "context": context[at]})

    def close(self) -> None: ...


#: Rows of a batch that the processor gives out.
ROWS = 10_000


def session_products(turns: DataFrame, minutes: float | None = None) -> DataFrame:
    """session_id, turn, product, context of a stream of turns (session_id, turn, product, reset): keyed state with a lifetime.

    Turns of one batch are taken in order of turn. `minutes` after its last turn that told a product a session is
    forgotten, by the state store itself; by default none is. A true reset forgets at once. (With a lifetime, start the
    query with trigger(once=True): clocks go on, so availableNow finds no end.)
    """
    state_in_files(turns.sparkSession)
    lifetime = None if minutes is None else int(minutes * 60_000)
    schema = "session_id string, turn long, product string, context string"
    return turns.groupBy("session_id").transformWithStateInPandas(_Products(lifetime), schema, "append", "none" if lifetime is None else "ProcessingTime")
