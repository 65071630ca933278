"""What the training-data operators share: word patterns, input paths and scratch tables."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, wraps

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words, as every operator here understands them (ASCII white space only).
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch while a scratch table is written.
ROWS = 2000
#: Bytes of such a batch, but for a single row.
BYTES = 16 << 20
_BATCH_ROWS, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty. Stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@lru_cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="fichero-scratch-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset and all runs on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _own_folder()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives freed memory back to the machine when its task ends: workers live on."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)

    return whole


def small_batches(spark: SparkSession, rows: int = ROWS) -> dict[str, str]:
    """Let Python workers get batches of few rows and bytes from now on; the settings before. Whole texts are in them."""
    before = {name: spark.conf.get(name) for name in (_BATCH_ROWS, _BATCH_BYTES)}
    most = int(before[_BATCH_ROWS])
    spark.conf.set(_BATCH_ROWS, str(min(rows, most) if most > 0 else rows))
    spark.conf.set(_BATCH_BYTES, str(BYTES))
    return before


#: Seconds after which the driver gives memory back with the next table written.
BETWEEN = 5
#: Slots of a block of Marks.
MARKS = 1 << 15


class Marks:
    """A table of 2^bits bits; its blocks are compressed on the driver, on their way and on disks."""

    def __init__(self, packed: dict[int, bytes], bits: int):
        self.packed, self.bits = packed, bits

    @cached_property
    def table(self) -> np.ndarray:
        """The bits, eight a byte."""
        out = np.zeros(((1 << self.bits) // MARKS, MARKS // 8), np.uint8)
        for block, marks in self.packed.items():
            out[block] = np.frombuffer(pa.decompress(marks, MARKS // 8, codec="zstd", asbytes=True), np.uint8)
        return out.reshape(-1)


def marked_slots(slots: DataFrame, bits: int) -> Marks:
    """A table of 2^bits bits in which the slots (a column of numbers) are set."""
    size = MARKS

    @trimmed
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False)
            block = slot // size
            for b in np.unique(block):
                own.setdefault(int(b), np.zeros(size, bool))[slot[block == b] % size] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([pa.compress(np.packbits(v).tobytes(), codec="zstd", asbytes=True) for v in own.values()], pa.binary())], ["block", "bits"])

    slot = F.col(slots.columns[0]).cast("long")
    marked = slots.select(slot.alias("slot")).repartition(F.floor(F.col("slot") / size)).mapInArrow(mark, "block int, bits binary")
    return Marks({r["block"]: bytes(r["bits"]) for r in marked.collect()}, bits)  # 2^bits bits at most, before compression


def give_back(spark: SparkSession) -> str | None:
    """Let the driver's JVM collect its garbage and give freed memory back to the machine, as `trimmed` does in workers.

    Between steps its heap grows by garbage, and its compiler threads and its collector free much outside the heap,
    which the C library keeps. That is given back by the JVM's diagnostic command System.trim_native_heap, whose answer
    is returned; a JVM without it only collects.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    args = new(jvm.Object, 4)
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.Object, 0), new(jvm.String, 0)
        # by the public interface, as the server's class is not open to others
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive lost executors.

    A table is deleted by `drop`, or when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/fichero-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.given = time.monotonic()
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def write(self, df: DataFrame, codec: str = "zstd", rows: int = ROWS) -> DataFrame:
        """df as a written table. rows: most rows of a batch that Python workers get meanwhile."""
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        before = small_batches(self.spark, rows)  # bounds the workers' memory
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)
        if time.monotonic() - self.given > BETWEEN:
            self._give_back()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._fichero_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        fs, where = self._fs(df._fichero_path)
        fs.delete(where, True)

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps, instead of at its next garbage collection, and the driver give memory back."""
        import gc

        gc.collect()
        self._give_back()

    def _give_back(self) -> None:
        give_back(self.spark)
        self.given = time.monotonic()
