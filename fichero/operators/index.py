"""The chunk index: incremental ingestion, lookups and listings."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..functions import vectors
from ..shared import settled
from ..sources import sinks
from .vector_index import VectorIndex


#: Buckets of an index that is created here; an index keeps its own number.
BUCKETS = 8
_TABLE_SCHEMA = f"{schemas.INDEXED}, tipo_contenido string"


class Index:
    """Chunks below a path, in buckets by id, sorted, with a Bloom filter of ids. Of chunks of one id the latest version counts.

    So a lookup reads one bucket, what joins or groups the index by id does not shuffle it, and ingestion deals out the
    new chunks once, by the index's buckets. A generation is a folder, read as a bucketed table of the session's catalogue; the
    file CURRENT names the one that counts and its number of buckets. Ingestion appends to it. What rewrites the
    index writes a new generation and then replaces that file, so a failure in between leaves the old one in place; that
    is kept until the next such change, for readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _generation(self) -> str:
        """Number of the generation and of its buckets."""
        return sinks.read_word(self.spark, f"{self.path}/CURRENT") or f"0-{self.buckets}"

    def _folder(self, generation: str | None = None) -> str:
        return f"{self.path}/generation-{generation or self._generation()}"

    def _table(self, generation: str | None = None) -> str:
        """The table of a generation, known to the session's catalogue from now on."""
        generation = generation or self._generation()
        folder = self._folder(generation)
        name = f"fichero_{hashlib.md5(folder.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            sinks.make_folder(self.spark, folder)
            options = "'parquet.bloom.filter.enabled#id' 'true'"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_TABLE_SCHEMA}) USING parquet OPTIONS ({options}) CLUSTERED BY (id) SORTED BY (id) INTO {generation.split('-')[1]} BUCKETS LOCATION '{folder}'")
        return name

    def _append(self, rows: DataFrame, generation: str) -> None:
        """One file a bucket: rows are dealt out as the table is, if they are not yet."""
        name, buckets = self._table(generation), int(generation.split("-")[1])
        rows = rows.withColumn("tipo_contenido", F.coalesce("metadata.tipo_contenido", F.lit("texto"))).filter(F.col("tipo_contenido").isin(fixed.KINDS))
        rows.select(*schemas.INDEX_COLUMNS, "tipo_contenido").repartition(buckets, "id").write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def _rows(self) -> DataFrame:
        name = self._table()
        self.spark.catalog.refreshTable(name)  # other sessions may have added files
        return self.spark.table(name)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """rows without superseded ones: by buckets, without a shuffle."""
        last = rows.groupBy("id").agg(F.max("version").alias("_last"))
        # not an equality: that would become a key of the join, and keys other than the buckets' shuffle
        return rows.join(last, "id").filter("version >= _last").drop("_last")

    def chunks(self) -> DataFrame:
        """All chunks (schemas.CHUNK, doc_key, tipo_contenido), each id once."""
        return self._latest(self._rows()).select(*schemas.CHUNK_COLUMNS, "doc_key", "tipo_contenido")

    def _given(self, chunks: DataFrame) -> DataFrame:
        """Chunks of known kinds with document and hash, dealt out as the index is."""
        rows = chunks.withColumn("tipo_contenido", F.coalesce("metadata.tipo_contenido", F.lit("texto"))).filter(F.col("tipo_contenido").isin(fixed.KINDS))
        rows = rows.withColumn("content_hash", F.md5(F.col("content").cast("binary")))
        return rows if "doc_key" in rows.columns else rows.withColumn("doc_key", F.lit(None).cast("string"))

    def _new(self, rows: DataFrame, held: DataFrame, generation: str) -> DataFrame:
        """Each of rows with `_known`: whether held (id, content_hash) has it. Held is not shuffled."""
        known = held.groupBy("id").agg(F.collect_set("content_hash").alias("_hashes"))  # an id's latest version: one, or more where ids were repeated
        dealt = rows.repartition(int(generation.split("-")[1]), "id")
        return dealt.join(known, "id", "left").withColumn("_known", F.coalesce(F.array_contains("_hashes", F.col("content_hash")), F.lit(False))).drop("_hashes")

    def ingest(self, chunks: DataFrame, skip_existing: bool = True) -> DataFrame:
        """Append what is new or changed; returns kind, status (added, skipped), count. Kinds that are not known are left out.

        A chunk is known by id and content; changed content becomes the next version of its id. Of the index only
        ids, versions and stored hashes are read.
        """
        if not sinks.exists(self.spark, f"{self.path}/CURRENT"):
            sinks.make_folder(self.spark, self.path)
            sinks.write_word(self.spark, f"{self.path}/CURRENT", self._generation())
        return self._ingested(chunks, self._latest(self._rows().select("id", "content_hash", "version")), self._generation(), skip_existing)

    def _ingested(self, chunks: DataFrame, held: DataFrame, generation: str, skip_existing: bool) -> DataFrame:
        rows = self._given(chunks)
        # read twice: for what is told and for what is written
        marked = settled(self._new(rows, held, generation) if skip_existing else rows.withColumn("_known", F.lit(False)), "marked")
        told = marked.groupBy("tipo_contenido", F.when(F.col("_known"), "skipped").otherwise("added").alias("status")).count()
        told = self.spark.createDataFrame(told.collect(), told.schema)  # kinds by two
        version = (held.agg(F.max("version")).first()[0] or 0) + 1
        new = marked.filter(~F.col("_known"))
        new = new.dropDuplicates(["id", "content_hash"]) if skip_existing else new
        self._append(new.withColumn("version", F.lit(version).cast("long")), generation)
        return told

    def build_vectors(self, cells: int | None = None) -> VectorIndex:
        """Write an inverted file of the vectors of all chunks, in place of the last one; searches use it until the index changes."""
        fresh = f"{int(sinks.read_word(self.spark, f'{self.path}/VECTORS.CURRENT') or 0) + 1}"
        rows = self.chunks().select("id", "embedding", F.col("tipo_contenido").alias("tipo"))
        state = self._state()
        built = VectorIndex(self.spark, f"{self.path}/vectors-{fresh}").build(rows, cells=cells)
        sinks.make_folder(self.spark, built.path)
        sinks.write_word(self.spark, f"{built.path}/STATE", state)
        sinks.write_word(self.spark, f"{self.path}/VECTORS.CURRENT", fresh)
        sinks.remove(self.spark, f"{self.path}/vectors-{int(fresh) - 2}")
        return built

    def _state(self) -> str:
        """What changes whenever chunks are added or left out."""
        most, n = self._rows().agg(F.max("version"), F.count(F.lit(1))).first()
        return f"{self._generation()}-{most}-{n}"

    def vectors(self) -> VectorIndex | None:
        """The inverted file, if there is one of just these chunks."""
        fresh = sinks.read_word(self.spark, f"{self.path}/VECTORS.CURRENT")
        if fresh is None or sinks.read_word(self.spark, f"{self.path}/vectors-{fresh}/STATE") != self._state():
            return None
        return VectorIndex(self.spark, f"{self.path}/vectors-{fresh}")

    def nearest(self, queries: DataFrame, k: int = fixed.CANDIDATES) -> DataFrame:
        """query_id, id, tipo, similarity, rank: k chunks of each kind for each query (query_id, query_vector); by the inverted file where it is up to date."""
        built = self.vectors()
        if built is not None:
            return built.search(queries, k)[0]
        return vectors.nearest(queries, self.chunks().select("id", "embedding", F.col("tipo_contenido").alias("tipo")), k)

    def get(self, chunk_id: str) -> DataFrame:
        """id, content, metadata and length of the vector of one chunk; empty if there is none."""
        found = self._latest(self._rows().filter(F.col("id") == chunk_id))  # of one bucket
        return found.select("id", "content", "metadata", F.size("embedding").alias("dim"))

    def ids(self) -> DataFrame:
        return self.chunks().select("id")

    def sample(self, n: int = 50) -> DataFrame:
        return self.chunks().orderBy("id").limit(n)

    def counts(self) -> DataFrame:
        return self.chunks().groupBy("tipo_contenido").count()

    def verify(self) -> DataFrame:
        """The first text chunk, looked up again."""
        first = self.chunks().filter(F.col("tipo_contenido") == "texto").orderBy("id").limit(1).select("id")
        return self.chunks().join(F.broadcast(first), "id").select("id", "content", "metadata", F.size("embedding").alias("dim"))  # one row

    def where_section(self, section: str, n: int = 5) -> DataFrame:
        """The first chunks, by id, of a section."""
        return self.chunks().filter(F.col("metadata.seccion") == section).orderBy("id").limit(n)

    def where_product(self, part: str, n: int | None = 5) -> DataFrame:
        """The first chunks, by id, whose product holds a text, case and all (n None: all of them)."""
        found = self.chunks().filter(F.col("metadata.producto").contains(part))
        return found if n is None else found.orderBy("id").limit(n)

    def forget(self, documents: DataFrame) -> None:
        """Leave out the chunks of documents: by doc_key, or by codigo_producto if that is the column."""
        self.replace(documents)

    def replace(self, documents: DataFrame, chunks: DataFrame | None = None) -> DataFrame | None:
        """Leave out the chunks of documents and take in others, as one step for readers; returns what `ingest` does."""
        by = "doc_key" if "doc_key" in documents.columns else "codigo_producto"
        rows = self._latest(self._rows())
        gone = documents.select(F.col(by).alias("_gone")).filter("_gone is not null").distinct()
        kept = rows.join(gone, (F.col("doc_key") if by == "doc_key" else F.col("metadata.codigo_producto")) == F.col("_gone"), "left_anti")
        number = int(self._generation().split("-")[0])
        fresh = f"{number + 1}-{self.buckets}"
        if sinks.exists(self.spark, self._folder(fresh)):  # of a change that failed
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(fresh)}")
            sinks.remove(self.spark, self._folder(fresh))
        self._append(kept, fresh)
        told = None
        if chunks is not None:
            told = self._ingested(chunks, self.spark.table(self._table(fresh)).select("id", "content_hash", "version"), fresh, True)
        sinks.write_word(self.spark, f"{self.path}/CURRENT", fresh)
        for old in sinks.names(self.spark, self.path):
            if old.startswith("generation-") and int(old.split("-")[1]) < number:
                sinks.remove(self.spark, f"{self.path}/{old}")
        return told
