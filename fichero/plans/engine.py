"""The engine: what a user calls. Ingestion jobs, questions and the small questions around them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import EngineConfig
from ..functions import text as T
from ..functions import vectors
from ..operators import answer, chunking, incremental, profile, sections, tables
from ..operators.index import Index
from ..shared import settled
from ..sources import files, sinks


class Engine:
    """Documents in, answers out. Models are plug-ins with deterministic stand-ins."""

    def __init__(self, spark: SparkSession, config: EngineConfig, embedder: vectors.Embedder | None = None, generator: answer.Generator | None = None):
        self.spark, self.config = spark, config
        self.embedder, self.generator = embedder or vectors.HashingEmbedder(), generator or answer.Extractive()
        self.index = Index(spark, config.path("index"))

    def decode(self, decoders: dict, names: DataFrame | None = None, pattern: str = "*.pdf") -> dict[str, DataFrame]:
        """Texts, cells and images of the files of the bronze zone, written to the gold zones; and the errors, by file.

        decoders: "text" (yields text), "tables" (a list; each yields schemas.TABLE_CELL without doc_key), "fallback"
        (likewise, asked where none of these found a table), "images" (yields page, image_no, extension, content).
        names: doc_key of the files to decode (all by default). Cells are written cleaned and valid.
        """
        found = files.binary(self.spark, self.config.path("bronze"), pattern).select(T.stem(F.url_decode("path")).alias("doc_key"), "content")
        found = found if names is None else found.join(names.select("doc_key"), "doc_key", "left_semi")
        out, errors = {}, []

        def good(decoder, schema: str) -> DataFrame:
            rows = settled(files.decoded(found, decoder, schema), "decoded")
            errors.append(rows.filter("error is not null").select("doc_key", "error"))
            return rows.filter("error is null").drop("error")

        cell = schemas.TABLE_CELL.split(", ", 1)[1]
        if "text" in decoders:
            out["texts"] = good(decoders["text"], "text string").select("doc_key", T.clean("text").alias("contenido_texto"))
            sinks.write_texts(out["texts"], self.config.path("gold_texts", "decoded"), "overwrite")
        if decoders.get("tables"):
            cells = [good(d, cell) for d in decoders["tables"]]
            fallback = good(decoders["fallback"], cell) if "fallback" in decoders else cells[0].limit(0)
            out["cells"] = settled(tables.distinct_tables(tables.valid_tables(tables.clean_tables(files.first_yield(found, cells, fallback)))), "cells")
            sinks.write_cells(out["cells"], self.config.path("gold_tables", "decoded"), "overwrite")
        if "images" in decoders:
            out["images"] = good(decoders["images"], "page int, image_no int, extension string, content binary")
            sinks.write_images(out["images"], self.config.path("gold_images", "decoded"), "overwrite")
        out["errors"] = errors[0] if errors else self.spark.createDataFrame([], "doc_key string, error string")
        for more in errors[1:]:
            out["errors"] = out["errors"].unionByName(more)
        return out

    def extract(self, suffix: str = "_texto_limpio", texts: DataFrame | None = None) -> DataFrame:
        """Metadata and sections of the texts of the gold zone, or of `texts` (doc_key, contenido_texto)."""
        if texts is not None:
            return sections.extract(texts, text="contenido_texto")
        return sections.extract(files.texts(self.spark, self.config.path("gold_texts"), suffix))

    def chunk(self, documents: DataFrame, cells: DataFrame | None = None, images: DataFrame | None = None, **options) -> DataFrame:
        """Chunks with vectors."""
        told = tables.to_text(tables.distinct_tables(cells)) if cells is not None else None
        built = chunking.build(documents, told, images, **options)
        return built.withColumn("embedding", vectors.embed("content", self.embedder))

    def update(self, decoders: dict | None = None, pattern: str = "*.pdf", **options) -> DataFrame:
        """Bring the index up to date with the bronze zone: status, count of files; and kind, status, count of chunks.

        Modified and deleted files are forgotten, new and modified ones decoded (or, without decoders, read from the
        gold texts of the same name), chunked and ingested. Only then is the manifest saved, so a run that fails is
        taken up again by the next. Running it again changes nothing.
        """
        changed = settled(self.sync(pattern), "changes")
        named = lambda *kinds: changed.filter(F.col("status").isin(*kinds)).select(T.stem("name").alias("doc_key"))
        work, gone, told, chunks = named("new", "modified"), named("modified", "deleted"), None, None
        if not work.isEmpty():
            gold = self.decode(decoders, work, pattern) if decoders else {}
            docs = self.extract(texts=gold["texts"]) if "texts" in gold else self.extract().join(work, "doc_key", "left_semi")
            chunks = self.chunk(settled(docs, "documents"), gold.get("cells"), **options)
        if not gone.isEmpty():  # old chunks go and new ones come in one step
            told = self.index.replace(gone, chunks)
        elif chunks is not None:
            told = self.ingest(chunks)
        sinks.write_manifest(changed.filter("status <> 'deleted'").select("name", "hash", "size"), self.config.path("manifest"))
        files_told = incremental.counts(changed).select(F.lit("archivo").alias("kind"), "status", "count")
        return files_told if told is None else files_told.unionByName(told.select(F.col("tipo_contenido").alias("kind"), "status", "count"))

    def enrich_images(self, image_files: DataFrame, description) -> DataFrame:
        """Describe the image chunks of the index anew: status (updated, skipped, error) and count.

        image_files: doc_key, path and what the column `description` uses. Ids stay; the new version counts from now on.
        """
        held = self.index.chunks().filter("tipo_contenido = 'imagen'").drop("tipo_contenido")
        out = settled(chunking.describe_images(held, image_files, description), "images")
        new = out.filter("status = 'updated'").drop("status")
        self.index.ingest(new.withColumn("embedding", vectors.embed("content", self.embedder)))
        return out.groupBy("status").count()

    def ingest(self, chunks: DataFrame, skip_existing: bool = True) -> DataFrame:
        return self.index.ingest(chunks, skip_existing)

    def sync(self, pattern: str = "*.pdf") -> DataFrame:
        """Status of each file of the bronze zone against the manifest of the last successful run."""
        current = files.manifest(self.spark, self.config.path("bronze"), pattern)
        return incremental.changes(current, self._manifest())

    def _manifest(self) -> DataFrame:
        path = self.config.path("manifest")
        return sinks.read_manifest(self.spark, path)

    def commit(self, pattern: str = "*.pdf") -> None:
        """Take the present files as done; to be called after their ingestion has succeeded."""
        sinks.write_manifest(files.manifest(self.spark, self.config.path("bronze"), pattern), self.config.path("manifest"))

    def chat(self, requests: DataFrame, log: bool = False, **options) -> DataFrame:
        """Responses to requests (schemas.REQUEST)."""
        began = time.time()
        out = answer.answer(requests, self.index.chunks(), self.embedder, self.generator, search=self.index.nearest, **options)
        if log:
            out = settled(out, "responses")
            sinks.append_metrics(answer.logged(out, requests, (time.time() - began) * 1000), self.config.path("metrics"))
        return out

    def find_documents(self, term: str, pattern: str = "*.pdf") -> DataFrame:
        """Files whose name holds the term or any of its words; the first by name is the answer."""
        return find_documents(files.listing(self.spark, self.config.path("bronze"), pattern), term)

    def health(self) -> dict:
        return {"status": "ok", "missing": self.config.missing(self.spark)}

    def check(self) -> None:
        """What must hold before questions are taken: an index that is not empty, models that answer."""
        if self.index.ids().isEmpty():
            raise RuntimeError(f"no chunks in {self.config.path('index')}")
        if self.embedder.embed(["x"]).shape != (1, self.embedder.size) or len(self.generator.generate(["x"])) != 1:
            raise RuntimeError("a model does not answer as it should")

    def profile(self) -> dict[str, DataFrame]:
        return profile.report(self.index.chunks())


def find_documents(listing: DataFrame, term: str, stem: str = "stem") -> DataFrame:
    low, wanted = F.lower(stem), F.lower(F.url_decode(F.lit(term.replace("+", "%2B"))))
    words = T.words_of(wanted)
    return listing.filter(low.contains(wanted) | F.exists(words, lambda w: low.contains(w))).orderBy(stem)


def reset(session_id: str, spark: SparkSession) -> DataFrame:
    """A turn that makes a session forget its product, for streaming.sync.session_products."""
    return spark.createDataFrame([(session_id, None, None, True)], "session_id string, turn long, product string, reset boolean")
