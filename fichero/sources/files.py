"""Sources: folders of documents, texts, tables, images and JSON, as DataFrames; and the decoders to plug in.

Listings and contents come from Spark's readers, so any Hadoop path works and work is spread by file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files whose name fits a glob."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, stem, length without reading contents."""
    files = binary(spark, path, pattern).select("path", "length")
    return files.select("path", F.url_decode(F.regexp_extract("path", r"([^/]*)$", 1)).alias("name"), T.stem(F.url_decode("path")).alias("stem"), "length")


def manifest(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """name, hash (MD5 of the content), size of each file."""
    return binary(spark, path, pattern).select(F.url_decode(F.regexp_extract("path", r"([^/]*)$", 1)).alias("name"), F.md5("content").alias("hash"), F.col("length").alias("size"))


def texts(spark: SparkSession, path: str, suffix: str = "_texto_limpio", pattern: str = "*.txt") -> DataFrame:
    """doc_key, text: one row a file."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(T.stem(F.url_decode("_metadata.file_path"), suffix).alias("doc_key"), F.col("value").alias("text"))


def metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of schemas.DOC_METADATA; doc_key is the file's name without _metadata."""
    found = spark.read.schema(schemas.DOC_FIELDS).option("multiLine", "true").option("pathGlobFilter", "*_metadata.json").json(path)
    return found.select(T.stem(F.url_decode("_metadata.file_path"), "_metadata").alias("doc_key"), "contenido_texto", "metadata")


def chunk_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_key and chunks (schemas.CHUNK) of chunk files; files without chunks give no row."""
    found = spark.read.schema(schemas.CHUNK_FILE).option("multiLine", "true").option("pathGlobFilter", "*_metadata_chunks.json").json(path)
    return found.select(T.stem(F.url_decode("_metadata.file_path"), "_metadata_chunks").alias("doc_key"), F.inline("chunks"))


def tables_csv(spark: SparkSession, path: str, pattern: str = "*_tabla_*.csv") -> DataFrame:
    """Cells (schemas.TABLE_CELL) of CSV tables, whose headers differ; keys come from the file names.

    Files are read whole, as one table is small and its header is its own.
    """
    files = binary(spark, path, pattern).select(F.url_decode(F.regexp_extract("path", r"([^/]*)$", 1)).alias("name"), F.col("content"))
    keyed = files.select(F.regexp_extract("name", r"^(.*)_tabla_\d+\.csv$", 1).alias("doc_key"), F.regexp_extract("name", r"_tabla_(\d+)\.csv$", 1).cast("int").alias("table_no"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for batch in batches:
            for doc, number, content in zip(batch["doc_key"], batch["table_no"], batch["content"]):
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8", "replace"))))
                if rows:
                    cells = [(doc, number, i, j, name, (row[j] or None) if j < len(row) else None) for i, row in enumerate(rows[1:]) for j, name in enumerate(rows[0])]
                    yield pd.DataFrame(cells, columns=["doc_key", "table_no", "row_no", "col_no", "col_name", "value"])

    return keyed.mapInPandas(run, schemas.TABLE_CELL)


def related(files: DataFrame, documents: DataFrame, pattern: str) -> DataFrame:
    """files (name, path) with the doc_key that the pattern's first group finds, of known documents."""
    return files.withColumn("doc_key", F.regexp_extract("name", pattern, 1)).filter("doc_key <> ''").join(documents.select("doc_key"), "doc_key", "left_semi")


TABLE_FILE = r"^(.*)_tabla_\d+\.csv$"
#: Images of any of the usual extensions.
IMAGE_FILE = r"(?i)^(.*)_p\d+_img\d+\.(?:png|jpe?g)$"


def folder_counts(spark: SparkSession, path: str) -> DataFrame:
    """extension, files, bytes below a folder."""
    return binary(spark, path).select(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), "length").groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


#: A decoder takes a file's bytes and yields rows.
Decoder = Callable[[bytes], Iterator[tuple]]


def decoded(files: DataFrame, decoder: Decoder, schema: str, failed: str = "error") -> DataFrame:
    """doc_key, the decoder's columns and an error text: rows of every file; a file that fails gives one row with its error."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, content in zip(batch["doc_key"], batch["content"]):
                try:
                    rows = [(key, *r, None) for r in decoder(bytes(content))]
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    rows = [(key, *[None] * len(names), f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_key", *names, failed])

    return files.select("doc_key", "content").mapInPandas(run, f"doc_key string, {schema}, {failed} string")


def first_yield(documents: DataFrame, methods: list[DataFrame], fallback: DataFrame) -> DataFrame:
    """Tables of all methods; those of the fallback only for documents where no method found one."""
    found = methods[0]
    for other in methods[1:]:
        found = found.unionByName(other)
    missing = documents.select("doc_key").join(found.select("doc_key").distinct(), "doc_key", "left_anti")
    return found.unionByName(fallback.join(missing, "doc_key", "left_semi"))
