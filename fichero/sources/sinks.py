"""Sinks of the zones. Overwriting and dropping need an explicit word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..functions import codes


def write_texts(documents: DataFrame, path: str, mode: str = "error") -> None:
    documents.select("doc_key", "contenido_texto").write.mode(mode).parquet(path)


def write_metadata(documents: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; characters beyond ASCII stay as they are."""
    documents.write.mode(mode).json(path)


def write_cells(cells: DataFrame, path: str, mode: str = "error") -> None:
    cells.write.mode(mode).parquet(path)


def write_csv(frame: DataFrame, path: str, mode: str = "error") -> None:
    """One wide table as CSV with a header."""
    frame.write.mode(mode).option("header", "true").csv(path)


def write_images(images: DataFrame, path: str, mode: str = "error") -> None:
    """doc_key, page, image_no, extension and content as bytes."""
    images.write.mode(mode).parquet(path)


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks by kind, so that a search of one kind reads only its folder."""
    chunks.withColumn("tipo_contenido", F.coalesce("metadata.tipo_contenido", F.lit("texto"))).filter(F.col("tipo_contenido").isin(fixed.KINDS)).write.mode(mode).partitionBy("tipo_contenido").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def read_word(spark: SparkSession, path: str) -> str | None:
    """The content of a file of one word; null where it is missing."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0].strip()


def write_word(spark: SparkSession, path: str, word: str) -> None:
    """Write a file of one word; it takes the place of the last one in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh, target = jvm.org.apache.hadoop.fs.Path(f"{path}.{word}"), jvm.org.apache.hadoop.fs.Path(path)
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(word.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, options)


def read_chunks(spark: SparkSession, path: str, schema: str = schemas.CHUNK) -> DataFrame:
    """Chunks written by kind; empty where none has been written yet."""
    if not exists(spark, f"{path}/_SUCCESS"):
        return spark.createDataFrame([], schema).withColumn("tipo_contenido", F.lit(None).cast("string"))
    return spark.read.schema(f"{schema}, tipo_contenido string").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the last successful run; empty where there is none."""
    current = read_word(spark, f"{path}/CURRENT")
    return spark.createDataFrame([], schemas.MANIFEST) if current is None else spark.read.schema(schemas.MANIFEST).parquet(f"{path}/run-{current}")


def write_manifest(rows: DataFrame, path: str) -> None:
    """The next manifest; the last one stays in force until it is whole."""
    spark = rows.sparkSession
    last = read_word(spark, f"{path}/CURRENT")
    fresh = str(int(last or 0) + 1)
    rows.write.mode("overwrite").parquet(f"{path}/run-{fresh}")
    write_word(spark, f"{path}/CURRENT", fresh)
    if last is not None:
        remove(spark, f"{path}/run-{last}")


def flattened(chunks: DataFrame) -> DataFrame:
    """Chunks with metadata as text and numbers only: lists joined, nulls empty."""
    m = F.col("metadata")
    kind = chunks.schema["metadata"].dataType
    lists = ("componentes_cas", "codigos_h", "codigos_p")
    fields = [codes.flattened(m[f.name]).alias(f.name) if f.name in lists else (F.coalesce(m[f.name], F.lit("")) if f.dataType.simpleString() == "string" else m[f.name]).alias(f.name) for f in kind.fields]
    return chunks.withColumn("metadata", F.struct(*fields))


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def response_json(responses: DataFrame) -> DataFrame:
    """query_id and the response as JSON."""
    return responses.select("query_id", F.to_json(F.struct(*[c for c in responses.columns if c != "query_id"])).alias("json"))
