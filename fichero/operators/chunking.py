"""Chunks of sections, tables and images, with their metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..schemas import CHUNK_METADATA
from ..shared import settled


def cuts(tokens: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """First and last (exclusive) paragraph of each chunk, from the paragraphs' tokens.

    On their running sums each end, and each beginning within the overlap, is one binary search.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    out, begin, new, n = [], 0, 0, len(tokens)
    while new < n:
        # the first new paragraph is always taken, then all that fit
        end = max(new + 1, int(np.searchsorted(total, total[begin] + size, "right")) - 1)
        out.append((begin, end))
        begin, new = max(begin, int(np.searchsorted(total, total[end] - overlap, "left"))), end
    return out


def pack(text: Column | str, size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.OVERLAP_TOKENS, separator: str = "\n\n") -> Column:
    """Chunks of a text: paragraphs are added while `size` tokens hold, the last ones up to `overlap` begin the next chunk.

    A paragraph beyond `size` is not split. Time is in proportion to the text and its chunks.

    Python sees the tokens of paragraphs, and only of texts that one chunk does not hold; texts stay in the JVM.
    """

    @F.pandas_udf("array<struct<begin:int,count:int>>")
    def run(counts: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else [{"begin": a + 1, "count": b - a} for a, b in cuts(c, size, overlap)] for c in counts], dtype=object)

    def packed(x: Column) -> Column:
        whole = F.filter(F.array(F.array_join(x["parts"], separator)), lambda _: F.size(x["parts"]) > 0)
        return F.when(x["cuts"].isNull(), whole).otherwise(F.transform(x["cuts"], lambda c: F.array_join(F.slice(x["parts"], c["begin"], c["count"]), separator)))

    x = F.col(text) if isinstance(text, str) else text
    tokens = T.held(T.paragraphs(x, separator), lambda ps: F.transform(ps, lambda p: F.floor(F.length(p) / fixed.CHARS_PER_TOKEN)))
    # what is no longer than a chunk is one, whatever its paragraphs
    long = F.when(F.length(x) >= size * fixed.CHARS_PER_TOKEN, tokens)
    return F.when(x.isNotNull(), T.held(F.struct(T.paragraphs(x, separator).alias("parts"), run(long).alias("cuts")), packed))


def numbered(chunks: DataFrame, document: str = "doc_key", section: str = "section_pos", order: tuple[str, ...] = ("kind_order", "section_pos", "part")) -> DataFrame:
    """chunk_index over a document (from 0) and total_chunks of its section."""
    whole = Window.partitionBy(document)
    return chunks.withColumn("chunk_index", F.row_number().over(whole.orderBy(*order)) - 1).withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy(document, "kind_order", section)).cast("int"))


#: What chunks keep of a document's metadata.
_KEPT = ("nombre_producto", "proveedor", "codigo", "fecha_emision", "componentes_quimicos", "indicaciones_peligro_detalle", "frases_precaucion_detalle")


def build(documents: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None, size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.OVERLAP_TOKENS, separator: str = "\n\n", last_section: bool = False) -> DataFrame:
    """Chunks (schemas.CHUNK without vectors, and doc_key) of extracted documents.

    documents: doc_key, metadata. tables: doc_key, table_no, text. images: doc_key, image_no, path, name, description.
    last_section: tables and images carry the document's last section instead of "general".

    The metadata travel with the sections, so documents, whose extraction is dear, are computed once; with tables or
    images, which join them, they are written first.
    """
    m = F.col("metadata")
    documents = documents if tables is None and images is None else settled(documents, "documents")
    slim = F.struct(*[m[n].alias(n) for n in _KEPT])
    parts = documents.select("doc_key", slim.alias("metadata"), F.inline(m["secciones"]))
    parts = parts.select("doc_key", "metadata", F.lit(0).alias("kind_order"), F.col("pos").alias("section_pos"), F.col("name").alias("section"), F.posexplode(pack("text", size, overlap, separator)).alias("part", "body"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("image"))
    last = documents.select("doc_key", F.try_element_at(m["secciones"], F.lit(-1))["name"].alias("last")) if last_section else None
    for kind, frame, number, body, path, image in ((1, tables, "table_no", "text", None, None), (2, images, "image_no", "description", "path", "name")):
        if frame is None:
            continue
        own = frame.filter(F.length(body) > 0)
        own = own.join(last, "doc_key", "left") if last_section else own.withColumn("last", F.lit("general"))
        extra = [(F.col(c) if c else F.lit(None).cast("string")).alias(a) for c, a in ((path, "path"), (image, "image"))]
        # each table or image stands alone: its number is its section
        own = own.join(documents.select("doc_key", slim.alias("metadata")), "doc_key")
        parts = parts.unionByName(own.select("doc_key", "metadata", F.lit(kind).alias("kind_order"), F.col(number).cast("int").alias("section_pos"), F.coalesce("last", F.lit("general")).alias("section"), F.lit(0).alias("part"), F.col(body).alias("body"), *extra))
    chunks = numbered(parts)
    kind = F.element_at(F.array(*[F.lit(k) for k in fixed.KINDS]), F.col("kind_order") + 1)
    content = F.when(F.col("kind_order") == 0, T.with_context("body", m["nombre_producto"], "section")).otherwise(F.col("body"))
    chunks = chunks.withColumn("content", content)
    code = m["codigo"]
    chunks = chunks.withColumn("id", T.chunk_id(code, "chunk_index", "content"))
    component = F.transform(m["componentes_quimicos"], lambda c: F.struct(c["nombre"].alias("nombre"), c["cas"].alias("cas"), c["concentracion"].alias("concentracion")))
    fields = F.struct(
        m["nombre_producto"].alias("producto"), m["proveedor"].alias("fabricante"), code.alias("codigo_producto"), m["fecha_emision"].alias("fecha_fds"), F.col("id").alias("chunk_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"), F.when(F.col("kind_order") == 0, F.col("total_chunks")).otherwise(1).alias("total_chunks"), kind.alias("tipo_contenido"),
        F.length("content").alias("char_count"), T.estimate_tokens("content").cast("int").alias("token_count"), F.coalesce("section", F.lit("general")).alias("seccion"),
        component.alias("componentes_cas"), m["indicaciones_peligro_detalle"].alias("codigos_h"), m["frases_precaucion_detalle"].alias("codigos_p"),
        F.lit(None).cast("string").alias("pictograma_tipo"), F.col("path").alias("imagen_path"), F.col("image").alias("imagen_nombre"),
    )
    return chunks.select("id", "content", F.lit(None).cast("array<float>").alias("embedding"), fields.cast(CHUNK_METADATA).alias("metadata"), "doc_key")


def describe_images(chunks: DataFrame, files: DataFrame, description: Column, status: str = "status") -> DataFrame:
    """Image chunks with the i-th file of their document (both in order), its description and pictogram class; others as they are.

    files: doc_key, path and what `description` uses besides the columns of chunks. status: "updated"; "skipped" for
    images without a file, "error" for those whose description is null, which both stay as they are; null for others.
    """
    is_image = F.col("metadata.tipo_contenido") == "imagen"
    numbered_chunks = chunks.filter(is_image).withColumn("_i", F.row_number().over(Window.partitionBy("doc_key").orderBy("metadata.chunk_index")))
    numbered_files = files.withColumn("_i", F.row_number().over(Window.partitionBy("doc_key").orderBy("path"))).withColumnRenamed("path", "_path")
    joined = numbered_chunks.join(numbered_files, ["doc_key", "_i"], "left").withColumn("_text", F.when(F.col("_path").isNotNull(), description))
    done = F.col("_text").isNotNull()
    m = F.col("metadata")
    m = m.withField("pictograma_tipo", F.when(done, T.pictogram_class("_text")).otherwise(m["pictograma_tipo"]))
    m = m.withField("imagen_path", F.when(done, F.col("_path")).otherwise(F.col("metadata.imagen_path")))
    m = m.withField("imagen_nombre", F.when(done, F.regexp_extract("_path", r"([^/]*)$", 1)).otherwise(F.col("metadata.imagen_nombre")))
    told = F.when(done, "updated").when(F.col("_path").isNull(), "skipped").otherwise("error")
    new = joined.select(*[c for c in chunks.columns if c not in ("content", "metadata")], F.coalesce("_text", "content").alias("content"), m.alias("metadata"), told.alias(status))
    return chunks.filter(~F.coalesce(is_image, F.lit(False))).withColumn(status, F.lit(None).cast("string")).unionByName(new)
