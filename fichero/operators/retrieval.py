"""Retrieval: candidates by cosine per kind, product filter, image boost, final ranks, and what is told of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions import vectors


def kind_order(tipo: str = "tipo") -> Column:
    return F.array_position(F.lit(fixed.KINDS), F.col(tipo))


def boosted(similarity: str = "similarity", tipo: str = "tipo") -> Column:
    """Images count more; the sign stays, so a negative one falls further."""
    return F.when(F.col(tipo) == "imagen", F.col(similarity) * fixed.IMAGE_BOOST).otherwise(F.col(similarity))


def product_matches(product: Column, wanted: Column, fold: bool = False) -> Column:
    """Whether a product's name holds the wanted one, whatever the case; accents count unless folded. No wish: all."""
    a, b = F.lower(F.coalesce(product, F.lit(""))), F.lower(wanted)
    return wanted.isNull() | (T.fold_accents(a).contains(T.fold_accents(b)) if fold else a.contains(b))


def candidates(queries: DataFrame, chunks: DataFrame, k: int = fixed.CANDIDATES, **names) -> DataFrame:
    """query_id, id, tipo, similarity, rank: k chunks of each kind for each query."""
    return vectors.nearest(queries, chunks, k, **names)


def finish(hits: DataFrame, n: int = fixed.FINAL) -> DataFrame:
    """Boost, order and cut candidates that passed the filter: position 1 to n of each query.

    Equal similarities (to 9 decimals) keep the order of kinds, then of ranks. The filter must come before, the
    top-k of kinds before the filter: a query may end with fewer than n.
    """
    hits = hits.withColumn("similarity", boosted())
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), kind_order(), "rank", "id")
    return hits.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def retrieve(queries: DataFrame, chunks: DataFrame, n_candidates: int = fixed.CANDIDATES, n_final: int = fixed.FINAL, fold: bool = False, search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """query_id, position, id, tipo, similarity, content, metadata of the hits of each query.

    queries: query_id, query_vector and product (null: no filter). chunks: schemas.CHUNK. search: finds k chunks of
    each kind for the queries; by default all vectors are read.
    The hits, at most kinds * n_candidates a query, fetch content and metadata by a join on id.
    """
    slim = chunks.select("id", "embedding", F.coalesce("metadata.tipo_contenido", F.lit("texto")).alias("tipo")).filter(F.col("tipo").isin(fixed.KINDS))
    found = search(queries.select("query_id", "query_vector"), n_candidates) if search is not None else candidates(queries, slim, n_candidates)
    full = found.join(chunks.select("id", "content", "metadata"), "id").join(queries.select("query_id", "product"), "query_id")
    passed = full.filter(product_matches(F.col("metadata.producto"), F.col("product"), fold))
    return finish(passed, n_final).select("query_id", "position", "id", "tipo", "similarity", "content", "metadata")


def metrics(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, avg_similarity, top_similarity, total_chunks; zeros for queries without hits. Similarities as boosted."""
    per = hits.groupBy("query_id").agg(F.avg("similarity").alias("avg_similarity"), F.max_by("similarity", -F.col("position")).alias("top_similarity"), F.count(F.lit(1)).alias("total_chunks"))
    return queries.select("query_id").join(per, "query_id", "left").na.fill(0.0, ["avg_similarity", "top_similarity"]).na.fill(0, ["total_chunks"])


def sources(hits: DataFrame) -> DataFrame:
    """What a response tells of each hit."""
    m = F.col("metadata")
    return hits.select("query_id", "position", F.coalesce(m["producto"], F.lit("N/A")).alias("producto"), F.coalesce(m["seccion"], F.lit("N/A")).alias("seccion"), F.bround("similarity", 3).alias("similarity"), F.col("tipo"), F.coalesce(m["chunk_id"], F.col("id")).alias("chunk_id"), T.preview("content").alias("content_preview"))


def images(hits: DataFrame) -> DataFrame:
    """Hits that are images with a file name."""
    m = F.col("metadata")
    return hits.filter((F.col("tipo") == "imagen") & (F.coalesce(m["imagen_nombre"], F.lit("")) != "")).select("query_id", "position", m["imagen_nombre"].alias("imagen_nombre"), m["imagen_path"].alias("imagen_path"), m["pictograma_tipo"].alias("pictograma_tipo"), F.bround("similarity", 3).alias("similarity"), "content")


def product_info(hits: DataFrame, queries: DataFrame, fold: bool = False) -> DataFrame:
    """Of each query's first hit that names its product: what is known of the product. Queries without one are left out."""
    m = F.col("metadata")
    own = hits.join(queries.select("query_id", "product").filter("product is not null"), "query_id").filter(product_matches(m["producto"], F.col("product"), fold))
    best = own.groupBy("query_id").agg(F.min_by("metadata", "position").alias("metadata"))
    na = F.lit("N/A")
    return best.select("query_id", *[F.coalesce(m[c], na).alias(c) for c in ("producto", "fabricante", "codigo_producto", "fecha_fds")], *[F.coalesce(m[c], F.array()).alias(c) for c in ("componentes_cas", "codigos_h", "codigos_p")])
