"""Profiles of an index: counts, histograms and the sections that products lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed


def histogram(rows: DataFrame, column: str, most: int | None = None, missing: str = "N/A") -> DataFrame:
    """column, count; with `most` the most frequent ones, equal counts by name."""
    out = rows.groupBy(F.coalesce(column, F.lit(missing)).alias(column)).count()
    return out if most is None else out.orderBy(F.desc("count"), column).limit(most)


def totals(chunks: DataFrame, kind: str = "tipo_contenido") -> DataFrame:
    """kind, count in one pass; the row without kind is the total."""
    return chunks.rollup(kind).count()


def filled(chunks: DataFrame) -> DataFrame:
    """How many chunks have hazard codes, precautionary codes and components."""
    m = F.col("metadata")
    return chunks.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.size(m[c]) > 0).alias(f"con_{c}") for c in ("codigos_h", "codigos_p", "componentes_cas")])


def sections_of(chunks: DataFrame, by: list[str], section: str) -> DataFrame:
    """by and `sections`: distinct sections in order. They are names of a fixed list, so sets stay small."""
    return chunks.groupBy(*[F.coalesce(c, F.lit("N/A")).alias(c) for c in by]).agg(F.array_sort(F.collect_set(F.coalesce(section, F.lit("N/A")))).alias("sections"))


def coverage(chunks: DataFrame, by: list[str], section: str, expected: list[str] | None = None) -> DataFrame:
    """sections_of with the expected sections that are missing."""
    return sections_of(chunks, by, section).withColumn("missing", F.array_sort(F.array_except(F.array(*[F.lit(s) for s in expected or fixed.EXPECTED_SECTIONS]), "sections")))


def by_kind(chunks: DataFrame, document: str, kind: str) -> DataFrame:
    """One row a document with the number of chunks of each kind."""
    return chunks.groupBy(document).pivot(kind, fixed.KINDS).count().na.fill(0, fixed.KINDS)


def report(chunks: DataFrame) -> dict[str, DataFrame]:
    """The profile of an index, by name."""
    flat = chunks.select("metadata.*")
    return {
        "totals": totals(flat),
        "products": histogram(flat, "producto", 10),
        "sections": histogram(flat, "seccion"),
        "filled": filled(chunks),
        "coverage": coverage(flat, ["tipo_contenido", "producto"], "seccion"),
        "first_section": flat.filter(F.col("seccion") == "identificacion_producto").orderBy("chunk_id").limit(5),
    }
