"""Structured metadata of hits: codes and components, once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims, fixed


def first_of_each(hits: DataFrame, field: str, key: str, order: str, by: str = "query_id", rank: str = "position") -> DataFrame:
    """by and `items`: the structs of an array field, the first by rank of each key, ordered by `order`."""
    rows = hits.select(by, rank, F.explode(field).alias("item")).filter(F.col(f"item.{key}").isNotNull())
    once = rows.groupBy(by, F.col(f"item.{key}").alias("_key")).agg(F.min_by("item", rank).alias("item"))
    return once.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"item.{order}").alias("o"), F.col("_key").alias("k"), F.col("item").alias("item")))), lambda x: x["item"]).alias("items"))


def with_descriptions(codes: DataFrame, letter: str) -> DataFrame:
    """codigo rows with the description of the fixed list, or the text that there is none."""
    spark = codes.sparkSession
    dim = dims.hazards(spark) if letter == "H" else dims.precautions(spark)
    return codes.join(F.broadcast(dim), "codigo", "left").withColumn("descripcion", F.coalesce("descripcion", F.lit(fixed.NO_DESCRIPTION)))


def redescribed(items: Column, names: dict[str, str]) -> Column:
    """Codes with the descriptions of a fixed list in place of their own."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(items, lambda c: F.struct(c["codigo"].alias("codigo"), F.coalesce(table[c["codigo"]], F.lit(fixed.NO_DESCRIPTION)).alias("descripcion")))


def structured(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, query_type, codigos_h, codigos_p, componentes_cas, total_chunks: the field that the query's type asks for.

    queries: query_id, query_type. Types without a field, and null, give empty lists and count 0.
    """
    m = F.col("metadata")
    flat = hits.select("query_id", "position", redescribed(m["codigos_h"], fixed.HAZARDS).alias("codigos_h"), redescribed(m["codigos_p"], fixed.PRECAUTIONS).alias("codigos_p"), F.transform(m["componentes_cas"], lambda c: c.withField("concentracion", F.coalesce(c["concentracion"], F.lit(fixed.NO_CONCENTRATION)))).alias("componentes_cas"))
    asked = queries.select("query_id", "query_type")
    out = asked.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    known = F.col("query_type").isin(list(fixed.QUERY_FIELD))
    for field, key, order in (("codigos_h", "codigo", "codigo"), ("codigos_p", "codigo", "codigo"), ("componentes_cas", "cas", "nombre")):
        types = [t for t, f in fixed.QUERY_FIELD.items() if f == field]
        own = flat.join(asked.filter(F.col("query_type").isin(types)).select("query_id"), "query_id", "left_semi")
        out = out.join(first_of_each(own, field, key, order).withColumnRenamed("items", field), "query_id", "left").withColumn(field, F.coalesce(field, F.array()))
    return out.select("query_id", "query_type", "codigos_h", "codigos_p", "componentes_cas", F.when(known, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("total_chunks"))


def merged(metadata: DataFrame, by: str = "query_id") -> DataFrame:
    """Metadata of several query types as one: types in order, lists once by code or CAS, chunk counts summed.

    Rows without any list entry are left out (the response has no metadata then).
    """
    ranked = metadata.withColumn("position", F.coalesce("query_type", F.lit("")))
    out = metadata.groupBy(by).agg(F.array_sort(F.collect_set("query_type")).alias("query_types"), F.sum("total_chunks").alias("total_chunks"))
    for field, key, order in (("codigos_h", "codigo", "codigo"), ("codigos_p", "codigo", "codigo"), ("componentes_cas", "cas", "nombre")):
        out = out.join(first_of_each(ranked, field, key, order, by).withColumnRenamed("items", field), by, "left").withColumn(field, F.coalesce(field, F.array()))
    return out.filter((F.size("codigos_h") > 0) | (F.size("codigos_p") > 0) | (F.size("componentes_cas") > 0))
