"""Answers: prompt, generation, pictograms and the response itself."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed
from ..functions import text as T
from ..functions import vectors
from ..shared import settled
from . import conversation, metadata, retrieval

#: What the model is asked to keep to; a parameter of `prompts`.
RULES = (
    "Begin with the product, its maker, its code and the date of the sheet.",
    "Use only what the fragments say, and name the section that says it.",
    "Say plainly which data are missing; never fill gaps with general knowledge.",
    "Put hazard and precaution codes into words.",
    "Answer in plain Spanish text, without Markdown.",
)


class Generator(Protocol):
    """Turns prompts into answers."""

    def generate(self, prompts: list[str | None]) -> list[str]: ...


class Extractive:
    """Deterministic stand-in for a language model: the first fragments of the prompt."""

    def __init__(self, fragments: int = 2):
        self.fragments = fragments

    def generate(self, prompts: list[str | None]) -> list[str]:
        return [" ".join(p.split("\n", 1)[-1].strip() for p in (x or "").split("[Fragmento ")[1 : self.fragments + 1]).split("\nINSTRUCCIONES")[0] for x in prompts]


def generated(prompt: Column | str, generator: Generator | None = None) -> Column:
    """Answers of a model, without Markdown."""
    model = generator or Extractive()

    @F.pandas_udf(StringType())
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(model.generate([p if isinstance(p, str) else None for p in prompts]), dtype=object)

    return T.plain_answer(run(F.col(prompt) if isinstance(prompt, str) else prompt))


def fragments(hits: DataFrame, most: int = fixed.FRAGMENTS, size: int = fixed.FRAGMENT_CHARS) -> DataFrame:
    """query_id, fragments: the first text hits of a query, cut and numbered."""
    texts = hits.filter(F.col("tipo") == "texto").select("query_id", F.struct("position", F.coalesce("metadata.seccion", F.lit("N/A")).alias("seccion"), F.substring("content", 1, size).alias("content")).alias("f"))
    some = F.slice(F.array_sort(F.collect_list("f")), 1, most)  # a query has at most n_final hits
    listed = F.transform(some, lambda f, i: F.format_string("\n[Fragmento %d - Sección: %s]\n%s\n", i + 1, f["seccion"], f["content"]))
    return texts.groupBy("query_id").agg(F.array_join(listed, "").alias("fragments"))


def prompts(queries: DataFrame, hits: DataFrame, merged: DataFrame, info: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """query_id, prompt of every query: product, question, codes, components, fragments and rules."""
    na = F.lit("N/A")
    q = queries.select("query_id", "question").join(info, "query_id", "left").drop("codigos_h", "codigos_p", "componentes_cas").join(merged, "query_id", "left").join(fragments(hits), "query_id", "left")
    coded = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x["codigo"], F.lit(": "), x["descripcion"], F.lit("\n")))
    part = lambda title, c, lines: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(lines(F.col(c)), ""))).otherwise("")

    def named(c: Column) -> Column:
        amount = F.when(F.coalesce(c["concentracion"], F.lit(fixed.NO_CONCENTRATION)) != fixed.NO_CONCENTRATION, F.concat(F.lit(" ("), c["concentracion"], F.lit(")"))).otherwise("")
        return F.concat(F.lit("- "), c["nombre"], F.lit(" - CAS: "), c["cas"], amount, F.lit("\n"))

    head = F.concat(*[x for label, c in (("Producto", "producto"), ("Fabricante", "fabricante"), ("Código del Producto", "codigo_producto"), ("Fecha de Emisión FDS", "fecha_fds")) for x in (F.lit(f"{label}: "), F.coalesce(c, na), F.lit("\n"))])
    body = F.concat(
        head, F.lit("\nPREGUNTA: "), F.col("question"), F.lit("\n"),
        part("CÓDIGOS DE PELIGRO (H)", "codigos_h", coded), part("MEDIDAS DE PRECAUCIÓN (P)", "codigos_p", coded), part("COMPONENTES QUÍMICOS", "componentes_cas", lambda c: F.transform(c, named)),
        F.lit("\nCONTEXTO DE LA FDS:\n"), F.coalesce("fragments", F.lit("")),
        F.lit("\nINSTRUCCIONES:\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1)) + "\n"),
    )
    return q.select("query_id", body.alias("prompt"))


def pictograms(merged: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, pictogramas: for each hazard code's pictogram the first file whose name holds it. files: name."""
    spark = merged.sparkSession
    listed = spark.createDataFrame([(p,) for p in sorted(set(fixed.PICTOGRAMS.values()))], "pictograma string")
    # a fixed list of names against the listing of one folder
    first = listed.join(files.filter(F.lower("name").rlike(r"\.(png|jpg)$")), F.expr("contains(name, pictograma)")).groupBy("pictograma").agg(F.min("name").alias("file"))
    table = F.create_map(*[F.lit(x) for pair in fixed.PICTOGRAMS.items() for x in pair])
    wanted = merged.select("query_id", F.explode("codigos_h").alias("c")).select("query_id", table[F.col("c.codigo")].alias("pictograma")).filter("pictograma is not null").distinct()
    return wanted.join(F.broadcast(first), "pictograma").groupBy("query_id").agg(F.array_sort(F.collect_set("file")).alias("pictogramas"))


def answer(requests: DataFrame, chunks: DataFrame, embedder: vectors.Embedder | None = None, generator: Generator | None = None, files: DataFrame | None = None, n_candidates: int = fixed.CANDIDATES, n_final: int = 15, fold: bool = False, fuzzy: bool = True, search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Responses to any number of requests (schemas.REQUEST).

    query_id, answer, sources, structured_metadata, pictogramas, metrics, fds_reference, product, query_type.
    """
    spark = requests.sparkSession
    # a few rows a request, read by every part of the response: written once, so that plans stay small
    asked = settled(conversation.understood(requests, fuzzy).withColumn("query_vector", vectors.embed("question", embedder)), "asked")
    hits = settled(retrieval.retrieve(asked, chunks, n_candidates, n_final, fold, search), "hits")
    merged = settled(metadata.merged(settled(metadata.structured(hits, asked), "metadata")), "merged")
    info = settled(retrieval.product_info(hits, asked, fold), "info")
    files = files if files is not None else spark.createDataFrame([], "name string")
    drawn = pictograms(merged, files).unionByName(retrieval.images(hits).groupBy("query_id").agg(F.array_sort(F.collect_set("imagen_nombre")).alias("pictogramas")))
    drawn = drawn.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pictogramas")))).alias("pictogramas"))
    prompted = prompts(asked, hits, merged, info)
    with_text = hits.filter(F.col("tipo") == "texto").select("query_id").distinct().withColumn("_text", F.lit(True))
    told = prompted.join(with_text, "query_id")  # a model is asked only where there is text
    answers = told.select("query_id", generated("prompt", generator).alias("answer"))
    source = retrieval.sources(hits)
    listed = source.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*[c for c in source.columns if c not in ("query_id", "position")]).alias("s")))), lambda x: x["s"]).alias("sources"))
    reference = info.select("query_id", F.struct(F.col("producto"), F.col("fabricante"), F.col("codigo_producto").alias("codigo"), F.col("fecha_fds").alias("fecha")).alias("fds_reference"))
    held = merged.select("query_id", F.struct("query_types", "codigos_h", "codigos_p", "componentes_cas", "total_chunks").alias("structured_metadata"))
    counted = retrieval.metrics(hits, asked).select("query_id", F.create_map(F.lit("avg_similarity"), F.col("avg_similarity"), F.lit("top_similarity"), F.col("top_similarity"), F.lit("total_chunks"), F.col("total_chunks").cast("double")).alias("metrics"))
    out = asked.select("query_id", "session_id", "turn", "question", "query_type", "product")
    for part in (answers, listed, held, drawn, counted, reference):
        out = out.join(part, "query_id", "left")
    return normalised(out.withColumn("answer", F.coalesce("answer", F.lit(fixed.NO_TEXT_ANSWER))))


def normalised(responses: DataFrame) -> DataFrame:
    """Responses as clients may rely on them: no list is null, names read N/A, numbers 0, previews have RESPONSE_CHARS at most."""
    na, kind = F.lit("N/A"), responses.schema["sources"].dataType.simpleString()

    def source(s: Column) -> Column:
        return F.struct(F.coalesce(s["producto"], na).alias("producto"), F.coalesce(s["seccion"], na).alias("seccion"), F.coalesce(s["similarity"], F.lit(0.0)).alias("similarity"), F.coalesce(s["tipo"], na).alias("tipo"), F.coalesce(s["chunk_id"], F.lit("")).alias("chunk_id"), F.substring(F.coalesce(s["content_preview"], F.lit("")), 1, fixed.RESPONSE_CHARS).alias("content_preview"))

    numbers = F.array(*[F.lit(x) for x in ("avg_similarity", "top_similarity", "total_chunks")])
    metric = F.map_from_arrays(numbers, F.transform(numbers, lambda n: F.coalesce(F.try_element_at(F.col("metrics"), n), F.lit(0.0))))
    out = responses.withColumn("answer", F.coalesce("answer", F.lit("")))
    out = out.withColumn("sources", F.transform(F.coalesce("sources", F.array().cast(kind)), source)).withColumn("pictogramas", F.coalesce("pictogramas", F.array().cast("array<string>")))
    r = F.col("fds_reference")
    reference = F.when(r.isNotNull(), F.struct(*[F.coalesce(r[c], na).alias(c) for c in ("producto", "fabricante", "codigo", "fecha")]))
    return out.withColumn("metrics", metric).withColumn("fds_reference", reference)


def logged(responses: DataFrame, requests: DataFrame, latency_ms: float) -> DataFrame:
    """Rows of schemas.QUERY_METRICS; the latency is that of the whole batch."""
    m, s = F.col("metrics"), F.col("structured_metadata")
    text = requests.select("query_id", F.substring("text", 1, fixed.LOGGED_CHARS).alias("query"))
    return responses.join(text, "query_id").select("query", "session_id", F.lit(float(latency_ms)).alias("latency_ms"), m["avg_similarity"].alias("avg_similarity"), m["top_similarity"].alias("top_similarity"), m["total_chunks"].cast("long").alias("total_chunks"), F.when(s.isNotNull(), F.size(s["codigos_h"])).alias("codigos_h_count"), F.when(s.isNotNull(), F.size(s["codigos_p"])).alias("codigos_p_count"))
