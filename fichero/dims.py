"""The fixed values as small tables. Each has a fixed number of rows, so joins may broadcast it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixed


def hazards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.HAZARDS.items()), "codigo string, descripcion string")


def precautions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.PRECAUTIONS.items()), "codigo string, descripcion string")


def pictograms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.PICTOGRAMS.items()), "codigo string, pictograma string")


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.SECTIONS.items()), "numero int, nombre string")


def query_types(spark: SparkSession) -> DataFrame:
    """type_order, type, field, search_level, sections, keyword: one row per key word."""
    rows = [(i, t, fixed.QUERY_FIELD.get(t), fixed.SEARCH_LEVEL, [fixed.SECTIONS[n] for n in fixed.QUERY_SECTIONS[t]], k) for i, (t, words) in enumerate(fixed.QUERY_TYPES.items()) for k in words]
    return spark.createDataFrame(rows, "type_order int, type string, field string, search_level string, sections array<string>, keyword string")
