"""Increments: which documents changed, which chunks are new, and the counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, hash, size, status (new, modified, deleted, same) of current files against the last manifest."""
    a, b = current.alias("a"), manifest.alias("b")
    status = F.when(F.col("b.name").isNull(), "new").when(F.col("a.name").isNull(), "deleted").when(F.col("a.hash").eqNullSafe(F.col("b.hash")), "same").otherwise("modified")
    return a.join(b, F.col("a.name") == F.col("b.name"), "full_outer").select(F.coalesce("a.name", "b.name").alias("name"), F.col("a.hash").alias("hash"), F.col("a.size").alias("size"), status.alias("status"))


def work_list(changed: DataFrame) -> DataFrame:
    return changed.filter(F.col("status").isin("new", "modified")).select("name", "hash", "size")


def counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("status").count()


def new_rows(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the index does not hold, once each."""
    return rows.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def added_and_skipped(rows: DataFrame, existing: DataFrame, key: list[str], kind: str) -> DataFrame:
    """kind, status (added, skipped), count."""
    known = existing.select(*key).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, key, "left").groupBy(kind, F.when(F.col("_known"), "skipped").otherwise("added").alias("status")).count()


def current_index(index: DataFrame, replaced: DataFrame, document: str = "doc_key") -> DataFrame:
    """The index without the chunks of modified and deleted documents."""
    return index.join(replaced.select(document).distinct(), document, "left_anti")


def newest(chunks: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Of rows with the same id the one of the latest version."""
    return chunks.groupBy(key).agg(F.max_by(F.struct(*[c for c in chunks.columns if c != key]), version).alias("r")).select(key, "r.*")
