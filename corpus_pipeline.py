"""Corpus pipeline: documents of quality, without repeated lines and near duplicates, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `docs` is all that the stage before kept. All
stages but the last return the columns of `documents`. Stages whose result passes through Python workers set the
session's Arrow batches to few rows, as whole texts are in them. Empty tables, nulls, repeated rows and very long texts
pass through as the operators' docstrings say; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fichero.llm import bpe, classifier, line_dedup, mixing, near_dups
from fichero.llm.common import Scratch, small_batches, table

#: What a worker of the last stage keeps, and only in its task: little, as workers serve other stages of the session too.
KEPT, TOGETHER = 60_000, 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score below classifier.THRESHOLD go. Labels of held-out rows are not learned from."""
    small_batches(spark)
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.keep(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that repeat an earlier line go, and documents of which nothing is left."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near duplicates the document of least id stays."""
    return near_dups.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents in as many copies as the mix takes; those of none go."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, source, n_tokens, ids and digest of the decoded text (decoded_sha256) of every row."""
    small_batches(spark)
    return bpe.encode(docs, bpe.Vocabulary.read(bpe.default_path()), output="both", others=("source",), kept=KEPT, together=TOGETHER, hold=False)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
#: The stages fit models, search and iterate: SQL cannot express them. tests/llm hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written before the next one reads it."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
