"""Similarity ratio of words by matching blocks, as Python's own difflib defines it."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(word: pd.Series, term: pd.Series) -> pd.Series:
    """Ratio of a word to a term; null for nulls. Equal pairs are computed once a batch."""
    known: dict[tuple, float | None] = {}
    matcher = difflib.SequenceMatcher()

    def of(w, t):
        if w is None or t is None:
            return None
        matcher.set_seq2(w)
        matcher.set_seq1(t)
        return matcher.ratio()

    return pd.Series([known[p] if p in known else known.setdefault(p, of(*p)) for p in zip(word, term)], dtype="float64")


#: Letters of Spanish and English from rare to frequent; others count as rarer. Any order gives right results, this one short lists.
_LETTERS = "qjkxzwvyfghbpmuldcrntsioae"


def characters(word: Column) -> Column:
    """The characters of a word, each numbered among its like, rare ones first: the common part of two such lists counts what two words share."""
    letters = F.array_sort(F.filter(F.split(word, ""), lambda c: c != ""))

    def tokens(own: Column) -> Column:
        numbered = F.transform(own, lambda c, i: F.struct((F.array_position(own, c) - 1 - i).alias("nth"), F.position(c, F.lit(_LETTERS)).alias("rank"), c.alias("c")))
        return F.transform(F.array_sort(numbered), lambda x: F.concat(x["c"], x["nth"].cast("string")))

    # the letters are bound once, as the element of an array
    return F.get(F.transform(F.array(letters), tokens), F.lit(0))


def candidates(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """Pairs (a, b) of distinct words whose lengths and characters allow a ratio of `cutoff`.

    A ratio is twice the matched characters by all, and matched ones are common ones. So words that reach it share
    at least cutoff * n / (2 - cutoff) of their n characters, and hence one among the first n - that + 1 of each in any fixed
    order: pairs come from an equality join on these and on the length, and no word meets all others. Where the first
    common character stands bounds how many more there can be; then common characters are counted.
    """

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(df: DataFrame, word: str, listed: str, at: str) -> DataFrame:
        own = df.select(F.col(word).alias(word)).filter(F.length(word) > 0).distinct().repartition(parts, word)  # few words are much work
        own = own.select(word, characters(F.col(word)).alias(listed))
        n = F.size(listed)
        return own.select(word, listed, F.posexplode(F.slice(listed, F.lit(1), n - F.ceil(cutoff * n / (2 - cutoff) - 1e-9).cast("int") + 1)).alias(at, "_token"))

    m, n = F.size("_x"), F.size("_y")
    lengths = F.sequence(F.ceil(cutoff * n / (2 - cutoff) - 1e-9).cast("int"), F.floor(n * (2 - cutoff) / cutoff + 1e-9).cast("int"))
    x = side(left, a, "_x", "_i").withColumn("_n", m)
    y = side(right, b, "_y", "_j").withColumn("_n", F.explode(lengths))
    least = cutoff * (m + n) / 2 - 1e-9
    rest = F.least(m - F.col("_i"), n - F.col("_j")) >= least
    common = F.size(F.array_intersect("_x", "_y")) >= least
    return x.repartition(parts, "_token", "_n").join(y, ["_token", "_n"]).filter(rest & common).select(a, b).distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """a, b, ratio of all pairs of distinct words, null and empty ones left out, whose ratio is at least `cutoff` (above 0, 1 at most)."""
    return candidates(left, right, a, b, cutoff).withColumn("ratio", ratio(a, b)).filter(F.col("ratio") >= cutoff)
