"""What a question asks for: its type and its product, exactly or by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims, fixed
from ..functions import text as T
from ..functions import patterns
from ..functions.fuzzy import fuzzy_join
from ..shared import settled


_TYPE_WORDS = [(t, w) for t, words in fixed.QUERY_TYPES.items() for w in words]


def query_type(questions: DataFrame, key: str = "query_id", text: str = "text", fuzzy: bool = True) -> DataFrame:
    """key, query_type: the first type, in order, of which the text holds a key word; else the nearest by words."""
    words = [w for _, w in _TYPE_WORDS]
    found = _exact(questions, text, words, [t for t, _ in _TYPE_WORDS], "query_type")  # words are in order of types
    if not fuzzy:
        return found.select(key, "query_type")
    return _or_nearest(found, key, text, "query_type", [(t, w, t) for t, w in _TYPE_WORDS], fixed.TYPE_WORD, fixed.TYPE_RATIO)


def product(questions: DataFrame, key: str = "query_id", text: str = "text", fuzzy: bool = True) -> DataFrame:
    """key, product: that of the longest term which the text holds; else the nearest by words."""
    terms = sorted(fixed.PRODUCT_TERMS, key=len, reverse=True)
    found = _exact(questions, text, terms, [fixed.PRODUCT_TERMS[t] for t in terms], "product")
    if not fuzzy:
        return found.select(key, "product")
    return _or_nearest(found, key, text, "product", [("", t, p) for t, p in fixed.PRODUCT_TERMS.items()], fixed.PRODUCT_WORD, fixed.PRODUCT_RATIO)


def _exact(questions: DataFrame, text: str, terms: list[str], values: list[str], name: str) -> DataFrame:
    """questions with the value of the first term, in order, that the text holds: all terms in one pass."""
    held = patterns.terms_held(F.lower(F.coalesce(F.col(text), F.lit(""))), terms)
    return questions.withColumn("_held", held).withColumn(name, F.get(F.lit(values), F.get("_held", F.lit(0)))).drop("_held")


def _or_nearest(found: DataFrame, key: str, text: str, name: str, terms: list[tuple[str, str, str]], least: int, cutoff: float) -> DataFrame:
    # written once: the exact matches are read by both sides of the join
    found = settled(found.select(key, text, name), "exact")
    near = _nearest(found.filter(F.col(name).isNull()), key, text, terms, least, cutoff)
    return found.join(near.withColumnRenamed("value", "near"), key, "left").select(key, F.coalesce(name, "near").alias(name))


def _nearest(questions: DataFrame, key: str, text: str, terms: list[tuple[str, str, str]], least: int, cutoff: float) -> DataFrame:
    """key, value: groups in order, then words in order; of a word's terms the one of highest ratio, then the greater.

    Only distinct words meet the terms, by a join that compares lengths and characters first.
    """
    words = questions.select(F.col(key).alias("key"), F.posexplode(F.filter(T.words_of(F.lower(F.col(text))), lambda w: F.length(w) >= least)).alias("pos", "word"))
    groups = list(dict.fromkeys(g for g, _, _ in terms))
    listed = questions.sparkSession.createDataFrame([(groups.index(g), t, v) for g, t, v in terms], "turn int, term string, value string")
    scored = fuzzy_join(words.select("word").distinct(), listed.select("term").distinct(), "word", "term", cutoff).join(F.broadcast(listed), "term")  # a fixed list
    best = scored.groupBy("word", "turn").agg(F.max(F.struct("ratio", "term", "value")).alias("x")).select("word", "turn", "x.value")
    hits = words.join(best, "word").groupBy("key").agg(F.min(F.struct("turn", "pos", "value")).alias("x"))
    return hits.select(F.col("key").alias(key), "x.value")


def longest_match(rows: DataFrame, terms: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """key, term: the longest term (then the least) that the text holds; rows without one are left out.

    Terms are cut from the texts as runs of words of the lengths that terms have, so that the join is by equality
    and no text meets all terms. Terms must be whole words of the text.
    """
    norm = lambda c: F.array_join(T.words_of(F.lower(c)), " ")
    own = terms.select(norm(F.col(term)).alias("_norm"), F.col(term).alias("_term")).filter("_norm <> ''")
    lengths = sorted(r[0] for r in own.select(F.size(F.split("_norm", " ")).alias("n")).distinct().collect())  # word counts of terms
    words = T.words_of(F.lower(F.col(text)))

    def runs_of(n: int) -> F.Column:
        last = F.size("_words") - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda i: F.array_join(F.slice("_words", i + 1, n), " "))).otherwise(F.array())

    runs = F.array_distinct(F.flatten(F.array(*map(runs_of, lengths)))) if lengths else F.array().cast("array<string>")
    cut = rows.select(F.col(key).alias("_key"), words.alias("_words")).select("_key", F.explode(runs).alias("_norm"))
    hits = cut.join(own, "_norm").groupBy("_key").agg(F.max(F.struct(F.length("_term").alias("n"), "_term")).alias("x"))
    return hits.select(F.col("_key").alias(key), F.col("x._term").alias("term"))


def levels(spark) -> DataFrame:
    """Search level of each known query type."""
    return dims.query_types(spark).select("type", "search_level").distinct()


def search_level(column: str = "query_type") -> F.Column:
    return F.when(F.col(column).isin(list(fixed.QUERY_TYPES)), fixed.SEARCH_LEVEL).otherwise(fixed.OTHER_LEVEL)
