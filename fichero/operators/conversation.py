"""Sessions: the product that a conversation is about, carried from turn to turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import settled
from . import analysis


def carried(turns: DataFrame, value: str, session: str = "session_id", turn: str = "turn", reset: str | None = None) -> DataFrame:
    """turns with `context`: the last value of earlier turns of the session; a true `reset` forgets what came before."""
    earlier = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    if reset is None:
        return turns.withColumn("context", F.last(value, ignorenulls=True).over(earlier))
    era = F.sum(F.coalesce(F.col(reset).cast("int"), F.lit(0))).over(Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy(session, "_era").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("_era", era).withColumn("context", F.last(value, ignorenulls=True).over(within)).drop("_era")


def understood(requests: DataFrame, fuzzy: bool = True) -> DataFrame:
    """requests (schemas.REQUEST) with context, question, query_type, detected and product.

    A question is enriched with the product of earlier turns; the product that filters is the one detected, else
    that of the context. Enriching adds a name that is itself a term of the same product, so products are first
    detected in the words as given and carried forward, then found again in the enriched question. Requests are known
    by their ids: rows without one are left out, of rows that repeat one the least (by session, turn and text) counts.
    """
    rest = [c for c in requests.columns if c != "query_id"]
    first = sorted(rest, key=lambda c: {"session_id": 0, "turn": 1, "text": 2}.get(c, 3))
    once = requests.filter("query_id is not null").groupBy("query_id").agg(F.min(F.struct(*first)).alias("r")).select("query_id", "r.*")
    given = once.select(requests.columns).withColumn("text", F.coalesce("text", F.lit("")))
    detected = given.join(analysis.product(given, fuzzy=fuzzy).withColumnRenamed("product", "_own"), "query_id")
    told = carried(detected, "_own").withColumn("context", F.when(F.coalesce("use_context", F.lit(True)), F.col("context")))
    # written once: both of what follows read it, and it holds a join by likeness of words
    told = settled(told.withColumn("question", T.enriched("text", "context")), "told")
    typed = analysis.query_type(told, text="question", fuzzy=fuzzy)
    named = analysis.product(told, text="question", fuzzy=fuzzy).withColumnRenamed("product", "detected")
    return told.drop("_own").join(typed, "query_id").join(named, "query_id").withColumn("product", F.coalesce("detected", "context"))


def ranked(turns: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """turns with their number in the session, from 1."""
    return turns.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy(turn)))


def sessions(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests with the state of their session; new sessions begin without product."""
    return requests.join(state, "session_id", "left")
