"""Operator 1: mix sources to target weights by entropy balancing.

The mix takes document i at rate r_i in [0, cap]. Among all rates whose words meet each source's
target, it takes those nearest to 1 in relative entropy (sum of r log r - r). The dual is convex,
with one multiplier per token constraint, and its solution tilts exponentially:
r_i = min(cap, exp(multiplier of i's source * size_i / mean size of the source)).
Newton iterations, each one distributed aggregation, find the multipliers; a bracket guards them.
Rates depend on source and size alone, so they run over the histogram of sizes, not over documents.

All sums are of integers (rates in units of 2^-30), hence the same in every order of rows.
Rounding into whole copies carries the remainder along documents of like size, in groups of about
GROUP documents dealt by the hash of the id, so that no source needs one task.

Null, empty and word-free texts have size 0: rate 1, nothing taken. A null source is a source of its
own. Repeated rows, and rows without id, are mixed one by one, in order of a hash of all their columns where
ids are equal, so reruns agree. Very long texts are counted whole. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, word_count

UNIT = 1 << 30
GROUP = 4096


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: its words, documents and target. Sources by code point, nulls last, take `weights` in turn.

    The targets share `share` times all words by weight; none exceeds `cap` times its source, and what is over
    goes to the others by weight. (target = min(limit, level * weight): the level follows from running sums in
    order of limit / weight.) One row per source throughout.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    per = per.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    per = per.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"), "full")


def _rate(cap: float) -> F.Column:
    """Units taken of a document: needs size, mean, multiplier and full."""
    tilt = F.exp(F.col("multiplier") * F.col("size") / F.col("mean"))
    return F.when(F.col("full"), F.lit(int(cap * UNIT))).otherwise(F.round(F.least(F.lit(float(cap)), tilt) * UNIT)).cast("long")


def multipliers(hist: DataFrame, goals: DataFrame, cap: float, scratch: Scratch, most: int = 60, close: float = 1e-7) -> DataFrame:
    """Solve the dual: `goals` with a multiplier per source. hist: source, size, n.

    Each round is one aggregation of the histogram and yields, for each source not yet within `close` of its
    target, the Newton step on the logarithm of its words, or the middle of its bracket where that step leaves it.
    """
    n = F.col("n_docs").cast("double")
    state = goals.select("source", "source_size", "n_docs", "target", "full", F.greatest(F.col("source_size") / n, F.lit(1e-9)).alias("mean"), F.lit(0.0).alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (F.col("full") | (F.col("source_size") == 0)).alias("done"))
    state = scratch.write(state)
    same = F.col("h.source").eqNullSafe(F.col("s.source"))
    for _ in range(most):
        if state.filter(~F.col("done")).isEmpty():
            return state
        units = _rate(cap)
        at = hist.alias("h").join(state.filter(~F.col("done")).alias("s"), same).select("s.*", "size", "n")
        whole = (F.col("n") * F.col("size")).cast("decimal(38,0)")
        slope = F.when(units < int(cap * UNIT), units * F.col("size") / F.col("mean")).otherwise(0.0).cast("decimal(20,0)")
        keys = ["source", "source_size", "n_docs", "target", "full", "mean", "multiplier", "low", "high"]
        sums = at.groupBy(*keys).agg((F.sum((whole * units.cast("decimal(20,0)")).cast("decimal(38,0)")).cast("double") / UNIT).alias("words"), (F.sum((whole * slope).cast("decimal(38,0)")).cast("double") / UNIT).alias("slope"))
        over = F.col("words") - F.col("target")
        low, high = F.when(over < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(over >= 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - F.col("words") * F.log(F.greatest(F.col("words"), F.lit(1e-9)) / F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.coalesce(low, F.lit(-1e300))) & (newton < F.coalesce(high, F.lit(1e300))) & (F.abs(newton - F.col("multiplier")) < 50)
        middle = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.when(over < 0, F.col("multiplier") + 1 + F.abs("multiplier")).otherwise(F.col("multiplier") - 1 - F.abs("multiplier")))
        done = (F.abs(over) <= F.col("target") * close) | (F.coalesce(high - low, F.lit(1.0)) < 1e-12)
        step = F.when(done, F.col("multiplier")).otherwise(F.round(F.when(inside, newton).otherwise(middle), 13))
        moved = sums.select(*keys[:6], step.alias("multiplier"), low.alias("low"), high.alias("high"), done.alias("done"))
        ready = state.filter("done")
        last, state = state, scratch.write(moved.unionByName(ready))
        scratch.drop(last)
    if not state.filter(~F.col("done")).isEmpty():
        raise RuntimeError(f"the mix did not settle in {most} rounds")
    return state


def _mixed(docs: DataFrame, source: str, key: str, size: str | None, text: str, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """row (a struct of docs' columns), size, source_size, target, units taken and copies of every row."""
    scratch = Scratch(docs.sparkSession)
    # a null id says nothing: the rest of the row deals it out (equal rows are equal wherever they go)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    rest = F.xxhash64(*plain)
    dealt = F.when(F.col(key).isNull(), rest).otherwise(F.xxhash64(key))
    counted = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else word_count(F.col(text))
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(key).alias("key"), dealt.alias("hash"), rest.alias("rest"), counted.alias("size"))
    hist = scratch.write(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap).drop("n_docs")
    n_docs = hist.groupBy("source").agg(F.sum("n").alias("n_docs"))
    goals = goals.alias("g").join(n_docs.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source"))).select("g.*", "n_docs")
    solved = multipliers(hist, goals, cap, scratch).withColumn("groups", F.ceil(F.col("n_docs") / GROUP))
    joined = rows.alias("r").join(solved.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "source_size", "target", "mean", "multiplier", "full", "groups")
    joined = joined.withColumn("units", _rate(cap)).withColumn("part", F.pmod(F.shiftright("hash", 3), F.col("groups")))
    order = Window.partitionBy("source", "part").orderBy(F.col("size").desc(), "hash", "key", "rest").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("run", F.sum("units").over(order) + UNIT // 2)
    copies = F.floor(F.col("run") / F.lit(UNIT)) - F.floor((F.col("run") - F.col("units")) / F.lit(UNIT))
    return joined.select("row", "size", "source_size", "target", "units", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, *, source: str = "source", key: str = "doc_id", size: str | None = None, text: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target, mix_rate and mix_copies (0 to cap) appended.

    size: a column with the number of words (null: 0); without it, the words of `text` count.
    Input columns of these five names are replaced; all others, whatever their names, pass through unchanged.
    """
    own = {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_rate": F.col("units") / F.lit(UNIT), "mix_copies": F.col("copies")}
    out = _mixed(docs, source, key, size, text, weights, share, cap)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *[x.alias(c) for c, x in own.items()])


def repeat(docs: DataFrame, *, source: str = "source", key: str = "doc_id", size: str | None = None, text: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs in as many copies as the mix takes, with all their columns unchanged; parameters as for `mix`."""
    mixed = _mixed(docs, source, key, size, text, weights, share, cap).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with weights 3, 1, 2 to 150 % of their words, at most twice each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    narrow = Scratch(spark).write(docs)
    mixed = mix(narrow, size="size")
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))
