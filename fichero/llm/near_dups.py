"""Operator 8: near-duplicate documents by MinHash, banding and connected components.

A document's set holds its distinct 5-word shingles. Documents of equal sets form a class, stood for by its
least id. HASHES universal hash minima of each class are cut into bands of ROWS; classes that share a band are
candidates. At similarity 0.75 a pair shares no band with probability (1 - 0.75^4)^32 < 10^-5. Candidates
whose sizes or signatures rule out the similarity go; the others are confirmed on their full sets.

Pairs of a bucket are not made rows. In each bucket all members are first held against one leader, the most
central member (that of the fullest buckets). Confirmed links make components. In buckets that still hold
several components, a task then compares the members' whole sets (as 64-bit hashes) with each other and gives
out only links that join components; these are confirmed too. Links are confirmed on the words themselves.
Members of a bucket meet by size: sets fall in levels by their number of shingles, and a level is held against itself and the
next one only, as others cannot reach the similarity. Levels of more than BUCKET members, or SHINGLES in all, are cut into blocks, and
blocks are compared in pairs. A pair inside a component adds nothing, so the components are those of all links between members of a bucket.

Rows without id take no part and stay. Empty texts (no word) have no shingle and no link. Texts of fewer
words than a shingle have one shingle, their whole sequence. Rows that repeat an id are one document, with the
least of their texts. Ties (equal similarity) do not matter, as all links count. Very long texts fill blocks of
their own. An empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import Scratch, table, trimmed
from .components import components
from .hashing import word_hashes

WORDS = 5
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Links have 100 * common >= PERCENT * united.
PERCENT = 75
#: Least number of equal minima: six standard deviations below what similarity 0.75 gives.
LEAST_EQUAL = int(HASHES * 0.75 - 6 * (HASHES * 0.75 * 0.25) ** 0.5)
#: Members that one task compares at once, and shingles of them.
BUCKET, SHINGLES = 1500, 800_000

_random = np.random.default_rng(20240607)
_A = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
_C = _random.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending."""
    h, _ = word_hashes(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"")
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(words, len(h))
    n = len(h) - k + 1
    total = np.full(n, k * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(k):
        total += h[i : i + n] * _C[i]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(32)))


def _word_sets(text: str, words: int = WORDS) -> frozenset:
    """A text's shingles, as words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(zip(*(w[i:] for i in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])


def minima(hashes: np.ndarray) -> bytes:
    """HASHES minima of a set, four bytes each."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _A + _B).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (of the set) and minima of every row."""

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                sets = [shingles(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["key"].astype("Int64"), "n_shingles": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "minima": [minima(s) if len(s) else None for s in sets]})

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, n_shingles long, digest binary, minima binary")


@F.pandas_udf(IntegerType())
def _equal_minima(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), HASHES) for s in (a, b))
    return pd.Series((x == y).sum(1).astype("int32"))


def _linked(words: int, percent: int):
    """Of pairs (u, v, text_u, text_v) those whose full sets are similar enough."""

    @trimmed
    def run(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, frozenset())
        for batch in pairs:
            good = []
            for a, b in zip(batch["text_u"], batch["text_v"]):
                if last[0] != a:
                    last = (a, _word_sets(a, words))
                x, y = last[1], _word_sets(b, words)
                common = len(x & y)
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[np.array(good, bool), ["u", "v"]]

    return run


@trimmed
def _with_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with the hashes of their sets."""
    for batch in batches:
        yield batch.assign(hashes=[shingles(t).astype("<u8").tobytes() for t in batch["text"]])


class Candidates:
    """Confirms candidate pairs of classes: by marks (rep, mark) that `alike` compares, then on the words of texts (rep, text)."""

    def __init__(self, marks: DataFrame, alike: Callable[[str, str], Column], texts: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT):
        self.marks, self.alike, self.texts, self.scratch, self.words, self.percent = marks, alike, texts, scratch, words, percent

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """pairs: u, v. Those linked, as a written table."""
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        pairs = self.scratch.write(pairs)
        mark = lambda side: self.marks.select(F.col("rep").alias(side), F.col("mark").alias(f"mark_{side}"))
        alike = pairs.join(mark("u"), "u").join(mark("v"), "v").filter(self.alike("mark_u", "mark_v")).select("u", "v")
        alike = self.scratch.write(alike)
        self.scratch.release()
        text = lambda side: self.texts.select(F.col("rep").alias(side), F.col("text").alias(f"text_{side}"))
        whole = alike.join(text("u"), "u").join(text("v"), "v").select("u", "v", "text_u", "text_v")
        links = self.scratch.write(whole.mapInPandas(_linked(self.words, self.percent), "u long, v long").distinct())
        self.scratch.release()
        return links


def mixed(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Members (band, rep, ...) of buckets with more than one component, with their component."""
    own = members.withColumn("component", F.col("rep")) if found is None else members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return several(own, "band")


def several(members: DataFrame, *keys: str) -> DataFrame:
    """Members of groups with more than one component."""
    split = members.groupBy(*keys).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select(*keys)
    return members.join(split, [*keys], "left_semi")


def fits(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether sizes allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def by_size(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members with columns level and upper: each in the level of its size, and as an upper one in the level below.

    Sizes that allow the similarity differ by one level at most, so it is enough to compare the members of a level
    with each other and with its upper ones. Levels of one component go.
    """
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / width).cast("long")
    both = members.withColumn("at", F.explode(F.array(F.struct(level.alias("level"), F.lit(False).alias("upper")), F.struct((level - 1).alias("level"), F.lit(True).alias("upper")))))
    both = both.withColumn("level", F.col("at.level")).withColumn("upper", F.col("at.upper")).drop("at")
    own = both.filter("not upper").select("band", "level").distinct()
    return several(both.join(own, ["band", "level"], "left_semi"), "band", "level")


def shares(most: int) -> Column:
    """How many tasks' worth of work a group is."""
    return F.greatest(F.count(F.lit(1)) / F.lit(most), F.sum("n_shingles") / F.lit(SHINGLES))


def linked(may: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of members of different components whose sets are similar enough, as few as join them; of those that `may` allows."""
    n = np.array([len(s) for s in sets])
    may = may & (component[:, None] != component[None, :])
    may &= (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None])
    u, v = np.nonzero(np.triu(may, 1))
    if len(u) > 4 * len(sets):
        common = _common(sets)[u, v]
        good = 100 * common >= percent * (n[u] + n[v] - common)
        u, v = u[good], v[good]
    label, out = component.copy(), []
    while len(u):
        lead = np.unique(label[u], return_index=True)[1]  # one link of each component
        tried = np.zeros(len(u), bool)
        for i in lead:
            a, b = label[u[i]], label[v[i]]
            tried[i] = True
            if a != b:
                common = len(np.intersect1d(sets[u[i]], sets[v[i]], assume_unique=True))
                if 100 * common >= percent * (n[u[i]] + n[v[i]] - common):
                    out.append((u[i], v[i]))
                    label[label == max(a, b)] = min(a, b)
        apart = ~tried & (label[u] != label[v])
        u, v = u[apart], v[apart]
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each two sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[number] > 1
    owner, number = owner[shared], number[shared]
    column = np.full(len(seen), -1)
    some = np.unique(number)
    column[some] = np.arange(len(some))
    number = column[number]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(some), 4096):
        here = (number >= at) & (number < at + 4096)
        x = np.zeros((len(sets), min(4096, len(some) - at)), np.float32)
        x[owner[here], number[here] - at] = 1
        common += x @ x.T
    return common.astype(np.float64)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys, one by one, of batches in order of keys."""
    rest = None
    for batch in batches:
        rest = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        other = np.zeros(max(0, len(rest) - 1), bool)
        for c in keys:
            key = rest[c].to_numpy()
            other |= key[1:] != key[:-1]
        at = 0
        for end in (np.nonzero(other)[0] + 1).tolist():
            yield rest.iloc[at:end]
            at = end
        rest = rest.iloc[at:]
    if rest is not None and len(rest):
        yield rest


def scan(members: DataFrame, percent: int = PERCENT, filtered: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> DataFrame:
    """u, v: links that join components inside (band, level, part). members: band, level, part, block, upper, rep, component, hashes.

    Members of one block (but 0) are not compared with each other, nor are upper ones. `filtered` tells from the sets which pairs may be similar.
    """

    def found(x: pd.DataFrame) -> pd.DataFrame:
        component, block, upper = x["component"].to_numpy(), x["block"].to_numpy(), x["upper"].to_numpy().astype(bool)
        if (component == component[0]).all():
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        sets = [np.frombuffer(b, "<u8") for b in x["hashes"]]
        may = ~(upper[:, None] & upper[None, :]) & ((block[:, None] == 0) | (block[:, None] != block[None, :]))
        if filtered is not None:
            may &= filtered(sets)
        rep = x["rep"].to_numpy()
        return pd.DataFrame([(rep[i], rep[j]) for i, j in linked(may, component, sets, percent)], columns=["u", "v"], dtype="int64")

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_groups(batches, keys):
            yield found(x)

    keys = ["band", "level", "part"]
    return members.select(*keys, "block", "upper", "rep", "component", "hashes").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "u long, v long")


def in_blocks(members: DataFrame, most: int) -> DataFrame:
    """members (band, level, ...) with columns part and block: groups too large for a task are cut into blocks, and these compared in pairs."""
    share = shares(most)
    sizes = members.groupBy("band", "level").agg(F.when(share > 1, F.ceil(2 * share)).otherwise(F.lit(1)).cast("int").alias("blocks"))
    cut = members.join(sizes, ["band", "level"])
    own = (F.pmod(F.xxhash64("rep"), F.col("blocks")) + 1).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    part = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    return cut.withColumn("part", part).withColumn("block", F.when(F.col("own") == F.col("other"), 0).otherwise(F.col("own"))).drop("own", "other", "blocks")


def by_id(rows: DataFrame, signed: Callable[[DataFrame], DataFrame], grouped: Callable[[DataFrame, DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """grouped(rows, their signatures) for rows (doc_id, text) whose ids may repeat: the least text of an id stands for it. signed gives doc_id and digest, and more."""
    narrow = scratch.write(signed(rows))
    given = narrow.filter("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("digest").alias("n"), F.count(F.lit(1)).alias("rows"))
    unlike = given.filter("rows > 1 and (low <> high or n not in (0, rows))").select("doc_id")
    if unlike.isEmpty():
        return grouped(rows, narrow)
    unlike = scratch.write(unlike)
    least = rows.join(unlike, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    single = rows.join(unlike, "doc_id", "left_anti").unionByName(least)
    found = grouped(single, scratch.write(signed(single)))
    named = found.filter("doc_id is not null").distinct()
    return rows.select("doc_id").filter("doc_id is not null").join(named, "doc_id").select(found.columns).unionByName(found.filter("doc_id is null"))


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return by_id(rows, lambda x: signatures(x, "doc_id", "text"), lambda x, signed: _grouped(x, signed, bucket, scratch), scratch)


def led(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: each member (band, rep, n_shingles, size) with the most central one of its bucket, that of the fullest buckets, where sizes fit."""
    central = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    leaders = members.join(central, "rep").groupBy("band").agg(F.max(F.struct("weight", -F.col("rep"), "n_shingles")).alias("x"))
    leaders = leaders.select("band", (-F.col("x.col2")).alias("leader"), F.col("x.n_shingles").alias("leader_n"))
    return members.join(leaders, "band").filter((F.col("rep") != F.col("leader")) & fits("n_shingles", "leader_n", percent)).select(F.col("rep").alias("u"), F.col("leader").alias("v"))


def named(narrow: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of narrow, from its class and the components found of classes."""
    label = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).filter("copies > 1 or component <> rep").select("digest", "component")
    out = narrow.select("doc_id", "n_shingles", "digest").join(label, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, narrow: DataFrame, bucket: int, scratch: Scratch) -> DataFrame:
    """As group, of docs (doc_id, text) and their signatures; rows of one id are alike."""
    some = narrow.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.write(some.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "minima")).alias("x"), F.count(F.lit(1)).alias("copies")).select("digest", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.minima").alias("minima"), "copies"))
    scratch.release()

    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("minima", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])
    members = classes.select("rep", "n_shingles", F.explode(bands).alias("band"))
    counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = scratch.write(members.join(counts, "band"))
    scratch.release()
    first = led(members)

    nodes = members.select("rep").distinct()
    texts = docs.withColumnRenamed("doc_id", "rep").join(nodes, "rep", "left_semi").dropDuplicates(["rep"])
    texts = scratch.write(texts.mapInPandas(_with_hashes, "rep long, text string, hashes binary"))
    scratch.release()
    candidates = Candidates(classes.select("rep", F.col("minima").alias("mark")), lambda a, b: _equal_minima(a, b) >= LEAST_EQUAL, texts, scratch)
    found = components(candidates.confirm(first), scratch)
    live = scratch.write(by_size(mixed(members.select("band", "rep", "n_shingles"), found)))
    new = candidates.confirm(scan(in_blocks(live, bucket).join(texts.select("rep", "hashes"), "rep")))
    for done in (texts, live, members):
        scratch.drop(done)
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    found = components(stars.unionByName(new), scratch)

    out = named(narrow, classes, found)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the document of least id stays, once.

    Of rows that repeat an id, that of the least text stays. Other columns, whatever their names, pass through.
    """
    own = "__kept"
    while own in docs.columns:
        own += "_"
    kept = group(docs, key, text).filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n"))
    kept = Scratch(docs.sparkSession).write(kept)
    named = lambda ids: docs.join(ids.select(own), F.col(key).cast("long") == F.col(own), "left_semi")
    out = named(kept.filter("n = 1")).unionByName(docs.filter(F.col(key).isNull()))
    several = kept.filter("n > 1")
    if several.isEmpty():
        return out
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    order = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_last(), F.xxhash64(*plain))
    return out.unionByName(named(several).withColumn(own, F.row_number().over(order)).filter(F.col(own) == 1).drop(own))


def op8_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return group(table(spark, sf_dir, "documents").select("doc_id", "text"))
