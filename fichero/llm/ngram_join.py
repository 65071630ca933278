"""Operator 13: n-gram Jaccard join with filters of several global orders.

A document's set holds its distinct shingles of WORDS words; documents of equal sets form a class, stood for by
its least id. Two sets of similarity PERCENT share at least one token of their prefixes, the first
n - ceil(PERCENT * n / 100) + 1 of n, under any order that holds for all sets. Here there are several such orders:
order 0 puts rare tokens first (frequency counted over all documents in hashed slots), orders 1 to ORDERS - 1
are those of independent mixings of the tokens' hashes. A pair is a candidate only if it shares a prefix token
under every order; what passes is verified on full sets, and links are confirmed on the words.

Lists of order 0 find the pairs. Lists with the same members are taken once. Pairs of a list are not made rows: all
members are first held against the most central one, and confirmed links make components. Members of lists that still hold
several components meet by size, in levels that the similarity can bridge. Tasks compare them by marks: prefixes of the
other orders, in 16 bits a token, and parity bitmaps, which differ in no more bits than the sets do in tokens. As few
pairs as would join the components are confirmed; where marks allow more than that, full sets are compared. Lists too large for a
task are dealt anew by the prefix tokens of the next order where that spares comparisons, as similar members share one of these too, so that
only what agrees under all orders so far meets; what is still too large (near copies that are no links) is cut into blocks, compared
in pairs. A pair inside a component adds nothing, so the components are those of all links.

Sets of fewer than 9 shingles match equal ones only (at 90 %), so their class decides. Rows without id take no
part: they come back with their number of shingles and no component. Texts without a word, and null ones, have no shingle and no link; those of fewer words than a
shingle have one, their whole sequence. Rows that repeat an id are one document, with the least of their texts. Very long texts
have as long prefixes and fill tasks of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from . import line_dedup
from .common import Scratch, marked_slots, table, trimmed
from .components import components
from .near_dups import BUCKET, Candidates, by_id, by_size, in_blocks, led, mixed, named, scan, several, shares, shingles, whole_groups

WORDS, PERCENT, ORDERS = 3, 90, 3
#: Slots of the table of frequencies, a byte each: there are many more shingles than words.
SLOT_BITS = 27
#: Members of a list up to which one task reads it whole.
LIST = 20_000
#: Bits of the table that names wanted documents.
WANTED_BITS = 27
_MIX = [(np.uint64(0), np.uint64(0)), (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens among which a set of n shares one with every set that is similar enough."""
    return n + (-percent * n) // 100 + 1


def in_order(tokens: np.ndarray, which: int, p: int) -> np.ndarray:
    """The first p tokens under order `which` (1 or more), as that order's numbers, ascending."""
    a, b = _MIX[which]
    x = tokens * a
    x ^= x >> np.uint64(31)
    x *= b
    x ^= x >> np.uint64(29)
    return np.sort(np.partition(x, p - 1)[:p] if p < len(x) else x)


def _bits(n: int) -> int:
    """Bits of the parity bitmap of a set of n."""
    return 1 << max(6, (n - 1).bit_length())


def mark(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """What is compared before sets are: n, the parity bitmap, and 16 bits of each prefix token of orders 1 to ORDERS - 1."""
    n = len(tokens)
    bits = _bits(n)
    slot = ((tokens ^ (tokens >> np.uint64(33))) & np.uint64(bits - 1)).astype(np.int64)
    parity = np.packbits(np.bincount(slot, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()
    prefixes = (in_order(tokens, o, prefix_length(n, percent)) for o in range(1, ORDERS))
    return n.to_bytes(4, "little") + parity + b"".join(np.sort((p & np.uint64(0xFFFF)).astype("<u2")).tobytes() for p in prefixes)


class Mark:
    """A mark, read."""

    def __init__(self, blob: bytes):
        self.n = int.from_bytes(blob[:4], "little")
        size = _bits(self.n) // 8
        self.parity = np.frombuffer(blob[4 : 4 + size], "<u8")
        self.prefixes = np.frombuffer(blob[4 + size :], "<u2").reshape(ORDERS - 1, -1)

    def folded(self, words: int) -> np.ndarray:
        """The parity bitmap of fewer bits."""
        return np.bitwise_xor.reduce(self.parity.reshape(-1, words), 0)

    def meets(self, other: Mark) -> bool:
        """Whether both share a prefix token under every order from 1 on."""
        return all(_meet(p, q) for p, q in zip(self.prefixes, other.prefixes))


def _meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending arrays share a number."""
    at = np.searchsorted(b, a)
    return bool((b[np.minimum(at, len(b) - 1)] == a).any())


def _near(marks: list[Mark], percent: int) -> np.ndarray:
    """Which pairs the parity bitmaps allow: sets differ in at least as many tokens as these in bits."""
    words = min(len(m.parity) for m in marks)
    x, n = np.stack([m.folded(words) for m in marks]), np.array([m.n for m in marks], np.int64)
    out = np.empty((len(marks), len(marks)), bool)
    step = max(1, (1 << 22) // (len(marks) * words))
    for a in range(0, len(marks), step):
        differ = np.bitwise_count(x[a : a + step, None, :] ^ x[None, :, :]).sum(2, dtype=np.int64)
        out[a : a + step] = differ * (100 + percent) <= (n[a : a + step, None] + n[None, :]) * (100 - percent)
    return out


def _agree(percent: int):
    @F.pandas_udf(BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        """Whether marks allow the similarity."""
        out = []
        for x, y in zip(a, b):
            pair = [Mark(x), Mark(y)]
            out.append(bool(_near(pair, percent)[0, 1]) and pair[0].meets(pair[1]))
        return pd.Series(out, dtype="bool")

    return run


def sets(docs: DataFrame, level: Broadcast, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest and prefix (of order 0) of every row. level: frequency of slots of tokens."""

    def prefix(s: np.ndarray) -> bytes:
        n = len(s)
        if 100 * n < percent * (n + 1):  # matches none but its equals
            return b""
        slot = level.value.table[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        return s[np.lexsort((s, slot))[: prefix_length(n, percent)]].astype("<u8").tobytes()

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t, words) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in own], "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in own], "prefix": [prefix(s) for s in own]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, digest binary, prefix binary")


_POSTING = ["band", "rep", "n_shingles"]


def _postings(classes: DataFrame, level: Broadcast) -> DataFrame:
    """band (a token), rep, n_shingles and hot (whether the list may be too long for a task) of the prefixes of order 0."""
    most = line_dedup._level(np.array([LIST]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            count = np.array([len(p) // 8 for p in blobs], np.int64)
            token = np.frombuffer(b"".join(blobs), "<u8")
            hot = level.value.table[(token >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] > most
            each = lambda i: pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), count).astype(np.int64))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), each(0), each(1), pa.array(hot)], [*_POSTING, "hot"])

    return classes.filter(F.length("prefix") > 0).select("rep", "n_shingles", "prefix").mapInArrow(run, "band long, rep long, n_shingles long, hot boolean")


def _lists(postings: DataFrame) -> DataFrame:
    """band, rep, n_shingles, size: members of lists of two or more. Lists of the same members become one, known by a hash of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in line_dedup._groups(batches, _POSTING, ("band",)):
            begins = np.flatnonzero(line_dedup._begins(x, ("band",)))
            size = np.diff(np.append(begins, len(x["band"])))
            h = x["rep"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            band = np.add.reduceat(h ^ (h >> np.uint64(32)), begins).view(np.int64)
            first = np.zeros(len(begins), bool)
            first[np.unique(band, return_index=True)[1]] = True
            keep = np.repeat(first & (size > 1), size)
            columns = (np.repeat(band, size), x["rep"], x["n_shingles"], np.repeat(size, size))
            yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(np.int64)) for c in columns], [*_POSTING, "size"])

    short = postings.filter("not hot").select(*_POSTING).repartition("band").sortWithinPartitions("band").mapInArrow(run, "band long, rep long, n_shingles long, size long")
    hot = postings.filter("hot").select(*_POSTING)
    long = hot.join(hot.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "band")
    return short.unionByName(long.select(short.columns)).distinct()


def _texts(docs: DataFrame, nodes: DataFrame, words: int, percent: int, repeated: bool) -> DataFrame:
    """rep, text, mark of the documents named by nodes (rep), and of some others: which to take is told by a table of fixed size."""
    slot = lambda ids: ids & ((1 << WANTED_BITS) - 1)
    wanted = marked_slots(nodes.select(F.col("rep").bitwiseAND(F.lit((1 << WANTED_BITS) - 1)).alias("slot")), WANTED_BITS)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slot(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            some = batch.take(pa.array(np.flatnonzero(wanted.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)))
            own = [shingles(t.as_py(), words) for t in some.column(1)]
            marks = pa.array([mark(s, percent) if len(s) else None for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), marks], ["rep", "text", "mark"])

    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias("rep"), F.col("text").cast("string"))
    found = rows.mapInArrow(run, "rep long, text string, mark binary").filter("mark is not null")
    return found.dropDuplicates(["rep"]) if repeated else found


_MEMBER = ["band", "level", "part", "block", "upper", "rep", "component"]


def _light(members: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Members (_MEMBER, mark) compared by their marks inside (band, level, part).

    pairs: (u, v) of different components that the marks allow, as few as would join these components. Otherwise
    the members that have such a partner.
    """
    keys = ["band", "level", "part"]

    def of(x: pd.DataFrame) -> pd.DataFrame:
        component, block, upper = x["component"].to_numpy(), x["block"].to_numpy(), x["upper"].to_numpy().astype(bool)
        marks = [Mark(m) for m in x["mark"]]
        may = ~(upper[:, None] & upper[None, :]) & ((block[:, None] == 0) | (block[:, None] != block[None, :])) & (component[:, None] != component[None, :])
        u, v = np.nonzero(np.triu(may & _near(marks, percent), 1))
        if not pairs:
            has = np.zeros(len(x), bool)
            for a, b in zip(u.tolist(), v.tolist()):
                if not (has[a] and has[b]) and marks[a].meets(marks[b]):
                    has[a] = has[b] = True
            return x.loc[has, _MEMBER]
        rep, label, out = x["rep"].to_numpy(), component.copy(), []
        while len(u):
            lead = np.unique(label[u], return_index=True)[1]
            tried = np.zeros(len(u), bool)
            for i in lead:
                a, b = label[u[i]], label[v[i]]
                tried[i] = True
                if a != b and marks[u[i]].meets(marks[v[i]]):
                    out.append((rep[u[i]], rep[v[i]]))
                    label[label == max(a, b)] = min(a, b)
            apart = ~tried & (label[u] != label[v])
            u, v = u[apart], v[apart]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_groups(batches, keys):
            if x["component"].nunique() > 1:
                yield of(x)

    schema = "u long, v long" if pairs else "band long, level long, part long, block int, upper boolean, rep long, component long"
    return members.select(*_MEMBER, "mark").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _next_order(members: DataFrame, marks: DataFrame, order: int) -> DataFrame:
    """members (band, level, upper, rep, n_shingles) of large lists, dealt anew by their prefix tokens of the next order."""
    names = ["band", "level", "upper", "rep", "n_shingles"]

    @F.pandas_udf(ArrayType(IntegerType()))
    def tokens(blobs: pd.Series) -> pd.Series:
        return pd.Series([np.unique(Mark(b).prefixes[order - 1]).astype(np.int32) for b in blobs])

    dealt = members.select(*names).join(marks, "rep").select(*names, F.explode(tokens("mark")).alias("token"))
    # near copies share most tokens: their lists stay as they are, to be cut into blocks
    work = lambda name: F.sum(F.col("n") * F.col("n")).alias(name)
    whole = members.groupBy("band", "level").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "level").agg(work("before"))
    parts = dealt.groupBy("band", "level", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "level").agg(work("after"))
    helped = parts.join(whole, ["band", "level"]).filter("2 * after < before").select("band", "level")
    fresh = dealt.join(helped, ["band", "level"], "left_semi").select(F.xxhash64("band", "token").alias("band"), *names[1:])
    return fresh.unionByName(members.select(*names).join(helped, ["band", "level"], "left_anti"))


def _grouped(docs: DataFrame, narrow: DataFrame, level: Broadcast, scratch: Scratch, words: int, percent: int, bucket: int) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text); rows of one id are alike."""
    some = narrow.filter("doc_id is not null and n_shingles > 0")
    repeated = not some.groupBy("doc_id").count().filter("count > 1").isEmpty()
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "prefix")).alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(classes.select("digest", F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.prefix", "copies"))
    scratch.release()
    members = scratch.write(_lists(_postings(classes, level)))
    scratch.release()
    texts = scratch.write(_texts(docs, members.select("rep").distinct(), words, percent, repeated), rows=200)
    marks = texts.select("rep", "mark")
    candidates = Candidates(marks, _agree(percent), texts.select("rep", "text"), scratch, words, percent)
    found = components(candidates.confirm(led(members, percent)), scratch)

    def joined(links: DataFrame) -> DataFrame:
        return components(links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))), scratch)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.drop("component").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    live = scratch.write(by_size(mixed(members.select(*_POSTING), found), percent))
    scratch.release()
    for order in range(1, ORDERS + 1):
        sized = live.join(live.groupBy("band", "level").agg(shares(bucket).alias("share")), ["band", "level"])
        small = sized.filter("share <= 1").drop("share").withColumns({"part": F.lit(0).cast("long"), "block": F.lit(0)})
        large = scratch.write(sized.filter("share > 1").drop("share"))
        last = large.isEmpty() or order == ORDERS
        if last:
            small = small.unionByName(in_blocks(large, bucket).select(small.columns))
        small = scratch.write(small.select(*_MEMBER))
        # the pairs that marks allow are nearly all links; those that are not may hide others, which full sets find
        found = joined(candidates.confirm(_light(small.join(marks, "rep"), percent, pairs=True)))
        left = scratch.write(_light(labelled(small).join(marks, "rep"), percent, pairs=False))
        scratch.release()
        if not left.isEmpty():
            hashed = texts.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", "text").mapInPandas(_hashed(words), "rep long, hashes binary")
            found = joined(candidates.confirm(scan(left.join(scratch.write(hashed), "rep"), percent)))
        if last:
            break
        dealt = labelled(_next_order(large, marks, order))
        live = scratch.write(several(dealt, "band", "level"))
        scratch.release()
    for done in (texts, members):
        scratch.drop(done)
    # rows without id have no component
    return named(narrow, classes, found).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def _hashed(words: int):
    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "hashes": [shingles(t, words).astype("<u8").tobytes() for t in batch["text"]]})

    return run


class Levels:
    """Level of frequency of every slot; compressed on the driver, on its way and on disks."""

    def __init__(self, packed: dict[int, bytes]):
        self.packed = packed

    @cached_property
    def table(self) -> np.ndarray:
        return line_dedup.unpacked_levels(self.packed, SLOT_BITS)


def frequency(docs: DataFrame, words: int = WORDS) -> Broadcast:
    """Levels of the tokens of all texts (doc_id, text): a table of fixed size, sent to all tasks."""
    every = lambda texts: np.concatenate([shingles(t, words) for t in texts] or [np.zeros(0, np.uint64)])
    return docs.sparkSession.sparkContext.broadcast(Levels(line_dedup.packed_levels(docs, "text", every, SLOT_BITS)))


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) for every row of docs."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    level = frequency(rows, words)
    return by_id(rows, lambda x: sets(x, level, words, percent), lambda x, signed: _grouped(x, signed, level, scratch, words, percent, bucket), scratch)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 3-word shingles at 90 %."""
    return group(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every pair that shares a shingle, and reachability by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2]) WHEN len(t) > 0 THEN [t] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, g FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
k AS (SELECT doc_id AS node, doc_id AS to_id FROM n UNION SELECT k.node, l.v FROM k JOIN l ON l.u = k.to_id),
m AS (SELECT node, min(to_id) AS component_id FROM k GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
"""
