"""Operator 12: ranked lexical search by inverted treaps.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Tasks count the
terms of the documents they read and pack postings into shards; from these come the statistics (documents with
a term, terms in all, documents of each term). Then the impact of every posting is known, and tasks build the
index: for each term of a shard a treap, a search tree by document and a heap by impact.

A search goes down the treaps of all terms of a query at once. A stretch of documents has for each term the root of its
subtree there; the weighted sum of these roots' impacts is the most that a document of the stretch can score. Of the stretches
with the greatest sums, BATCH at a time, the document with the largest single part is scored exactly and divides the
stretch in two. Stretches whose sum cannot enter the k best so far (of all shards that the task has seen) are pruned, so
the result is exact, ties included. Queries travel in blocks that meet the rows of the index inside tasks; a task gives out
k rows for each query at most.

Where the queries have WANTED terms at most, only postings of these are packed (every document is read and counted
all the same); with more, the index holds all terms.

Null and empty texts have no term; they count for nothing and match nothing. Rows with a null id take no part,
on either side. Rows that repeat an id are documents of their own, and may both be listed; of items that repeat an id the least text is
asked. Very long texts are one document of a shard. Equal scores go to the lesser id. Empty tables give an empty
result. Other columns are not read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, trimmed

K = 20
#: Documents and postings after which a shard is closed.
DOCS, POSTINGS = 1 << 16, 1_000_000
#: Terms of the queries up to which they are sent to all tasks that read documents.
WANTED = 1 << 18
#: Queries of a block about, and stretches that are divided at once.
BLOCK, BATCH = 256, 256

_LETTERS = (string.digits + string.ascii_letters).encode()
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i in _LETTERS or i > 127 else 32 for i in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TABLE).split()


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds for each unit of its weight to a document of n terms that has it tf times."""
    m = 75 + (25 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(column)):
        yield key, text.as_py() or b""


_SHARD = "ids binary, lengths binary, terms array<binary>, sizes array<int>, docs binary, tf binary, documents long, total long"


class _Shard:
    """Postings of documents, as they are read."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}
        self.postings = self.documents = self.total = 0

    def add(self, key: int, text: bytes, wanted: frozenset | None) -> None:
        words = terms(text)
        if not words:
            return
        self.documents += 1
        self.total += len(words)
        found = Counter(words if wanted is None else filter(wanted.__contains__, words))
        if found:
            at = len(self.ids)
            self.ids.append(key)
            self.lengths.append(len(words))
            self.postings += len(found)
            for term, tf in found.items():
                own = self.lists.get(term)
                if own is None:
                    own = self.lists[term] = ([], [])
                own[0].append(at)
                own[1].append(tf)

    def full(self) -> bool:
        return self.documents >= DOCS or self.postings >= POSTINGS

    def row(self) -> pa.RecordBatch:
        join = lambda which: np.fromiter((v for own in self.lists.values() for v in own[which]), "<i4", self.postings).tobytes()
        sizes = pa.array([[len(d) for d, _ in self.lists.values()]], pa.list_(pa.int32()))
        binary = lambda v: pa.array([v], pa.binary())
        columns = [binary(np.array(self.ids, "<i8").tobytes()), binary(np.array(self.lengths, "<i8").tobytes()), pa.array([list(self.lists)], pa.list_(pa.binary())), sizes, binary(join(0)), binary(join(1)), pa.array([self.documents], pa.int64()), pa.array([self.total], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SHARD.split(", ")])


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: frozenset | None = None) -> DataFrame:
    """Postings of all documents, packed; only those of wanted terms where these are given."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # WANTED terms at most

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for k, t in _texts(batch, 1):
                shard.add(k, t, sent.value)
                if shard.full():
                    yield shard.row()
                    shard = _Shard()
        if shard.documents:
            yield shard.row()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.filter("key is not null and text is not null").mapInArrow(run, _SHARD)


def _treaps(impact: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of the treaps over consecutive runs of postings in order of document, and every posting's children (none: the number of postings)."""
    # of equal impacts a hash of the document decides, so that copies make no deep tree
    rank = (impact.astype(np.int64) << 20 | (doc.astype(np.int64) * 0x9E3779B1 & 0xFFFFFFFF) >> 12).tolist()
    none = len(rank)
    left, right, roots = [none] * none, [none] * none, []
    at = 0
    for size in sizes.tolist():
        path: list[int] = []  # right spine of the treap so far
        for i in range(at, at + size):
            below, x = none, rank[i]
            while path and rank[path[-1]] < x:
                below = path.pop()
            left[i] = below
            if path:
                right[path[-1]] = i
            path.append(i)
        roots.append(path[0])
        at += size
    return np.array(roots, "<i4"), np.array(left, "<i4"), np.array(right, "<i4")


_INDEX = "ids binary, terms array<binary>, sizes binary, roots binary, docs binary, impacts binary, lefts binary, rights binary"
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def _merged(held: list[dict], documents: int, total: int) -> pa.RecordBatch:
    """Treaps over the postings of shards, with documents in order of id."""
    read = lambda c, kind: np.concatenate([np.frombuffer(s[c], kind) for s in held])
    ids, lengths = read("ids", "<i8"), read("lengths", "<i8")
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    number: dict[bytes, int] = {}
    own = [np.array([number.setdefault(t, len(number)) for t in s["terms"]], np.int64) for s in held]
    term = np.concatenate([np.repeat(o, s["sizes"]) for o, s in zip(own, held)])
    before = np.concatenate([[0], np.cumsum([len(s["ids"]) // 8 for s in held])])
    doc = place[np.concatenate([np.frombuffer(s["docs"], "<i4") + b for s, b in zip(held, before.tolist())])]
    impact = impacts(read("tf", "<i4").astype(np.int64), lengths[order][doc], documents, total)
    by = np.argsort(term * len(ids) + doc)
    term, doc, impact = term[by], doc[by], impact[by]
    sizes = np.bincount(term, minlength=len(number))
    roots, left, right = _treaps(impact, doc, sizes)
    values = [ids[order].astype("<i8").tobytes(), list(number), sizes.astype("<i4").tobytes(), roots.tobytes(), doc.astype("<i4").tobytes(), impact.astype("<i4").tobytes(), left.tobytes(), right.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.binary()) if c == "terms" else pa.binary()) for c, v in zip(_INDEX_NAMES, values)], _INDEX_NAMES)


def index(packed: DataFrame, documents: int, total: int) -> DataFrame:
    """Rows of treaps; a task joins its shards up to DOCS documents or POSTINGS postings."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        docs = postings = 0
        for batch in batches:
            for row in batch.to_pylist():
                more, n = len(row["ids"]) // 8, len(row["docs"]) // 4
                if not n:
                    continue
                if held and (docs + more > DOCS or postings + n > POSTINGS):
                    yield _merged(held, documents, total)
                    held, docs, postings = [], 0, 0
                held.append(row)
                docs, postings = docs + more, postings + n
        if held:
            yield _merged(held, documents, total)

    return packed.mapInArrow(run, _INDEX)


class Best:
    """The k best (score, then lesser id) of a query."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may(self, upper: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether documents of score `upper` at most and id `least` at least may enter."""
        if len(self.ids) < self.k:
            return upper > 0
        return (upper > self.scores[-1]) | ((upper == self.scores[-1]) & (upper > 0) & (least < self.ids[-1]))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        some = self.may(scores, ids)
        if some.any():
            ids, scores = np.concatenate([self.ids, ids[some]]), np.concatenate([self.scores, scores[some]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[order], scores[order]


class Treaps:
    """A row of the index."""

    def __init__(self, row: dict):
        read = lambda c, kind="<i4": np.frombuffer(row[c], kind)
        end = lambda x, v: np.append(x, np.int64(v)).astype(np.int64)
        self.ids, sizes = read("ids", "<i8"), read("sizes")
        self.number = {t: i for i, t in enumerate(row["terms"])}
        self.roots, self.none = read("roots"), len(row["docs"]) // 4
        self.doc, self.impact = end(read("docs"), 0), end(read("impacts"), 0)
        self.left, self.right = end(read("lefts"), self.none), end(read("rights"), self.none)
        #: Postings are in order of term and document.
        self.place = np.repeat(np.arange(len(sizes)), sizes) * len(self.ids) + self.doc[:-1]

    def search(self, asked: list[tuple[bytes, int]], best: Best, batch: int = BATCH) -> int:
        """Offer the documents to a query of terms and weights. Returns how many were scored."""
        own = [(self.number[t], w) for t, w in asked if t in self.number]
        if not own:
            return 0
        term, weight = (np.array(x, np.int64) for x in zip(*own))
        node = self.roots[term].astype(np.int64)[None, :]
        low, high = np.zeros(1, np.int64), np.full(1, len(self.ids))
        upper, scored = self.impact[node] @ weight, 0
        while True:
            live = np.flatnonzero(best.may(upper, self.ids[low]))
            if not len(live):
                return scored
            if len(live) < len(upper):
                node, low, high, upper = node[live], low[live], high[live], upper[live]
            if len(upper) > batch:
                order = np.argpartition(-upper, batch)
                now, later = order[:batch], order[batch:]
            else:
                now, later = np.arange(len(upper)), np.zeros(0, np.int64)
            here, a, b = node[now], low[now], high[now]
            pivot = self.doc[here[np.arange(len(now)), (self.impact[here] * weight).argmax(1)]]
            at = term[None, :] * len(self.ids) + pivot[:, None]
            found = np.searchsorted(self.place, at)
            hit = self.place[np.minimum(found, self.none - 1)] == at
            best.add(self.ids[pivot], np.where(hit, self.impact[found], 0) @ weight)
            scored += len(now)
            low2, high2 = np.concatenate([a, pivot + 1]), np.concatenate([pivot, b])
            some = low2 < high2
            child = self._inside(np.concatenate([here, here])[some], low2[some], high2[some])
            most = self.impact[child] @ weight
            node, low, high = np.concatenate([node[later], child]), np.concatenate([low[later], low2[some]]), np.concatenate([high[later], high2[some]])
            upper = np.concatenate([upper[later], most])

    def _inside(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest nodes below the given ones whose documents are from low to high."""
        p = node.reshape(-1).copy()
        low, high = np.repeat(low, node.shape[1]), np.repeat(high, node.shape[1])
        live = np.flatnonzero(p != self.none)
        while len(live):
            q = p[live]
            d = self.doc[q]
            under, over = d < low[live], d >= high[live]
            off = under | over
            live, q, under = live[off], q[off], under[off]
            q = np.where(under, self.right[q], self.left[q])
            p[live] = q
            live = live[q != self.none]
        return p.reshape(node.shape)


def asked_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, term, times: the terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t, n) for k, text in _texts(batch, 1) for t, n in Counter(terms(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item", "term", "times"])

    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter("item is not null")
    return rows.groupBy("item").agg(F.min("text").cast("binary").alias("text")).filter("text is not null").mapInArrow(run, "item long, term binary, times long")


def _blocks(weighted: DataFrame, items: int) -> DataFrame:
    """block, asked (item, terms with weights): about BLOCK queries a row."""
    each = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))  # the terms of one item
    block = F.pmod(F.xxhash64("item"), F.lit(items // BLOCK + 1)).alias("block")
    return each.groupBy(block).agg(F.collect_list(F.struct("item", "terms")).alias("asked"))


_FOUND = "item long, doc long, score long"


def _searcher(k: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in _INDEX_NAMES}
                treaps = Treaps(row)
                for query in batch.column("asked")[i].as_py():
                    own = best.setdefault(query["item"], Best(k))
                    treaps.search([(t["term"], t["weight"]) for t in query["terms"]], own)
        for at, own in best.items():
            columns = [np.full(len(own.ids), at), own.ids, own.scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", wanted: int = WANTED) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each item."""
    scratch = Scratch(docs.sparkSession)
    asked = scratch.write(asked_terms(items, item_key, item_text))
    some = asked.select("term").distinct().limit(wanted + 1).collect()
    only = frozenset(bytes(r["term"]) for r in some) if len(some) <= wanted else None
    packed = scratch.write(shards(docs, doc_key, doc_text, only), rows=500)
    documents, total = packed.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if not total:
        return asked.select(F.col("item").alias("item_id"), F.lit(1).alias("rank"), F.col("item").alias("doc_id"), F.col("times").alias("score")).limit(0)
    built = scratch.write(index(packed, documents, total), rows=8)

    lists = packed.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("df"))
    df = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df, "term").select("item", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0")
    blocks = scratch.write(_blocks(weighted, asked.select("item").distinct().count()))

    # few rows on either side; Spark sends the smaller side to all tasks if its size allows
    found = scratch.write(built.crossJoin(blocks.select("asked")).mapInArrow(_searcher(k), _FOUND), rows=4)
    scratch.drop(packed)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
b AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
x AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
