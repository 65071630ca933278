"""Operator 9: quality classifier by nearest-neighbour voting in latent-semantic space.

A document becomes a vector of term weights: hashed words, word shapes (case, digits and punctuation of a
word, runs made one), pairs of neighbouring shapes and repetitions. Term frequencies are damped by a square
root and weighted by inverse document frequency in the labelled sample; a truncated singular value
decomposition of the sample gives the latent space. The sample's vectors are broadcast. Each document's
cosine with all of them is computed exactly, in blocks; its nearest neighbours vote by similarity, weighted
so that each label counts as often as in all labels.

SAMPLE bounds the labelled rows that are learned from: at most SAMPLE / 2 for each label, those of least hash
of the id. So what is broadcast (SAMPLE x RANK numbers and TERMS x RANK for the projection) is the same for
every corpus. Label counts are of all labels.

Null and empty texts have no terms; they get the share of label 1. Labels other than 0 and 1 are not used; of
several labels of one id the least counts. Without any label of one kind the score is that of the other, and
1/2 without labels. Repeated rows score alike; of neighbours equally near at the last place any may vote. Texts of
any length are read whole; columns other than key and text are not. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed

SAMPLE = 4096
RANK = 48
NEIGHBOURS = 15
#: Terms by kind: hashed words, hashed shapes, hashed pairs of shapes, and counts of repetitions.
WORDS, SHAPES, PAIRS = 4096, 1024, 2048
TERMS = WORDS + SHAPES + PAIRS + 2
#: Weight of each kind relative to the others: shapes tell prose from junk, words are many.
KIND_WEIGHT = (0.5, 1.0, 1.0, 1.0)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a" if m[0].islower() else "Aa"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"([^\w\s])\1+"), lambda m: m[1] * 2))


def shape(word: str) -> str:
    """A word with letters, digits and repeated punctuation reduced to their kind."""
    for pattern, kind in _RUNS:
        word = pattern.sub(kind, word)
    return word[:12]


class Terms:
    """Term frequencies of texts; keeps hashes of words met, in bounded number."""

    def __init__(self, most: int = 400_000):
        self.known: dict[str, int] = {}
        self.most = most

    def _number(self, word: str) -> int:
        h = zlib.crc32(word.lower().encode()) % WORDS
        return h << 10 | zlib.crc32(shape(word).encode()) % SHAPES

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, ascending, and their damped frequencies."""
        words = _WORD.findall(text) if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self._number(w)
        n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        word, form = n >> 10, n & (SHAPES - 1)
        same = n[1:] == n[:-1]
        pair = (form[:-1] * 31 + form[1:]) % PAIRS
        terms = np.concatenate([word, WORDS + form, WORDS + SHAPES + pair, [TERMS - 2, TERMS - 1]])
        weight = np.ones(len(terms))
        weight[-2], weight[-1] = same.sum(), np.log1p(len(words))
        total = np.bincount(terms, weight, TERMS)
        at = np.nonzero(total)[0]
        share = np.where(at < TERMS - 1, total[at] / len(words), 0.01 * total[at])
        return at, np.sqrt(share).astype(np.float32)


def held_out(key: Column) -> Column:
    """Rows kept from learning: those whose id, as text, has a CRC-32 divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """The latent space, the labelled vectors in it, and how they vote."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], counts: dict[int, int], rank: int = RANK, neighbours: int = NEIGHBOURS, seed: int = 7):
        total = sum(counts.values())
        self.prior = counts.get(1, 0) / total if total else 0.5
        self.neighbours = min(neighbours, max(1, len(rows)))
        labels = np.array([y for _, _, y in rows], np.int64)
        self.labels = labels.astype(np.float32)
        drawn = np.bincount(labels, minlength=2)
        self.votes = np.array([counts.get(int(y), 0) / drawn[y] for y in labels], np.float32)
        self.votes /= max(1e-9, self.votes.max(initial=0))
        df = np.zeros(TERMS, np.int64)
        for at, value, _ in rows:
            df[at] += value > 0
        kinds = np.repeat(KIND_WEIGHT, [WORDS, SHAPES, PAIRS, 2])
        self.weights = (kinds * (np.log((1 + len(rows)) / (1 + df)) + 1)).astype(np.float32)
        sample = _Sample([(at, value * self.weights[at]) for at, value, _ in rows])
        self.projection = _right_vectors(sample, min(rank, max(1, len(rows))), seed)
        self.vectors = _unit(sample.times(self.projection))

    def embed(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.projection.shape[1]), np.float32)
        for i, (at, value) in enumerate(rows):
            out[i] = (value * self.weights[at]) @ self.projection[at]
        return _unit(out)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> np.ndarray:
        """Share of label 1 among the neighbours' votes, in [0, 1]."""
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(rows), block):
            part = rows[at : at + block]
            cosine = self.embed(part) @ self.vectors.T
            k = self.neighbours
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 8 * self.votes[near]
            small = 0.02
            value = ((w * self.labels[near]).sum(1) + small * self.prior) / (w.sum(1) + small)
            full = np.array([len(r[0]) > 0 for r in part])
            out[at : at + block] = np.where(full, value, self.prior)
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)


class _Sample:
    """Rows of length 1 by their terms; the driver holds a block of them at a time as a matrix."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = [(at, value / max(1e-9, np.linalg.norm(value))) for at, value in rows]

    def blocks(self, size: int = 256) -> Iterator[np.ndarray]:
        for first in range(0, len(self.rows), size):
            part = self.rows[first : first + size]
            x = np.zeros((len(part), TERMS), np.float32)
            for i, (at, value) in enumerate(part):
                x[i, at] = value
            yield x

    def times(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((0, q.shape[1]), np.float32), *(x @ q for x in self.blocks())])

    def squared_times(self, q: np.ndarray) -> np.ndarray:
        total = np.zeros(q.shape)
        for x in self.blocks():
            total += x.T @ (x @ q)
        return total


def _right_vectors(sample: _Sample, rank: int, seed: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration."""
    q = np.random.default_rng(seed).standard_normal((TERMS, rank + 8)).astype(np.float32)
    for _ in range(6):
        q = np.linalg.qr(sample.squared_times(q))[0].astype(np.float32)
    _, _, v = np.linalg.svd(sample.times(q), full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` labelled rows that are not held out."""
    known = labels.filter(F.col(key).isNotNull() & ~held_out(F.col(key)) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    known = known.join(docs.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("key"), F.col("key")]
    chosen = [known.filter(F.col("label") == y).orderBy(*order).limit(sample // 2) for y in (0, 1)]
    drawn = chosen[0].unionByName(chosen[1])

    @trimmed
    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Terms()
        for batch in batches:
            found = [of.counts(t) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"].astype(str), "label": batch["label"], "terms": [a.astype(np.int16).tobytes() for a, _ in found], "value": [v.tobytes() for _, v in found]})

    # the sample's size is bounded, so it is broadcast to the texts
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key")
    # packed, as lists of numbers would take the driver many times as much
    rows = texts.mapInPandas(terms, "key string, label int, terms binary, value binary").collect()
    best: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
    for r in rows:
        new, old = (np.frombuffer(r["terms"], np.int16), np.frombuffer(r["value"], np.float32), r["label"]), best.get(r["key"])
        if old is None or [x.tolist() for x in new[:2]] < [x.tolist() for x in old[:2]]:
            best[r["key"]] = new
    return Model([best[k] for k in sorted(best)], counts)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row of docs, from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Terms()
        for batch in batches:
            texts = list(batch["text"])
            yield pd.DataFrame({"key": batch["key"].to_numpy(dtype=object), "score": np.concatenate([np.zeros(0), *(shared.value.score([of.counts(t) for t in texts[at : at + 256]]) for at in range(0, len(texts), 256))])})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float | None = None) -> DataFrame:
    """docs without the rows that score below `threshold` (THRESHOLD)."""
    shared, least = docs.sparkSession.sparkContext.broadcast(model), THRESHOLD if threshold is None else threshold
    names = docs.columns

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = shared.value.score([of.counts(t) for t in part.column(names.index(text)).to_pylist()]) >= least
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


THRESHOLD = 0.3


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
