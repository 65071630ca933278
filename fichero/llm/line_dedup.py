"""Operator 5: near-duplicate lines by an exact set-similarity join.

A line's set holds its distinct words, lower-cased (ASCII). Lines of at least `least` distinct words take part
(the query and drop_repeated_lines take every line with a word, ANY); those of equal sets form a class, at the
place (doc_id, line number) of the first. A line is removed if an earlier line, by place, has a Jaccard
similarity of at least THRESHOLD. So all but the first line of a class go, and that one goes too if an earlier
class matches.

The join: tokens of each class in order of rarity; two sets that reach the threshold share a token among the
first n - ceil(threshold * n) + 1 of each (prefix filter), so only postings of prefixes are compared. A pair
passes if the lengths allow the threshold (length filter: lists are in order of length, and a comparison ends
where the lengths do not fit), if the tokens from the shared one on do (positional filter: at the first token
that a matching pair shares, they do), and if bitmaps of the sets do not differ in more bits than it allows.
Lists are compared inside tasks, without making pairs rows: each posting leaves its list with its likeliest
earlier partner and whether others passed. The likeliest of all lists is verified on the words. A class whose
likeliest partner fails while others passed is held against all of these, again inside tasks, by lists that
carry the lines themselves, until one matches: at most one row per class and list comes out. (The likeliest
NAMED ones of each list are tried before that.)

Rarity is counted over all lines, in SLOTS hashed slots (the order of tokens does not change the result);
that table of fixed size goes to every task. A token that its slot counts once has no list. Tokens that their
slots count at most LIST times travel in packed buckets, whose number grows with the postings; the others are
counted, and lists longer than LIST are cut into blocks that are compared in pairs.

Rows without id take no part. Rows that repeat an id and a text are one document; rows that repeat an id with
another text are judged one by one (of lines at the same place, that of lesser digest counts as earlier). Null
and empty texts have no lines; an empty table gives an empty result; very long lines have as many tokens as
words. Ties go to the lesser place. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, marked_slots, table, trimmed
from .hashing import word_hashes

THRESHOLD = 0.8
MIN_TOKENS = 5
#: Distinct words from which lines take part in the query and in drop_repeated_lines: all lines that have a word.
ANY = 1
#: Slots of the rarity table, a byte each: the upper bits of a word's hash.
SLOT_BITS = 24
#: Slots that travel and are added up at once.
BLOCK_BITS = 16
#: Postings of a list that one task compares.
LIST = 20_000
#: Bytes of lines that one task compares when lists carry lines.
LIST_BYTES = 16 << 20
#: Postings that a packed bucket holds about, and that a task packs at once.
BUCKET, PACK = 400_000, 300_000
#: Bits of the table that names wanted lines ahead of a join.
WANTED_BITS = 27
#: Bytes of text whose words are hashed at once (more where one text is longer), and lines sorted at once.
BYTES, LINES = 1 << 20, 1 << 14
#: Words of the bitmap of a set.
BITS = ["b0", "b1"]
#: A place is doc_id and `at`: line number and, to tell rows of one id apart, so many bits of the digest.
DIGEST_BITS = 24


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a column as UTF-8, null as empty, in runs of about BYTES; and the number of each run's first."""
    run: list[bytes] = []
    size = first = 0
    for i, t in enumerate(column.cast(pa.binary()).to_pylist()):
        run.append(t or b"")
        size += len(run[-1])
        if size >= BYTES:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def _level(total: np.ndarray) -> np.ndarray:
    """Level of frequency, 0: once at most, then a factor of 2^(1/4) each."""
    return np.where(total > 1, np.minimum(255, 1 + 4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)


def rarity(docs: DataFrame, text: str = "text") -> dict[int, bytes]:
    """Level of frequency of every slot of words, over all texts, as packed_levels gives it."""
    return packed_levels(docs, text, lambda texts: word_hashes(b"\n".join(texts))[0], SLOT_BITS)


def unpacked_levels(packed: dict[int, bytes], bits: int) -> np.ndarray:
    size = 1 << BLOCK_BITS
    out = np.zeros((1 << (bits - BLOCK_BITS), size), np.uint8)
    for block, level in packed.items():
        out[block] = np.frombuffer(pa.decompress(level, size, codec="zstd", asbytes=True), np.uint8)
    return out.reshape(-1)


def packed_levels(docs: DataFrame, text: str, hashes: Callable[[list[bytes]], np.ndarray], bits: int) -> dict[int, bytes]:
    """Level of frequency of every slot (2^bits) of hashes of texts, over all texts: by block, compressed; blocks of zeros are left out."""
    blocks, size = 1 << (bits - BLOCK_BITS), 1 << BLOCK_BITS

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks * size, np.uint8)
        over: dict[int, int] = {}  # what has left a full byte of the table
        for batch in batches:
            for _, texts in _pieces(batch.column(0)):
                slot = (hashes(texts) >> np.uint64(64 - bits)).astype(np.uint32)
                slot.sort()  # words repeat, so few slots of the table are touched
                first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])[: len(slot)])
                n = np.diff(np.append(first, len(slot))) + total[slot[first]]
                full = n > 255
                for s, x in zip(slot[first[full]].tolist(), n[full].tolist()):
                    over[s] = over.get(s, 0) + x
                total[slot[first]] = np.where(full, 0, n)
        total = total.reshape(blocks, size)
        often: dict[int, list[int]] = {}
        for s in over:
            often.setdefault(s >> BLOCK_BITS, []).append(s)
        some = sorted({*np.flatnonzero(total.any(1)).tolist(), *often})
        for b in some:
            own = np.array(sorted(often.get(b, [])), np.int64)
            columns = [
                pa.array([b], pa.int32()),
                pa.array([pa.compress(total[b].tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                pa.array([(own % size).astype("<i4").tobytes()], pa.binary()),
                pa.array([np.array([over[s] for s in own.tolist()], "<i8").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "counts", "often", "often_n"])

    @trimmed
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts, often, often_n in zip(*(c.to_pylist() for c in batch.columns)):
                one = np.frombuffer(pa.decompress(counts, size, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
                one[np.frombuffer(often, "<i4")] += np.frombuffer(often_n, "<i8")
                sums[block] = sums[block] + one if block in sums else one
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pa.compress(_level(s).tobytes(), codec="zstd", asbytes=True) for s in sums.values()], pa.binary())], ["block", "level"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "block int, counts binary, often binary, often_n binary")
    return {r["block"]: bytes(r["level"]) for r in counted.repartition("block").mapInArrow(add, "block int, level binary").collect()}  # 2^bits bytes at most, before compression


class _Lines:
    """Lines of texts and the sorted sets of those that take part, up to LINES at once."""

    def __init__(self, texts: list[bytes], level: np.ndarray, least: int):
        joined = b"\n".join(texts)
        h, start = word_hashes(joined)
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        line = np.searchsorted(breaks, start)
        size = np.bincount(line, minlength=len(breaks) + 1)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]  # of each text
        begins = np.concatenate([[0], breaks + 1])  # of each line
        owner = np.searchsorted(first, begins, "right") - 1
        number = np.arange(len(begins)) - np.searchsorted(begins, first)[owner]
        take = np.flatnonzero(size >= least)
        self.level, self.least = level, least
        self.h = h[(size >= least)[line]]
        self.size, self.owner, self.number = size[take], owner[take], number[take]

    def sets(self) -> Iterator[tuple]:
        """(text number, place within the text, digests of 2 x 64 bits, tokens, their levels, first of each line, sizes)."""
        ends = np.concatenate([[0], np.cumsum(self.size)])
        for a in range(0, len(self.size), LINES):
            b = min(a + LINES, len(self.size))
            yield self._sorted(self.h[ends[a] : ends[b]], a, b)

    def _sorted(self, h: np.ndarray, a: int, b: int) -> tuple:
        line = np.repeat(np.arange(b - a, dtype=np.uint64), self.size[a:b])
        level = self.level[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        key = line << np.uint64(50) | level.astype(np.uint64) << np.uint64(42) | (h & np.uint64((1 << 42) - 1))
        order = np.argsort(key)
        key, h = key[order], h[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        key, h, level = key[first], h[first], level[order][first]
        n = np.bincount((key >> np.uint64(50)).astype(np.int64), minlength=b - a)
        ends = np.concatenate([[0], np.cumsum(n)])
        digest = _digests(h, ends[:-1])
        return self.owner[a:b], _at(self.number[a:b], digest[0]), digest, h, level, ends[:-1], n


def _digests(h: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Two digests of 64 bits of each set, of which h holds the distinct hashes from start on: sums, whatever the order."""
    if not len(start):
        return [np.zeros(0, np.int64)] * 2
    other = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return [np.add.reduceat(x, start).view(np.int64) for x in (h, other ^ (other >> np.uint64(28)))]


def _at(number: np.ndarray, d0: np.ndarray) -> np.ndarray:
    """Line number and the upper bits of the first digest."""
    return number.astype(np.int64) << DIGEST_BITS | (d0.view(np.uint64) >> np.uint64(64 - DIGEST_BITS)).astype(np.int64)


def _line_digests(lines: list[bytes]) -> list[np.ndarray]:
    """Digests of the sets of lines (0 of lines without a word)."""
    joined = b"\n".join(lines)
    h, start = word_hashes(joined)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), start)
    order = np.lexsort((h, line))
    h, line = h[order], line[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[first], line[first]
    some, begin = np.unique(line, return_index=True)
    out = [np.zeros(len(lines), np.int64) for _ in range(2)]
    for o, d in zip(out, _digests(h, begin)):
        o[some] = d
    return out


_LINE = "doc_id long, at long, n int, d0 long, d1 long, b0 long, b1 long, skip int, n_rare int, n_hot int, prefix binary"


def line_sets(docs: DataFrame, packed: dict[int, bytes], key: str = "doc_id", text: str = "text", least: int = MIN_TOKENS, threshold: float = THRESHOLD, most: int = LIST) -> DataFrame:
    """One row per line that takes part: its place, size, digest and bitmap of its set, and the tokens of its prefix that may have lists.

    packed: what `rarity` gives; tasks unpack it. Tokens are in order of rarity: after `skip` ones that occur once, n_rare and n_hot (which may be in more than `most` lines).
    """
    hot = _level(np.array([most]))[0]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = unpacked_levels(packed, SLOT_BITS)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in _pieces(batch.column(1)):
                for owner, at, digest, h, levels, start, n in _Lines(texts, level, least).sets():
                    keep = n >= least
                    # a set of n matches none but its equals if n of n + 1 is too little: up to three words, the digest alone decides
                    prefix = np.where(keep & (n >= threshold * (n + 1) - 1e-9), n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
                    i = np.arange(len(h)) - np.repeat(start, n)
                    inside = i < np.repeat(prefix, n)
                    used = inside & (levels > 0)
                    often = used & (levels > hot)
                    count = lambda what: np.add.reduceat(what.astype(np.int32), start) if len(start) else np.zeros(0, np.int32)  # noqa: E731, B023
                    n_used, n_hot = count(used), count(often)
                    one, half = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6) & np.uint64(1)).astype(bool)
                    bits = [np.bitwise_or.reduceat(np.where(half == w, one, np.uint64(0)), start).view(np.int64) if len(start) else np.zeros(0, np.int64) for w in (False, True)]
                    offsets = np.concatenate([[0], np.cumsum(8 * n_used[keep])]).astype(np.int32)
                    tokens = pa.Array.from_buffers(pa.binary(), int(keep.sum()), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(h[used].tobytes())])
                    numbers = ((ids[first + owner], pa.int64()), (at, pa.int64()), (n, pa.int32()), (digest[0], pa.int64()), (digest[1], pa.int64()), *((b, pa.int64()) for b in bits), (prefix - n_used, pa.int32()), (n_used - n_hot, pa.int32()), (n_hot, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(v[keep], kind) for v, kind in numbers), tokens], ["doc_id", "at", "n", "d0", "d1", *BITS, "skip", "n_rare", "n_hot", "prefix"])

    return docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, _LINE)


#: Columns of packed postings, in this order: token, place, size, position, bitmap. A column is packed by planes of bytes, as most are zero.
_PACKED = (("token", "<u4"), ("doc_id", "<i8"), ("at", "<i8"), ("n", "<i4"), ("i", "<i4"), ("b0", "<u8"), ("b1", "<u8"))
_PACKED_BYTES = sum(np.dtype(kind).itemsize for _, kind in _PACKED)


def _postings(batch: pa.RecordBatch, hot: bool) -> dict[str, np.ndarray]:
    """Postings of a batch of classes (doc_id, at, n, b0, b1, skip, n_rare, n_hot, prefix): the rare or the hot ones."""
    x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "at", "n", *BITS, "skip", "n_rare", "n_hot")}
    tokens = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), "<u8")
    count = (x["n_rare"] + x["n_hot"]).astype(np.int64)
    ends = np.cumsum(count)
    nth = np.arange(len(tokens)) - np.repeat(ends - count, count)
    rare = nth < np.repeat(x["n_rare"], count)
    use = ~rare if hot else rare
    out = {c: np.repeat(x[c], count)[use] for c in ("doc_id", "at", "n", *BITS)}
    return out | {"token": tokens[use], "i": (nth + np.repeat(x["skip"], count))[use]}


_CLASS = ["doc_id", "at", "n", *BITS, "skip", "n_rare", "n_hot", "prefix"]


def _packed(classes: DataFrame, buckets: int) -> DataFrame:
    """bucket, blob: the rare postings of classes. A token is its bucket (by its lower half) and its upper half."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            x = {c: np.concatenate([h[c] for h in held]) for c, _ in _PACKED}
            held.clear()
            bucket = ((x["token"] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            x["token"] = x["token"] >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | x["token"], kind="stable")
            bucket = bucket[order]
            x = {c: x[c][order].astype(kind) for c, kind in _PACKED}
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            blobs = [b"".join(x[c][a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for c, _ in _PACKED) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        size = 0
        for batch in batches:
            step = max(1, PACK // 32)
            for a in range(0, batch.num_rows, step):
                held.append(_postings(batch.slice(a, step), hot=False))
                size += len(held[-1]["token"])
                if size >= PACK:
                    yield packed()
                    size = 0
        if size:
            yield packed()

    return classes.filter("n_rare > 0").select(*_CLASS).mapInArrow(run, "bucket int, blob binary")


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {c: [] for c, _ in _PACKED}
    for blob in blobs:
        n, a = len(blob) // _PACKED_BYTES, 0
        for c, kind in _PACKED:
            b = a + n * np.dtype(kind).itemsize
            out[c].append(np.ascontiguousarray(np.frombuffer(blob[a:b], np.uint8).reshape(-1, n).T).view(kind).reshape(-1))
            a = b
    return {c: np.concatenate(v) for c, v in out.items()}


class _Near:
    """Postings in order of token and size, and the pairs of a list that pass the filters."""

    def __init__(self, x: dict[str, np.ndarray], threshold: float, new: np.ndarray):
        """new: where a list begins. Postings of one block (but 0) are not compared with each other."""
        self.x, self.threshold = x, threshold
        start = np.flatnonzero(new)
        self.rank = np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))
        order = np.lexsort((x["at"], x["doc_id"]))
        doc, at = x["doc_id"][order], x["at"][order]
        other = np.ones(len(order), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        #: Number of each posting's place, in order; and a posting of each place.
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(other) - 1
        self.sample = order[other]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(later, earlier, differing bits) by place; in a turn, no posting is twice the later or twice the earlier one."""
        x, n = self.x, self.x["n"].astype(np.int64)
        bits, block, rest = [x[b].view(np.uint64) for b in BITS], x.get("block"), n - x["i"]
        live, gap = np.flatnonzero(self.rank >= 1), 1
        while len(live):
            other = live - gap
            fits = n[other] >= self.threshold * n[live] - 1e-9
            live, other = live[fits], other[fits]
            both = n[live] + n[other]
            need = np.ceil(self.threshold / (1 + self.threshold) * both - 1e-9).astype(np.int64)
            ok = np.flatnonzero(np.minimum(rest[live], rest[other]) >= need)
            if len(ok):
                a, b = live[ok], other[ok]
                differ = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in bits)
                ok = (differ <= both[ok] - 2 * need[ok]) & (self.place[a] != self.place[b])
                if block is not None:
                    ok &= (block[a] == 0) | (block[a] != block[b])
                a, b, differ = a[ok], b[ok], differ[ok]
                late = self.place[a] > self.place[b]
                for one, two, which in ((a, b, late), (b, a, ~late)):
                    if which.any():
                        yield one[which], two[which], differ[which]
            gap += 1
            live = live[self.rank[live] >= gap]


_PARTNER = "list long, doc_id long, at long, n int, i int, b0 long, b1 long, to_doc long, to_at long, differ int, more boolean"


def _partners(x: dict[str, np.ndarray], new: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Postings that passed with another: likeliest earlier partner (null: none) and whether others passed too."""
    near = _Near(x, threshold, new)
    best = np.full(len(new), np.iinfo(np.int64).max)
    count = np.zeros(len(new), np.int64)
    part = np.zeros(len(new), bool)
    for later, earlier, differ in near.pairs():
        best[later] = np.minimum(best[later], differ << 40 | near.place[earlier])
        count[later] += 1
        part[later] = part[earlier] = True
    at = np.flatnonzero(part)
    found = count[at] > 0
    to = near.sample[np.where(found, best[at] & ((1 << 40) - 1), 0)] if len(at) else at
    numbers = ((x["list"][at], pa.int64()), (x["doc_id"][at], pa.int64()), (x["at"][at], pa.int64()), (x["n"][at], pa.int32()), (x["i"][at], pa.int32()), *((x[b][at].view(np.int64), pa.int64()) for b in BITS))
    partner = ((x["doc_id"][to], pa.int64()), (x["at"][to], pa.int64()), (np.where(found, best[at] >> 40, 0), pa.int32()), (count[at] > 1, pa.bool_()))
    columns = [pa.array(v, kind) for v, kind in numbers] + [pa.array(v, kind, mask=~found) for v, kind in partner]
    return pa.RecordBatch.from_arrays(columns, ["list", "doc_id", "at", "n", "i", *BITS, "to_doc", "to_at", "differ", "more"])


def _scan_packed(packed: DataFrame, threshold: float, partitions: int) -> DataFrame:
    """Partners (_PARTNER) in lists of packed postings; list: bucket and token."""

    def compared(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        x = _unpacked(blobs)
        order = np.lexsort((x["at"], x["doc_id"], x["n"], x["token"]))
        x = {c: v[order] for c, v in x.items()}
        new = np.ones(len(order), bool)
        new[1:] = x["token"][1:] != x["token"][:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        several = np.repeat(size > 1, size)
        x = {c: v[several] for c, v in x.items()} | {"list": np.int64(bucket) << 32 | x["token"][several].astype(np.int64)}
        return _partners(x, new[several], threshold)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blobs = -1, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != last and blobs:
                    yield compared(last, blobs)
                    blobs = []
                last = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield compared(last, blobs)

    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _PARTNER)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of whole groups, in order of keys, of many groups at once."""
    rest: dict[str, np.ndarray] = {}
    for batch in batches:
        x = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
        x = {c: np.concatenate([rest[c], v]) for c, v in x.items()} if rest else x
        other = np.zeros(len(x[names[0]]), bool)
        for c in keys:
            other |= x[c] != x[c][-1:]
        end = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if end:
            yield {c: v[:end] for c, v in x.items()}
        rest = {c: v[end:] for c, v in x.items()}
    if rest and len(rest[names[0]]):
        yield rest


def _begins(x: dict[str, np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(len(x[keys[0]]), bool)
    new[:1] = True
    for c in keys:
        new[1:] |= x[c][1:] != x[c][:-1]
    return new


def _cut(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows with columns part and block: lists that `blocks` (an aggregate) gives more than one block are compared in pairs of blocks.

    Each posting goes to the pairs of its own block with every block; in a pair of two blocks only postings of
    different ones are compared.
    """
    sizes = rows.groupBy("list").agg(blocks.cast("int").alias("blocks")).filter("blocks > 1")
    own = (F.pmod(F.xxhash64("doc_id", "at"), F.coalesce("blocks", F.lit(1))) + 1).cast("int")
    cut = rows.join(sizes, "list", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(1), F.coalesce("blocks", F.lit(1)))))
    part = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    return cut.withColumn("part", part).withColumn("block", F.when(F.col("own") == F.col("other"), 0).otherwise(F.col("own"))).drop("own", "other", "blocks")


def _hot_partners(classes: DataFrame, threshold: float, most: int, scratch: Scratch) -> DataFrame | None:
    """Partners (_PARTNER) in lists of tokens that may be long."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _postings(batch, hot=True)
            columns = [pa.array(v.astype(np.uint64).view(np.int64) if kind == pa.int64() and v.dtype.kind == "u" else v, kind) for v, kind in ((x["token"], pa.int64()), (x["doc_id"], pa.int64()), (x["at"], pa.int64()), (x["n"], pa.int32()), (x["i"], pa.int32()), *((x[b], pa.int64()) for b in BITS))]
            yield pa.RecordBatch.from_arrays(columns, ["list", "doc_id", "at", "n", "i", *BITS])

    # the sign tells these lists from packed ones
    rows = classes.filter("n_hot > 0").select(*_CLASS).mapInArrow(run, "list long, doc_id long, at long, n int, i int, b0 long, b1 long")
    rows = scratch.write(rows.withColumn("list", F.col("list").bitwiseOR(F.lit(-1 << 63))))
    names, keys = ["list", "part", "block", "doc_id", "at", "n", "i", *BITS], ("list", "part")

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches, names, keys):
            yield _partners(x, _begins(x, keys), threshold)

    cut = _cut(rows, F.ceil(2 * F.count(F.lit(1)) / most - 1))
    return cut.select(*names).repartition(*keys).sortWithinPartitions(*keys, "n", "doc_id", "at").mapInArrow(scan, _PARTNER)


def _slots(doc, number, mod=np.mod):
    """Slot of a line in the table of wanted lines."""
    return mod(mod(doc, 1 << WANTED_BITS) * 40503 + number * 26544357, 1 << WANTED_BITS)


def _texts(docs: DataFrame, places: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, at, d0, d1, line: the lines at places (doc_id, at), and some others. Which to take is told by a table of 2^WANTED_BITS bits."""
    slot = _slots(F.col("doc_id"), F.shiftright("at", DIGEST_BITS), lambda a, b: F.pmod(a, F.lit(b)))
    wanted = marked_slots(places.select(slot.alias("slot")), WANTED_BITS)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in _pieces(batch.column(1)):
                count = np.array([t.count(b"\n") + 1 for t in texts])
                owner = np.repeat(np.arange(len(texts)), count)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                slots = _slots(ids[first + owner].astype(np.int64), number)
                take = np.flatnonzero(wanted.table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1)
                lines: list[bytes] = []
                ends = np.searchsorted(owner[take], np.arange(len(texts) + 1)).tolist()
                for text, a, b in zip(texts, ends, ends[1:]):
                    if b > a:
                        split = text.split(b"\n")
                        lines += [split[k] for k in number[take[a:b]].tolist()]
                if lines:
                    d0, d1 = _line_digests(lines)
                    columns = [*(pa.array(v, pa.int64()) for v in (ids[first + owner[take]], _at(number[take], d0), d0, d1)), pa.array(lines, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "d0", "d1", "line"])

    return docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, at long, d0 long, d1 long, line binary")


def _words(line: bytes) -> frozenset:
    return frozenset(line.lower().split())


def _similar(a: frozenset, b: frozenset, threshold: float) -> bool:
    common = len(a & b)
    return common >= threshold * (len(a) + len(b) - common) - 1e-9


_MATCH = "doc_id long, at long, d0 long, d1 long, to_doc long, to_at long"
_MATCHED = [c.split()[0] for c in _MATCH.split(", ")]


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (doc_id, at, to_doc, to_at), those whose words reach the threshold, with the digests of the first (_MATCH)."""
    names = ["doc_id", "at", "to_doc", "to_at"]
    pair = F.struct(*names).alias("pair")
    ends = pairs.select("doc_id", "at", pair, F.lit(True).alias("own")).unionByName(pairs.select(F.col("to_doc").alias("doc_id"), F.col("to_at").alias("at"), pair, F.lit(False).alias("own")))
    side = lambda own, *c: F.max(F.when(F.col("own") if own else ~F.col("own"), F.struct(*c)))
    both = ends.join(texts, ["doc_id", "at"]).groupBy("pair").agg(side(True, "d0", "d1", "line").alias("x"), side(False, "line").alias("y"))

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [_similar(_words(a), _words(b), threshold) for a, b in zip(batch["line"], batch["to_line"])]
            yield batch.loc[np.array(good, bool), _MATCHED]

    return both.select("pair.*", "x.*", F.col("y.line").alias("to_line")).mapInPandas(run, _MATCH)


_POSTING = ["list", "doc_id", "at", "n", "i", *BITS, "open"]
#: Candidates of a list that an open posting names; those of postings with more are compared inside tasks.
NAMED = 8


def _open_postings(rows: DataFrame, open_: DataFrame, threshold: float, most: int) -> DataFrame:
    """Of rows (_PARTNER) those that passed with another of which the later is of an open class; a row may come twice.

    `near` has the likeliest earlier ones, NAMED at most, of a row of an open class, and `more` tells whether others passed.
    """
    lists = rows.filter("to_doc is not null").join(open_, ["doc_id", "at"], "left_semi").select("list").distinct()
    rows = rows.select(*_POSTING[:-1]).join(lists, "list", "left_semi")
    rows = rows.filter("list >= 0").unionByName(rows.filter("list < 0").dropDuplicates(["list", "doc_id", "at"]))  # cut lists name a posting for each part
    rows = rows.join(open_.select("doc_id", "at", F.lit(True).alias("open")), ["doc_id", "at"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    names, keys = [*_POSTING, "part", "block"], ("list", "part")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches, names, keys):
            near, part, probe = _Near(x, threshold, _begins(x, keys)), np.zeros(len(x["list"]), bool), x["open"].astype(bool)
            count, none = np.zeros(len(part), np.int64), np.iinfo(np.int64).max
            best = np.full((len(part), NAMED), none)
            for later, earlier, differ in near.pairs():
                later, earlier, differ = later[probe[later]], earlier[probe[later]], differ[probe[later]]
                part[later] = part[earlier] = True
                count[later] += 1
                score = differ << 40 | near.place[earlier]
                for k in range(NAMED):
                    best[later, k], score = np.minimum(best[later, k], score), np.maximum(best[later, k], score)
            at = np.flatnonzero(part)
            columns = [pa.array(x[c][at], kind) for c, kind in zip(_POSTING, (*[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * 2, pa.bool_()))]
            to = [near.sample[b[b < none] & ((1 << 40) - 1)] for b in best[at]]
            columns.append(pa.array([[{"to_doc": int(x["doc_id"][t]), "to_at": int(x["at"][t])} for t in one] for one in to], pa.list_(pa.struct([("to_doc", pa.int64()), ("to_at", pa.int64())]))))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count[at] > NAMED, pa.bool_())], [*_POSTING, "near", "more"])

    cut = _cut(rows, F.ceil(2 * F.count(F.lit(1)) / most - 1))
    found = cut.select(*names).repartition(*keys).sortWithinPartitions(*keys, "n", "doc_id", "at")
    return found.mapInArrow(run, "list long, doc_id long, at long, n int, i int, b0 long, b1 long, open boolean, near array<struct<to_doc:long,to_at:long>>, more boolean")


def _open_matches(rows: DataFrame, open_: DataFrame, texts: DataFrame, threshold: float, most: int) -> DataFrame:
    """For open classes, an earlier one of rows (_open_postings) that matches on the words (_MATCH): at most one for each list."""
    lists = rows.filter("more").join(open_, ["doc_id", "at"], "left_semi").select("list").distinct()
    rows = rows.join(lists, "list", "left_semi").dropDuplicates(["list", "doc_id", "at"]).drop("open", "near", "more")
    rows = rows.join(open_.select("doc_id", "at", F.lit(True).alias("open")), ["doc_id", "at"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    rows = rows.join(texts.dropDuplicates(["doc_id", "at"]), ["doc_id", "at"])
    rows = _cut(rows, F.ceil(2 * F.greatest(F.count(F.lit(1)) / F.lit(most), F.sum(F.length("line")) / F.lit(LIST_BYTES)) - 1))
    names, keys = [*_POSTING, "d0", "d1", "line", "part", "block"], ("list", "part")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches, names, keys):
            near, probe, match = _Near(x, threshold, _begins(x, keys)), x["open"].astype(bool), {}
            words = lru_cache(len(probe))(lambda i, line=x["line"]: _words(line[i]))
            for later, earlier, _ in near.pairs():
                for a, b in zip(later[probe[later]].tolist(), earlier[probe[later]].tolist()):
                    if a not in match and _similar(words(a), words(b), threshold):
                        match[a] = b
            at, to = np.array(list(match), np.int64), np.array(list(match.values()), np.int64)
            columns = [x[c][at] for c in _MATCHED[:4]] + [x[c][to] for c in ("doc_id", "at")]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], _MATCHED)

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, "n", "doc_id", "at").mapInArrow(run, _MATCH)


def _once(matches: DataFrame) -> DataFrame:
    """One match of each class."""
    return matches.groupBy("doc_id", "at").agg(F.min(F.struct(*_MATCHED[2:])).alias("x")).select("doc_id", "at", "x.d0", "x.d1", F.struct("x.to_doc", "x.to_at").alias("x")).select("doc_id", "at", "d0", "d1", "x.*")


def _judged(docs: DataFrame, key: str, text: str, threshold: float, least: int, most: int) -> DataFrame:
    """As judge, with the places as (doc_id, at), (class_doc, class_at) and (match_doc, match_at)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    place = ["doc_id", "at"]
    docs = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    level = rarity(docs, text)
    lines = scratch.write(line_sets(docs, level, key, text, least, threshold, most))
    rest = ["n", *BITS, "skip", "n_rare", "n_hot", "prefix"]
    classes = lines.groupBy("d0", "d1").agg(F.min(F.struct(*place, *rest)).alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(classes.select("d0", "d1", "x.*", "copies"))
    scratch.release()
    rare, hot = classes.agg(F.coalesce(F.sum("n_rare"), F.lit(0)), F.coalesce(F.sum("n_hot"), F.lit(0))).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rare // BUCKET + 1)
    partners = scratch.write(_scan_packed(_packed(classes, 3 * partitions), threshold, partitions), rows=64)
    scratch.release()
    if hot:
        partners = partners.unionByName(scratch.write(_hot_partners(classes, threshold, most, scratch)))
        scratch.release()

    found = partners.filter("to_doc is not null").groupBy(*place)
    to = F.struct("to_doc", "to_at")
    best = found.agg(F.min(F.struct("differ", "to_doc", "to_at")).alias("x"), (F.max("more") | (F.min(to) != F.max(to))).alias("more"))
    best = scratch.write(best.select(*place, "x.to_doc", "x.to_at", "more"))
    texts = scratch.write(_texts(docs, partners.select(*place), key, text))  # both of a pair are among the partners
    matches = scratch.write(_verified(best.drop("more"), texts, threshold))
    scratch.release()
    open_ = scratch.write(best.filter("more").join(matches, place, "left_anti").select(*place))
    again = scratch.write(_open_postings(partners, open_, threshold, most))
    scratch.release()
    named = again.filter("open").select(*place, F.explode("near").alias("x")).select(*place, "x.*").distinct()
    named = named.join(best, [*place, "to_doc", "to_at"], "left_anti")
    more = scratch.write(_once(_verified(named, texts, threshold)))
    left = scratch.write(open_.join(more, place, "left_anti"))
    matches = matches.unionByName(more).unionByName(scratch.write(_once(_open_matches(again, left, texts, threshold, most))))
    for done in (texts, best, open_, again, left):
        scratch.drop(done)
    scratch.release()

    verdict = classes.filter("copies > 1").select("d0", "d1", F.col("doc_id").alias("class_doc"), F.col("at").alias("class_at"), "copies")
    verdict = verdict.join(matches.select("d0", "d1", F.col("to_doc").alias("match_doc"), F.col("to_at").alias("match_at")), ["d0", "d1"], "full_outer")
    out = lines.select(*place, "n", "d0", "d1").join(verdict, ["d0", "d1"], "left").drop("d0", "d1")
    first = F.col("class_doc").isNull() | ((F.col("doc_id") == F.col("class_doc")) & (F.col("at") == F.col("class_at")))
    return out.withColumn("removed", ~first | F.col("match_doc").isNotNull())


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, least: int = MIN_TOKENS, most: int = LIST) -> DataFrame:
    """doc_id, line_no, n_tokens, class_doc_id, class_line_no, copies, match_doc_id, match_line_no, removed: one row per line that takes part.

    class_*: place of the first line of the same set; copies: how many lines have it; match_*: an earlier class
    that the class matches (null: none).
    """
    line = lambda c: F.shiftright(c, DIGEST_BITS).cast("int")
    out = _judged(docs, key, text, threshold, least, most)
    return out.select("doc_id", line("at").alias("line_no"), F.col("n").alias("n_tokens"), F.coalesce("class_doc", "doc_id").alias("class_doc_id"), line(F.coalesce("class_at", "at")).alias("class_line_no"), F.coalesce("copies", F.lit(1)).alias("copies"), F.col("match_doc").alias("match_doc_id"), line("match_at").alias("match_line_no"), "removed")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, places: pd.Series) -> pd.Series:
    """Texts without the lines at places (null: no text changes)."""
    split = [t.split("\n") if t is not None and p is not None else [] for t, p in zip(texts, places)]
    which = [(k, at) for k, (lines, p) in enumerate(zip(split, places)) for at in (p if lines else ()) if at >> DIGEST_BITS < len(lines)]
    lines = [split[k][at >> DIGEST_BITS].encode("utf-8", "surrogatepass") for k, at in which]
    ats = np.array([at for _, at in which], np.int64)
    for (k, at), same in zip(which, (_at(ats >> DIGEST_BITS, _line_digests(lines)[0]) == ats).tolist() if lines else ()):
        if same:
            split[k][at >> DIGEST_BITS] = None
    return pd.Series(["\n".join(x for x in s if x is not None) if s else None for s in split], dtype="object")


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs without removed lines; documents of which no word is left go. `length` is set to the new length.

    Other columns, whatever their names, pass through unchanged; so do rows without id, and rows of empty texts.
    """
    own = "__gone"
    while {own, f"{own}_id"} & set(docs.columns):
        own += "_"
    gone = _judged(docs, key, text, THRESHOLD, ANY, LIST).filter("removed")
    gone = gone.groupBy(F.col("doc_id").alias(f"{own}_id")).agg(F.collect_set("at").alias(own))  # lines of one document
    joined = docs.join(gone, F.col(key).cast("long") == F.col(f"{own}_id"), "left")
    cut = F.col(own).isNotNull()
    joined = joined.withColumn(text, F.when(cut, _without(F.when(cut, F.col(text)), F.col(own))).otherwise(F.col(text)))
    joined = joined.filter(~cut | F.col(text).isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if length and length in docs.columns:
        joined = joined.withColumn(length, F.when(cut, F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return joined.select(docs.columns)


def op5_line_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every line of every document, unless it has no word."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), least=ANY)
