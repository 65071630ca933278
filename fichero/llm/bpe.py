"""Operator 6: BPE encoding and decoding with a pair occurrence index.

A batch of texts is cut into pieces (special tokens, then the tokenizer's own split). Each distinct new
piece of a partition becomes a chain of symbols in one array; an index maps each pair of neighbours to all
its positions. Pairs that have a rank wait in a heap: the lowest active rank is applied at all its positions
at once, and only the index lists of the neighbours that change are updated. Pieces are independent, so one
pass over ascending ranks encodes all of them. Finished pieces are kept, in bounded number, for later texts.

Reads tokenizer files (JSON) of type BPE with an end-of-word suffix, a normaliser of NFC, white space to one
space and lower case, and a byte-level alphabet. The file is read by the driver and sent to the tasks: its
size is that of the vocabulary, whatever the corpus.

Null texts count as empty: no tokens, decoded to the empty text. Texts of any length are encoded whole. Repeated
rows, and rows without key, are encoded one by one; columns that are not asked for are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed

#: Fixed values of the public format: Unicode white space (of which \s stands for in its patterns).
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_GAP = re.compile(f"[{WHITE}]+")
#: Characters that str.split() takes for white space and the format does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Finished chunks, and finished pieces, that a task keeps.
KEPT = 800_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others take the code points from 256 on, in order.
    """
    own = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file, ready to encode with."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.key = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.numerals = [str(i) for i in range(len(self.names))]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        # pairs by both ids in one number; the merge of each rank
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault(self.ids[a] << 32 | self.ids[b], rank)
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        made = {a + b: r for r, (a, b) in enumerate(pairs)}
        if any(made.get(x, -1) > r for r, pair in enumerate(pairs) for x in pair):
            raise ValueError("a merge comes before the merge that makes its part")
        self.split = regex.compile(_pattern(spec["pre_tokenizer"]))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_alphabet()
        self.inner, self.last = [self.ids[c] for c in letters], [self.ids[c + self.suffix] for c in letters]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def symbols(self, piece: bytes) -> list[int]:
        """The first symbols of a piece: its bytes, the last one with the suffix."""
        out = [self.inner[b] for b in piece]
        out[-1] = self.last[piece[-1]]
        return out


def _pattern(spec: dict) -> str:
    found = [x["pattern"]["Regex"] for x in spec.get("pretokenizers", [spec]) if x.get("type") == "Split"]
    return found[0].replace(r"^\s", f"^{WHITE}")


def lowered(text: str) -> str:
    """Lower case character by character: no context (final sigma) is looked at."""
    return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))


def encode_pieces(pieces: list[str], vocab: Vocabulary) -> list[list[int]]:
    """Token ids of each piece, by a pair occurrence index over all of them."""
    symbol: list[int] = []
    after: list[int] = []
    before: list[int] = []
    starts = []
    for piece in pieces:
        own = vocab.symbols(piece.encode())
        first = len(symbol)
        starts.append(first)
        symbol += own
        n = len(own)
        after += range(first + 1, first + n)
        after.append(-1)
        before.append(-1)
        before += range(first, first + n - 1)
    rank_of, merges = vocab.ranks.get, vocab.merges
    where: dict[int, list[int]] = {}  # positions of the left symbol of each pair, by rank
    for i, (a, b) in enumerate(zip(symbol, symbol[1:])):
        if after[i] >= 0 and (rank := rank_of(a << 32 | b)) is not None:
            if rank in where:
                where[rank].append(i)
            else:
                where[rank] = [i]
    active = list(where)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        a, b, joined = merges[rank]
        positions = where.pop(rank)
        if a == b:
            positions.sort()  # of overlapping pairs the left one comes first
        for i in positions:
            j = after[i]
            if j < 0 or symbol[i] != a or symbol[j] != b:
                continue  # a neighbour has been merged since
            symbol[i] = joined
            symbol[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                new = rank_of(joined << 32 | symbol[k])
                if new is not None:
                    if new in where:
                        where[new].append(i)
                    else:
                        where[new] = [i]
                        heapq.heappush(active, new)
            h = before[i]
            if h >= 0:
                new = rank_of(symbol[h] << 32 | joined)
                if new is not None:
                    if new in where:
                        where[new].append(h)
                    else:
                        where[new] = [h]
                        heapq.heappush(active, new)
    out = []
    for i in starts:
        ids = []
        while i >= 0:
            ids.append(symbol[i])
            i = after[i]
        out.append(ids)
    return out


#: Characters of texts that are encoded together.
TOGETHER = 4_000_000


class Encoder:
    """Encodes texts; keeps what it has found for chunks (runs without white space)."""

    def __init__(self, vocab: Vocabulary, kept: int = KEPT):
        self.vocab, self.kept = vocab, kept
        self.known: dict[str | int, tuple[int, ...]] = {i: (i,) for i in vocab.special.values()}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _chunks(self, text: str) -> list:
        """Chunks of a text in order; a special token comes as its id."""
        parts = self.vocab.cut.split(text) if self.vocab.cut and any(s in text for s in self.vocab.special) else [text]
        out: list = []
        for part in parts:
            if part in self.vocab.special:
                out.append(self.vocab.special[part])
                continue
            if not part.isascii() and not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            out += part.split() if not _ODD.search(part) else [c for c in _GAP.split(part) if c]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode new chunks: those of their pieces that are new go through the index together."""
        split, pieces = self.vocab.split.findall, self.pieces
        if len(pieces) > self.kept:
            pieces.clear()
        cut = [(c, (low,) if (low := lowered(c)).isascii() and low.isalpha() else split(low)) for c in chunks]
        new = list({p for _, found in cut for p in found if p not in pieces})
        pieces.update(zip(new, map(tuple, encode_pieces(new, self.vocab))))
        for chunk, found in cut:
            self.known[chunk] = pieces[found[0]] if len(found) == 1 else tuple(i for p in found for i in pieces[p])
        for piece in new:
            if len(piece) > LONG:
                del pieces[piece]

    def encode(self, texts: list[str | None], together: int = TOGETHER) -> Iterator[list[int]]:
        """Ids of each text. Texts are taken together up to `together` characters."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < together):
                size += len(texts[end] or "")
                end += 1
            cut = [self._chunks(t or "") for t in texts[at:end]]
            if len(self.known) > self.kept:
                self.known = {i: (i,) for i in self.vocab.special.values()}
            new = set().union(*cut).difference(self.known)
            self.learn(new)
            known = self.known
            for chunks in cut:
                yield list(chain.from_iterable(map(known.__getitem__, chunks)))
            for chunk in new:
                if len(chunk) > LONG:
                    del known[chunk]
            at = end

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids, joined by spaces."""
        return hashlib.sha256(" ".join(map(self.vocab.numerals.__getitem__, ids)).encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as a tokenizer without decoder does; special tokens stay."""
        return " ".join(map(self.vocab.names.__getitem__, ids))


#: Characters beyond which chunks and pieces are not kept for later texts, so that the number of those kept bounds their bytes.
LONG = 200
#: The encoder of this process, kept from task to task.
_OWN: list[Encoder] = []


def encoder_of(vocab: Vocabulary, kept: int) -> Encoder:
    if not _OWN or _OWN[0].vocab.key != vocab.key:
        _OWN[:] = [Encoder(vocab)]
    _OWN[0].kept = kept
    return _OWN[0]


def encode(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text", output: str = "ids", others: tuple[str, ...] = (), kept: int = KEPT, together: int = TOGETHER, hold: bool = True) -> DataFrame:
    """Per row of docs its key, `others`, n_tokens and either `ids` (array<int>), digests (ids_sha256, decoded_sha256) or,
    for output "both", ids and decoded_sha256.

    kept: finished chunks, and pieces, that a worker keeps (about 400 bytes each; none of more than LONG characters), also after its task if `hold`.
    together: characters of texts whose new chunks go through the index at once.
    """
    own_columns = [key, *others]
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(own_columns)]
    names = {"ids": ["ids"], "both": ["ids", "decoded_sha256"]}.get(output, ["ids_sha256", "decoded_sha256"])
    schema = ", ".join([*fields, "n_tokens long", *(f"{c} {'array<int>' if c == 'ids' else 'string'}" for c in names)])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocab, kept)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = [part.column(i) for i in range(len(own_columns))]
                found = encoder.encode(part.column(len(own_columns)).to_pylist(), together)
                made: dict[str, list] = {c: [] for c in names}
                sizes = []
                for ids in found:
                    sizes.append(len(ids))
                    for c in names:
                        made[c].append(np.array(ids, np.int32) if c == "ids" else encoder.digest(ids) if c == "ids_sha256" else hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))  # noqa: B023, E731
                columns = [lists(rows) if c == "ids" else pa.array(rows, pa.string()) for c, rows in made.items()]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), *columns], [*(f"c{i}" for i in range(len(own_columns))), "n_tokens", *names])
        if not hold:
            _OWN.clear()

    out = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(own_columns)), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(own_columns)})


def decode(rows: DataFrame, vocab: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row its key and the decoded text; null ids decode to the empty text."""
    kind = rows.schema[key].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocab)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"].to_numpy(dtype=object), "text": [encoder.decode(list(x)) if x is not None else "" for x in batch["ids"]]})

    return rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded: number of tokens and digests of ids and decoded text."""
    return encode(table(spark, sf_dir, "documents"), Vocabulary.read(path or default_path()), output="digest")
