"""Many patterns in one pass over a text: terms by an automaton, openings of lines by an index of first letters.

Both yield all hits at once, with positions, in Arrow batches; what a caller makes of them (the first kind with a
hit, the longest term, the nearest section) is a minimum or maximum over hits, not a search for each pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

try:
    import ahocorasick
except ImportError:  # the automaton is optional: without it, an alternation that looks ahead does the same, slower
    ahocorasick = None


class Terms:
    """Finds which of a list of terms a text holds, anywhere, overlapping or not."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self.of: dict[str, list[int]] = {}
        for i, t in enumerate(self.terms):
            self.of.setdefault(t, []).append(i)
        self.empty = self.of.pop("", [])
        self.automaton = self.regex = None
        if ahocorasick is not None and self.of:
            self.automaton = ahocorasick.Automaton()
            for t in self.of:
                self.automaton.add_word(t, t)
            self.automaton.make_automaton()
        elif self.of:
            self._starts: dict[str, list[str]] = {}
            for t in sorted(self.of):
                self._starts.setdefault(t[0], []).append(t)
            self.regex = re.compile("|".join(map(re.escape, self._starts)))

    def hits(self, text: str | None) -> Iterator[tuple[int, int]]:
        """(position, number of the term) of every hit but those of the empty term."""
        if text is None:
            return
        if self.automaton is not None:
            for end, t in self.automaton.iter(text):
                for i in self.of[t]:
                    yield end - len(t) + 1, i
        elif self.regex is not None:
            for m in self.regex.finditer(text):
                for t in self._starts[m.group()]:
                    if text.startswith(t, m.start()):
                        for i in self.of[t]:
                            yield m.start(), i

    def held(self, text: str | None) -> list[int] | None:
        """Numbers of the terms that the text holds, ascending; null for null."""
        return None if text is None else sorted({*self.empty, *(i for _, i in self.hits(text))})


@lru_cache(32)
def _terms(terms: tuple[str, ...]) -> Terms:
    return Terms(terms)


def terms_held(text: Column | str, terms: Iterable[str]) -> Column:
    """Numbers, from 0, of the terms that a text holds, ascending; null for null. One pass, however many terms."""
    listed = tuple(terms)

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        own = _terms(listed)  # built once in each worker
        return pd.Series([own.held(t) for t in texts], dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)


class Openings:
    """Finds which of a list of regular expressions open a line, white space before them left out.

    Where one does, its hit begins with the first line break of the white space before it, or with the text. An
    expression must begin with a letter. Only those with a line's first letter are tried on it.
    """

    _HEAD = re.compile(r"(?:\A|\n)\s*(?=\S)")
    _SPACE = re.compile(r"\s*")

    def __init__(self, patterns: Sequence[str]):
        self.by_letter: dict[str, list[tuple[int, re.Pattern]]] = {}
        for i, p in enumerate(patterns):
            if not p[:1].isalpha():
                raise ValueError(f"{p!r} does not begin with a letter")
            regex = re.compile(p, re.IGNORECASE)
            for letter in {p[0].lower(), p[0].upper()}:
                self.by_letter.setdefault(letter, []).append((i, regex))

    def at(self, text: str, head: int) -> list[int]:
        """Numbers of the expressions that match where `head` is, ascending."""
        return [i for i, p in self.by_letter.get(text[head : head + 1], ()) if p.match(text, head)]

    def after(self, text: str, position: int) -> list[int]:
        """Those that open a text cut at `position`."""
        return self.at(text, self._SPACE.match(text, position).end())

    def hits(self, text: str) -> list[tuple[int, list[int]]]:
        """(position, numbers) of all openings, in order."""
        out = []
        for m in self._HEAD.finditer(text):
            found = self.at(text, m.end())
            if found:
                out.append((m.start(), found))
        return out
