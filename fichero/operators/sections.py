"""Sections of documents, and everything else that is extracted from their text in one projection."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.patterns import Openings

HEADER = fixed.SECTION_HEADER
_MARK = "\x01"


def _name(number: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n, s in fixed.SECTIONS.items() for x in (n, s)])
    return F.coalesce(table[number.cast("int")], F.concat(F.lit("seccion_"), number))


def _first_of_each(parts: Column) -> Column:
    """Of parts (pos, name, text) those whose name has not come before."""
    return F.filter(parts, lambda p, i: F.array_position(parts["name"], p["name"]) == i + 1)


def numbered(text: Column | str, least: int = 50) -> Column:
    """pos, name, text of each numbered section of more than `least` characters; the first of equal numbers counts.

    A mark is set before each header, so that one split yields the sections.
    """
    return T.held(_found(text, least), _first_of_each)


def _found(text: Column | str, least: int) -> Column:
    """Numbered sections, equal numbers included."""
    x = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    marked = F.regexp_replace(x, rf"(?iuU)(?:^|\n)(?={HEADER})", _MARK)
    parts = F.slice(F.split(marked, _MARK), 2, 1 << 30)
    found = F.transform(parts, lambda p, i: F.struct(i.cast("int").alias("pos"), _name(F.regexp_extract(p, "(?iuU)^" + HEADER, 1)).alias("name"), T.strip(F.regexp_replace(p, "(?iuU)^" + HEADER, "")).alias("text")))
    return F.filter(found, lambda p: F.length(p["text"]) > least)


class _Cutter:
    """Cuts texts by the openings of fixed.SECTION_PATTERNS."""

    def __init__(self, least: int, gap: int):
        self.least, self.gap = least, gap
        own = [(n, p) for n, ps in fixed.SECTION_PATTERNS.items() for p in ps]
        self.owner = [n for n, _ in own]
        self.openings = Openings([p for _, p in own])

    def cut(self, text: str | None) -> list[dict]:
        found = self.openings.hits(text or "")
        first: dict[int, int] = {}
        for at, numbers in found:
            for i in numbers:
                first.setdefault(i, at)
        out: dict[int, str] = {}
        for i, start in sorted(first.items()):  # patterns in order, section by section
            n = self.owner[i]
            if n in out:
                continue
            end = self._end(text, found, start + self.gap - 1, n)
            body = text[start:end].strip()
            if len(body) > self.least:
                out[n] = body
        return [{"pos": n - 1, "name": fixed.SECTIONS[n], "text": out[n]} for n in sorted(out)]

    def _end(self, text: str, found: list[tuple[int, list[int]]], low: int, n: int) -> int:
        """Where the nearest opening of another section than n is, from `low` on."""
        other = lambda numbers: any(self.owner[i] != n for i in numbers)
        if low < len(text) and other(self.openings.after(text, low)):
            return low
        at = bisect_left(found, low, key=lambda f: f[0])
        return next((f[0] for f in found[at:] if other(f[1])), len(text))


def by_keywords(text: Column | str, least: int = 100, gap: int = 200) -> Column:
    """pos, name, text of sections opened by key words, for texts without numbered ones.

    A section begins at the first hit of its first pattern that gives more than `least` characters; it ends at the
    nearest hit of another section's pattern, `gap` characters on or later. All patterns are found in one pass; null
    texts cost nothing.
    """

    @F.pandas_udf("array<struct<pos:int,name:string,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        cutter = _Cutter(least, gap)
        return pd.Series([cutter.cut(t) if t else [] for t in texts], dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)


def sections(text: Column | str) -> Column:
    """Numbered sections, or those by key words where there is none."""
    return _or_by_keywords(numbered(text), _found(text, 50), F.col(text) if isinstance(text, str) else text)


def _or_by_keywords(own: Column, found: Column, x: Column) -> Column:
    # the Python side sees only texts that need it
    return F.when(F.size(own) > 0, own).otherwise(by_keywords(F.when(F.size(found) == 0, x)))


def fields(documents: DataFrame, key: str = "doc_key", text: str = "text", combined_codes: bool = True, percent: bool = True) -> DataFrame:
    """doc_key, contenido_texto and the fields of schemas.DOC_METADATA as columns, of which Spark computes those that are read."""
    t = F.col("contenido_texto")
    docs = documents.select(F.col(key).alias("doc_key"), T.clean(F.col(text)).alias("contenido_texto"))
    docs = docs.select("*", numbered(t).alias("_numbered"), T.hazard_codes(t).alias("_h"), T.precaution_codes(t).alias("_p"))
    h, p = F.col("_h"), F.col("_p")
    found = {
        "nombre_producto": T.next_line(t, T.PRODUCT_LABEL),
        "proveedor": T.next_line(t, T.SUPPLIER_LABEL),
        "codigo": T.product_code(t),
        "fecha_emision": T.issue_date(t),
        "uso_producto": T.product_use(t),
        "indicaciones_peligro": h,
        "frases_precaucion": p,
        "indicaciones_peligro_detalle": T.described(t, h, "H"),
        "frases_precaucion_detalle": T.described(t, p, "P", combined_codes),
        "componentes_quimicos": T.components(t, percent),
        "propiedades_fisicoquimicas": T.properties(t),
        "secciones": _or_by_keywords(F.col("_numbered"), F.col("_numbered"), t),
    }
    return docs.select("doc_key", "contenido_texto", *[c.alias(n) for n, c in found.items()])


def extract(documents: DataFrame, key: str = "doc_key", text: str = "text", combined_codes: bool = True, percent: bool = True) -> DataFrame:
    """doc_key, contenido_texto, metadata (schemas.DOC_METADATA) of cleaned documents. Who reads few fields takes them from `fields`."""
    docs = fields(documents, key, text, combined_codes, percent)
    return docs.select("doc_key", "contenido_texto", F.struct(*docs.columns[2:]).alias("metadata"))
