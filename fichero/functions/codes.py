"""Column functions that read code and component lists, native or flattened to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..schemas import CODE, COMPONENT


def _lookup(code: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[code], F.lit(fixed.NO_DESCRIPTION))


def _parsed(text: Column, kind: str) -> Column:
    """A list of dictionaries (quotes of either kind, with or without brackets) as an array; null where it is none."""
    listed = F.when(F.trim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return F.from_json(listed, f"array<{kind}>", {"allowSingleQuotes": "true"})


def _codes(text: Column | str, letter: str, names: dict[str, str], split: str) -> Column:
    """Plain lists are split; dictionaries are parsed; what cannot be parsed is searched for codes."""
    x = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = F.transform(F.split(x, split), lambda c: F.trim(c))
    parsed = F.transform(_parsed(x, CODE), lambda c: F.trim(c["codigo"]))
    searched = F.array_distinct(F.regexp_extract_all(x, F.lit(rf"{letter}[0-9]{{3}}"), F.lit(0)))
    usable = F.when(F.exists(parsed, lambda c: c.isNotNull()), parsed)
    codes = F.when(x.contains("{") | x.contains("["), F.coalesce(usable, searched)).otherwise(plain)
    codes = F.filter(codes, lambda c: c.isNotNull() & c.startswith(letter))
    return F.transform(codes, lambda c: F.struct(c.alias("codigo"), _lookup(c, names).alias("descripcion")))


def parse_hazards(text: Column | str) -> Column:
    """Hazard codes with the descriptions of the fixed list."""
    return _codes(text, "H", fixed.HAZARDS, ",")


def parse_precautions(text: Column | str) -> Column:
    """Precautionary codes, combinations apart, with the descriptions of the fixed list."""
    return _codes(text, "P", fixed.PRECAUTIONS, "[,+]")


def parse_components(text: Column | str) -> Column:
    """Components that have a name and a CAS number; a list that cannot be parsed is empty."""
    x = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = F.coalesce(_parsed(x, COMPONENT), F.array().cast(f"array<{COMPONENT}>"))
    found = F.filter(found, lambda c: c["nombre"].isNotNull() & c["cas"].isNotNull())
    return F.transform(found, lambda c: F.struct(c["nombre"].alias("nombre"), c["cas"].alias("cas"), F.coalesce(c["concentracion"], F.lit(fixed.NO_CONCENTRATION)).alias("concentracion")))


def flattened(items: Column | str) -> Column:
    """An array of structs as one text (JSON objects, comma between them), empty for null."""
    x = F.col(items) if isinstance(items, str) else items
    return F.coalesce(F.array_join(F.transform(x, lambda c: F.to_json(c)), ","), F.lit(""))
