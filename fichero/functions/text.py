"""Column functions on strings: cleaning, token estimates, codes, components, questions and answers.

All are built-in expressions, so they stay in the JVM and take part in Catalyst's optimisation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends (also line breaks and no-break spaces)."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: lambdas would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(x: Column | str) -> Column:
    return F.when(_col(x) == "", None).otherwise(_col(x))


def clean(text: Column | str) -> Column:
    """Runs of blanks to one; at most one empty line in a row; no white space where a line begins; stripped."""
    x = F.regexp_replace(_col(text), r"[ \t]+", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(x, r"(?mdU)^\s+", ""))


def estimate_tokens(text: Column | str) -> Column:
    """Characters by four, rounded down (long)."""
    return F.floor(F.length(_col(text)) / fixed.CHARS_PER_TOKEN).cast("long")


def paragraphs(text: Column | str, separator: str = "\n\n") -> Column:
    """Stripped parts between separators, without empty ones."""

    def stripped(p: Column) -> Column:
        # most parts have no white space at their ends: two characters tell
        return F.when(F.concat(F.substring(p, 1, 1), F.substring(p, -1, 1)).rlike(r"(?U)\s"), strip(p)).otherwise(p)

    return F.filter(F.transform(F.split(_col(text), separator), stripped), lambda p: p != "")


def with_context(content: Column | str, product: Column | str, section: Column | str) -> Column:
    """Content headed by its document and section; a missing name reads None."""
    missing = F.lit("None")
    return F.concat(F.lit("Documento: "), F.coalesce(_col(product), missing), F.lit("\nSección: "), F.coalesce(_col(section), missing), F.lit("\n\n"), _col(content))


def chunk_id(document: Column | str, index: Column | str, content: Column | str) -> Column:
    """Document, running number in three digits and the first eight digits of the content's MD5."""
    return F.format_string("%s_chunk_%03d_%s", F.coalesce(_col(document), F.lit("None")), _col(index), F.substring(F.md5(_col(content).cast("binary")), 1, 8))


def product_code(text: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(F.substring(_col(text), 1, fixed.CODE_HEAD), "(?iuU)" + fixed.PRODUCT_CODE, 1))


def issue_date(text: Column | str) -> Column:
    """Date after its Spanish or English label, as text."""
    return blank_to_null(F.regexp_extract(F.substring(_col(text), 1, fixed.DATE_HEAD), "(?iuU)" + fixed.ISSUE_DATE, 1))


def parsed_date(date: Column | str) -> Column:
    """Dates of the form dd.MM.yyyy; others are null."""
    return F.try_to_timestamp(_col(date), F.lit("dd.MM.yyyy")).cast("date")


def product_use(text: Column | str) -> Column:
    """What follows its label, up to an empty line or a line that begins with a letter."""
    return blank_to_null(strip(F.regexp_extract(F.substring(_col(text), 1, fixed.USE_HEAD), "(?isuU)" + fixed.PRODUCT_USE, 1)))


def hazard_codes(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit("(?U)" + fixed.HAZARD_CODE), F.lit(0))))


def precaution_codes(text: Column | str) -> Column:
    """Single codes and combinations (P301 + P310), distinct, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit("(?U)" + fixed.PRECAUTION_CODE), F.lit(0))))


def described(text: Column | str, codes: Column, letter: str, combined: bool = True) -> Column:
    """codigo and descripcion of each code that the text describes: what follows its first mention, to the line's end or the next code.

    combined: codes with + are looked up as they stand; otherwise they are read as patterns and never found.
    """

    def of(code: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), code, F.lit(r"\E")) if combined else code
        hit = F.concat(F.lit(r"(?iuU)"), quoted, F.lit(rf"[\s]+(.*?)(?:\n|{letter}[0-9]{{3}}|$)"))
        return F.struct(code.alias("codigo"), F.when(F.regexp_like(_col(text), hit), strip(F.call_function("regexp_extract", _col(text), hit, F.lit(1)))).alias("descripcion"))

    return F.filter(F.transform(codes, of), lambda x: x["descripcion"].isNotNull())


def components(text: Column | str, percent: bool = True) -> Column:
    """nombre, cas, concentracion of each "name CAS: number [range]".

    percent: a concentration needs a percent sign; otherwise it may swallow the first digit of the next name.
    """
    amount = fixed.CONCENTRATION if percent else fixed.LOOSE_CONCENTRATION
    # a line that fails from where it begins, or from where the last component ends, fails from all that follows in it
    pattern = rf"(?mU)(?:^|\G){fixed.COMPONENT}(?:\s+{amount})?"
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)), lambda x: F.struct(strip(part(x, 1)).alias("nombre"), part(x, 2).alias("cas"), blank_to_null(strip(part(x, 3))).alias("concentracion")))


def properties(text: Column | str) -> Column:
    """Physical properties: first mention of each; empty ones are null."""
    return F.struct(*[blank_to_null(strip(F.regexp_extract(_col(text), "(?iuU)" + p, 1))).alias(n) for n, p in fixed.PROPERTIES.items()])


def next_line(text: Column | str, label: str, lines: int = 50) -> Column:
    """The line after the first one of the head that holds the label and is followed by one of 4 to 199 characters."""
    head = F.slice(F.split(_col(text), "\n"), 1, lines)
    pairs = F.arrays_zip(F.slice(head, 1, lines - 1).alias("x"), F.slice(head, 2, lines).alias("y"))
    hits = F.filter(pairs, lambda p: p["x"].rlike(label) & F.length(strip(p["y"])).between(4, 199))
    return strip(F.get(hits, F.lit(0))["y"])


PRODUCT_LABEL = "(?iuU)" + fixed.PRODUCT_LABEL
SUPPLIER_LABEL = "(?iu)" + fixed.SUPPLIER_LABEL


def mentions(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words, whatever its case."""
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")


def enriched(question: Column | str, product: Column | str) -> Column:
    """A question of fewer than four words that names no product gets the session's product."""
    q, p = _col(question), _col(product)
    return F.when(p.isNotNull() & (p != "") & ~mentions(q, fixed.PRODUCT_WORDS) & (F.size(words_of(q)) < 4), F.concat_ws(" ", q, p)).otherwise(q)


def is_follow_up(question: Column | str) -> Column:
    w = words_of(question)
    return (F.size(w) > 0) & (F.get(w, F.lit(0)).isin(fixed.FOLLOW_UP) | (F.size(w) < 5))


def plain_answer(answer: Column | str) -> Column:
    """Without Markdown; too short an answer becomes the error text."""
    x = F.regexp_replace(_col(answer), r"\*\*(.+?)\*\*", "$1")
    x = F.regexp_replace(x, r"\*(.+?)\*", "$1")
    x = F.regexp_replace(x, r"(?U)#+\s*", "")
    x = F.regexp_replace(x, r"(?mdU)^-\s+", "")
    x = F.regexp_replace(x, r"(?mdU)^[0-9]+\.\s+", "")
    return F.when(F.length(strip(x)) < fixed.MIN_ANSWER, fixed.SHORT_ANSWER).otherwise(x)


def image_description(file_name: Column | str, ocr: Column | str) -> Column:
    """Kind by file name, then the text that was read from the image."""
    stem = F.lower(F.regexp_replace(_col(file_name), r"\.[^.]*$", ""))
    kind = F.when(stem.rlike("pictograma|ghs"), "Pictograma de seguridad").when(stem.rlike("etiqueta|label"), "Etiqueta del producto").otherwise("Imagen")
    seen = F.coalesce(_col(ocr), F.lit(""))
    return F.concat(kind, F.lit(". "), F.when(seen != "", F.concat(F.lit("Texto visible: "), seen)).otherwise(""))


def pictogram_class(description: Column | str) -> Column:
    """The first class, in order, of which the description holds a word."""
    low, out = F.lower(_col(description)), None
    for name, words in fixed.PICTOGRAM_CLASSES.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(fixed.OTHER_PICTOGRAM)


def preview(content: Column | str, size: int = fixed.PREVIEW_CHARS) -> Column:
    return F.concat(F.substring(_col(content), 1, size), F.lit("..."))


def stem(path: Column | str, suffix: str = "") -> Column:
    """File name without folders, extension and a suffix."""
    name = F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(name, f"{suffix}$", "") if suffix else name


def html_escape(text: Column | str) -> Column:
    x = F.replace(_col(text), F.lit("&"), F.lit("&amp;"))
    for one, other in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(one), F.lit(other))
    return x


def is_number(text: Column | str) -> Column:
    """Digits with any number of points among them."""
    return _col(text).rlike(r"^[0-9.]*[0-9][0-9.]*$")


def fold_accents(text: Column | str) -> Column:
    return F.translate(_col(text), "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")
