import difflib
import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from fichero import fixed
from fichero.functions import fuzzy, patterns
from fichero.functions.patterns import Openings, Terms
from fichero.operators import analysis, sections
from fichero.plans.catalogue import QUERIES


@pytest.fixture(params=["automaton", "alternation"])
def engine(request, monkeypatch):
    if request.param == "alternation":
        monkeypatch.setattr(patterns, "ahocorasick", None)


def test_terms(engine):
    terms = ["he", "she", "hers", "his", "he", "", "aé", "s h"]
    own = Terms(terms)
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice("hers iaé") for _ in range(rnd.randrange(30)))
        assert own.held(text) == [i for i, t in enumerate(terms) if t in text]
        want = sorted((m.start(), i) for i, t in enumerate(terms) if t for m in re.finditer(f"(?={re.escape(t)})", text))
        assert sorted(own.hits(text)) == want
    assert own.held(None) is None and own.held("") == [5] and Terms([]).held("x") == []


def test_openings():
    ps = ["info.*tox", "ab", "a\\s+b", "él"]
    own = Openings(ps)
    text = "AB x\n\n  a\nb\n Info y TOX\ninfo\nÉl\nxab"
    assert own.hits(text) == [(0, [1]), (4, [2]), (11, [0]), (28, [3])]
    assert own.after("xx  \n ab", 2) == [1] and own.after("xxab", 2) == [1] and own.after("x", 1) == []
    with pytest.raises(ValueError):
        Openings([r"\s*a"])


def plain_sections(text, least=100, gap=200):
    """Every pattern searched for by itself, as often as a section or an end is looked for."""
    out = []
    search = lambda p, t: re.search(rf"(?:^|\n)\s*{p}", t, re.IGNORECASE)
    for n, own in fixed.SECTION_PATTERNS.items():
        for p in own:
            m = search(p, text)
            if not m:
                continue
            tail = text[m.start() + gap - 1 :]
            ends = [e.start() for k, ps in fixed.SECTION_PATTERNS.items() if k != n for q in ps if (e := search(q, tail))]
            body = text[m.start() : m.start() + gap - 1 + min(ends)] if ends else text[m.start() :]
            if len(body.strip()) > least:
                out.append((n - 1, fixed.SECTIONS[n], body.strip()))
                break
    return out


def test_sections_by_keywords_as_by_single_searches(spark):
    rnd = random.Random(11)
    words = ["Identificación del producto", "identificacion de los peligros", "Fabricante", "Composición", "Primeros  auxilios", "primeros\nauxilios", "Medidas contra incendio", "Vertido", "Manejo y almacenamiento", "Protección personal", "Transporte", "Otra información", "Información toxicológica y otra", "Eliminación", "spill", "texto que sigue", "y mas palabras de la hoja", "x", "componentes"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "\n\n  ", " \t", ": ", "\n"]) * rnd.choice((1, 1, 2)) for _ in range(rnd.randrange(120))) for _ in range(300)]
    cutter = sections._Cutter(100, 200)
    for t in texts:
        assert [(s["pos"], s["name"], s["text"]) for s in cutter.cut(t)] == plain_sections(t)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:20], None, "", "SECCIÓN 3: " + "componentes " * 20])], "i int, text string")
    got = {r["i"]: r["s"] for r in frame.select("i", sections.sections("text").alias("s")).collect()}
    for i in range(20):
        assert [(s["pos"], s["name"], s["text"]) for s in got[i]] == plain_sections(texts[i])
    assert got[20] == got[21] == [] and [s["name"] for s in got[22]] == [fixed.SECTIONS[3]]


def test_section_keywords_as_by_single_searches(spark):
    frame = QUERIES["section_keywords"](spark, f"{DATA}/sf0.001")
    heads = spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").groupBy("conv_id").count().count()
    assert len({r["conv_id"] for r in frame.collect()}) <= heads


def test_exact_matches_as_by_single_searches(spark):
    rnd = random.Random(5)
    words = [*(w for ws in fixed.QUERY_TYPES.values() for w in ws), *fixed.PRODUCT_TERMS, "nada", "de", "Nuevo"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(4))).upper() for _ in range(300)] + [None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")
    first = lambda t: next((k for k, ws in fixed.QUERY_TYPES.items() if any(w in (t or "").lower() for w in ws)), None)
    longest = lambda t: next((fixed.PRODUCT_TERMS[w] for w in sorted(fixed.PRODUCT_TERMS, key=len, reverse=True) if w in (t or "").lower()), None)
    assert {r[0]: r[1] for r in analysis.query_type(frame, fuzzy=False).collect()} == {i: first(t) for i, t in enumerate(texts)}
    assert {r[0]: r[1] for r in analysis.product(frame, fuzzy=False).collect()} == {i: longest(t) for i, t in enumerate(texts)}


def test_fuzzy_join_equals_all_pairs_and_verifies_few(spark):
    names = sorted({w for r in spark.read.parquet(f"{DATA}/sf0.001/part.parquet").select("p_name", "p_type").collect() for w in f"{r[0]} {r[1]}".lower().split()})
    rnd = random.Random(3)
    typos = ["".join(c for c in w if rnd.random() > 0.12) + rnd.choice(["", "s", "é"]) for w in names for _ in range(8)]
    texts = [r[0] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").collect()]
    words = sorted({w for t in texts for w in re.findall(r"\w+", (t or "").lower())})[::12] + typos + ["", "aaaa", "aa"]
    left, right = spark.createDataFrame([(w,) for w in [*words, None, words[5]]], "w string"), spark.createDataFrame([(w,) for w in [*names, "aaa", ""]], "t string")
    ratio = lambda w, t: difflib.SequenceMatcher(None, t, w).ratio()
    for cutoff in (0.75, 0.9):
        want = {(w, t): ratio(w, t) for w in set(words) - {""} for t in {*names, "aaa"} if 2 * min(len(w), len(t)) >= cutoff * (len(w) + len(t)) and ratio(w, t) >= cutoff}
        got = {(r["w"], r["t"]): r["ratio"] for r in fuzzy.fuzzy_join(left, right, "w", "t", cutoff).collect()}
        assert got == want and len(want) > 20
        assert fuzzy.candidates(left, right, "w", "t", cutoff).count() < 0.01 * len(words) * len(names)
    assert fuzzy.fuzzy_join(left.limit(0), right, "w", "t", 0.8).count() == 0


def test_fuzzy_match_compiles(spark, capfd):
    QUERIES["fuzzy_match"](spark, f"{DATA}/sf0.001").collect()
    assert "InternalCompilerException" not in capfd.readouterr().err
