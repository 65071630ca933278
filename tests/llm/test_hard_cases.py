"""Cases that are easy to get wrong: structured words, repeated ids, clashing names, long and hostile texts, plain versions."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_line_dedup import plain as plain_lines
from test_near_dups import plain as plain_groups

from fichero.llm import bpe, classifier, html_text, licences, line_dedup, mixing, near_dups, rules, tool_calls, topk
from fichero.llm.common import Scratch, shared_folder
from fichero.llm.hashing import word_hashes


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_hashes_tell_structured_words_apart():
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    words = [one, other, one[:60], other[:60], one[:64], other[:64], "a" * 8, "a" * 9, "a" * 16, "a" * 64, "a" * 65, "ab" * 4, "ba" * 4]
    h = word_hashes(" ".join(words).encode())[0].tolist()
    assert len(set(h)) == len(words)
    assert [word_hashes(w.encode())[0][0] for w in words] == h and word_hashes(one.upper().encode())[0][0] == h[0]


def test_structured_words_are_not_alike(spark):
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, f"{one} w x y z"), (2, f"{other} w2 x2 y2 z2"), (3, one), (4, other)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dups.group(frame).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert not any(r["removed"] for r in line_dedup.judge(frame, least=1).collect())


def test_lines_with_many_near_misses(spark):
    # every pair shares most words and few reach the threshold, so classes have many candidates
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        x = list(base)
        for k in rnd.sample(range(30), 2 + i % 3):
            x[k] = f"n{rnd.randrange(10**9)}"
        rows.append((i, " ".join(x)))
    got = line_dedup.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_lines(rows)
    assert {(r["doc_id"], r["line_no"]): r["removed"] for r in got} == want and 0 < sum(want.values()) < 150
    text = dict(rows)
    for r in got:
        if r["match_doc_id"] is not None:
            a, b = set(text[r["doc_id"]].split()), set(text[r["match_doc_id"]].split())
            assert r["match_doc_id"] < r["doc_id"] and len(a & b) >= 0.8 * len(a | b)


def test_lines_of_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b c d e\nx1 x2 x3 x4 x5"), (2, "a b c d e\nown words of this row"), (2, "other words of that row\na b c d e"), (2, None), (None, "a b c d e")]
    frame = spark.createDataFrame([(*r, r[0], "g", [1]) for r in rows], "doc_id long, text string, at long, __gone string, line array<int>")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(frame).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, "own words of this row"), (2, "other words of that row"), (2, None), (None, "a b c d e")], key=str)
    assert line_dedup.drop_repeated_lines(frame).columns == frame.columns
    empty = frame.limit(0)
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_many_equal_lines_take_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        frame = spark.createDataFrame([(1, "\n".join(["one two three four five six"] * n)), (2, "short")], "doc_id long, text string")
        began = time.time()
        kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(frame).collect()}
        took.append(time.time() - began)
        assert kept == {1: "one two three four five six", 2: "short"}
    assert took[1] < 4 * took[0] + 5


def test_groups_of_repeated_ids(spark):
    rnd = random.Random(3)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    rows = [(1, " ".join(w)), (2, "z " * 40), (2, " ".join(w[:58]) + " q r"), (3, " ".join(w[:59]) + " s"), (4, None), (4, "a b")]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, rep string, component long")
    want = plain_groups([(i, min(t for j, t in rows if j == i and t is not None)) for i in (1, 2, 3, 4)])
    for n in (1, 5):
        got = near_dups.group(frame.repartition(n)).collect()
        assert len(got) == len(rows) and {r[0]: tuple(r)[1:] for r in got} == want
    kept = near_dups.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((i, min(t for j, t in rows if j == i and t is not None)) for i in want if want[i][2])


def test_groups_cut_by_size_into_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "SHINGLES", 60)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(60):
        x = list(base)
        for k in rnd.sample(range(80), i % 4):
            x[k] = f"n{rnd.randrange(10**9)}"
        rows.append((i, " ".join(x)))
    got = near_dups.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain_groups(rows)


# ---------------------------------------------------------------------- pages

ARTICLE = "".join(f"<p>Sentence {i} of the article has enough plain words to be read as text.</p>" for i in range(6))
WANT = "\n\n".join(f"Sentence {i} of the article has enough plain words to be read as text." for i in range(6))


@pytest.mark.parametrize("name", ["with-sidebar", "post has-comments", "social-science", "related-work", "notice-board article-body", "share-price-news", "sidebar", "ad"])
def test_names_around_the_article_do_not_remove_it(name):
    page = f"<body><nav><a href=x>Home</a></nav><div class='{name}'>{ARTICLE}</div><div class=footer><p>Footer text.</p></div></body>"
    assert html_text.extract(page) == WANT
    assert html_text.extract(f"<body><form id=all><div class=sidebar><p>Aside.</p></div><div>{ARTICLE}</div><footer><p>Foot.</p></footer></form></body>") == WANT


def test_parts_beside_the_article_go():
    more = "<section class='comments-area'><div class=comment><p>" + "A long reader comment. " * 60 + "</p></div></section>"
    beside = f"<aside><p>Aside.</p></aside><div class='cookie-banner'><p>Cookies.</p></div><div id=newsletter-signup><p>Sign up.</p></div><div role=alert>Note.</div><form><p>Form.</p></form>{more}"
    page = f"<body><header><h1>Site</h1></header><article><header><p>Lead.</p></header>{ARTICLE}</article>{beside}<footer>Foot</footer></body>"
    assert html_text.extract(page) == f"Lead.\n\n{WANT}"
    assert html_text.extract(f"<body><div class=page>{ARTICLE}{beside}</div></body>") == WANT


@pytest.mark.parametrize("bad", ['<a b="', "</x", "<div>", "<b><li>", "<script", "<textarea>", "</textarea", "<!--", '<a ">"', "<td>", "<dt><i>", "<p><b>", "&#x", "<![CDATA["])
def test_hostile_pages_take_linear_time(bad):
    began = time.time()
    html_text.extract(bad * 60_000)
    assert time.time() - began < 8


def test_densities_are_as_defined():
    """weigh against counts made anew for every node."""
    rnd = random.Random(1)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.2:
            return " ".join("word" for _ in range(rnd.randrange(12)))
        tag = rnd.choice(["div", "p", "a", "b", "section", "li"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randrange(4))) + f"</{tag}>"

    def below(n):
        for c in n.children:
            yield c
            if isinstance(c, html_text.Node):
                yield from below(c)

    def texts(n):
        return sum(len(" ".join(c.split())) for c in below(n) if isinstance(c, str))

    def links(n):
        if n.tag == "a":
            return texts(n)
        return sum(links(c) for c in n.children if isinstance(c, html_text.Node))

    for _ in range(40):
        root = html_text.parse("".join(tree(5) for _ in range(3)))
        order = html_text.weigh(root)
        share = links(root) / max(1, texts(root))
        for n in order:
            nodes = [c for c in below(n) if isinstance(c, html_text.Node)]
            tags, link_tags = sum(c.tag in html_text.BLOCK or c.tag == "a" for c in nodes), sum(c.tag == "a" for c in nodes)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (texts(n), tags, links(n), link_tags)
            assert n.density == pytest.approx(html_text._density(n.chars, tags, n.link_chars, link_tags, share))
            parts = [html_text._density(len(" ".join(c.split())), 0, 0, 0, share) if isinstance(c, str) else c.density for c in n.children]
            assert n.total == pytest.approx(sum(parts))


def test_long_page(spark):
    page = "<body><article>" + "<p>word &amp; word</p>" * 60_000 + "</article></body>"
    rows = [(1, "u", page, "keep"), (1, "u", page, None), (2, None, None, "k"), (None, "x", "", "k")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, *[60_000 * 11 + 59_999 * 2] * 2]


# ---------------------------------------------------------------------- chat

def test_canonical_json():
    numbers = {1e16: "10000000000000000", 1e-5: "0.00001", 1e21: "1e+21", 1.5e-7: "1.5e-7", -0.0: "0", 333333333.33333329: "333333333.3333333", 1e23: "1e+23", 4.50: "4.5", 2e-3: "0.002"}
    for x, text in numbers.items():
        assert tool_calls.canonical(x) == text and float(text) == x
    assert tool_calls.canonical({"\ufb33": 1, "\U0001f600": 2, "1": [None, True, "\n\u20ac"]}) == '{"1":[null,true,"\\n\u20ac"],"\U0001f600":2,"\ufb33":1}'
    with pytest.raises(ValueError):
        tool_calls.canonical([math.nan])


def test_numbers_that_are_not_json(spark):
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":%s}]}'
    rows = [(1, i, "assistant", call % x) for i, x in enumerate(('"{\\"x\\":NaN}"', '"{\\"x\\":1e999}"', '"{\\"x\\":1}"'))]
    got = tool_calls.link(spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, kind int, json string")).filter("kind = 'call'").orderBy("turn").collect()
    assert [r["problem"] for r in got] == ["bad_arguments", "bad_arguments", "duplicate_id"]


def test_chains_and_circles(spark):
    n = 40
    calls = [{"id": f"c{i}", "name": "f", "arguments": {}, "after": [f"c{i - 1}"] if i else []} for i in range(n)]
    calls += [{"id": "x", "name": "f", "arguments": {}, "after": ["y"]}, {"id": "y", "name": "f", "arguments": {}, "after": ["x"]}, {"id": "z", "name": "f", "arguments": {}, "after": ["x", "c3"]}]
    rnd = random.Random(2)
    rnd.shuffle(calls)
    text = tool_calls.canonical({"content": "é" * 200_000, "tool_calls": calls})
    rows = [(1, 0, "assistant", text)] + [(1, i + 1, "tool", f'{{"tool_call_id":"c{i}","content":{i}}}') for i in range(n)]
    got = {r["call_id"]: r for r in tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("kind = 'call'").collect()}
    for i in range(n):
        r = got[f"c{i}"]
        assert (r["problem"], r["level"], r["at"], r["linked"]) == (None, 2 * i, i, True)
    assert {got[k]["problem"] for k in "xyz"} == {"circle"} and got["z"]["at"] is None


# ---------------------------------------------------------------------- mix, rules

def test_mix_with_clashing_names_and_null_ids(spark):
    rows = [(None if i % 2 else i, f"s{i % 3}", "w " * (1 + i % 40)) for i in range(400)]
    own = "full mean multiplier mix_source mix_copies size row key hash groups units copies n_docs source_size".split()
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").select("*", *[F.lit(n).alias(n) for n in own])
    out = mixing.repeat(frame)
    assert out.columns == frame.columns and [r[0] for r in out.select("mix_copies").distinct().collect()] == ["mix_copies"]
    mixed = mixing.mix(frame)
    assert mixed.select("full").distinct().count() == 1 and mixed.filter("mix_copies not in (0, 1, 2)").isEmpty()
    count = lambda df: sorted(df.groupBy("doc_id", "source", "text").count().collect(), key=str)
    assert count(out) == count(mixing.repeat(frame.repartition(5)))
    assert mixing.repeat(frame.limit(0)).count() == 0


def test_rates_are_the_entropy_optimum(spark):
    """Every tilted rate against the plain solution: one multiplier for each source, by bisection."""
    rnd = random.Random(4)
    rows = [(i, "abc"[i % 3], rnd.choice((1, 5, 20, 100))) for i in range(900)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), size="size").collect()
    for s in "abc":
        own = [r for r in mixed if r["source"] == s]
        sizes, target = np.array([r["mix_size"] for r in own], float), own[0]["mix_target"]
        low, high = -50.0, 50.0
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if (np.minimum(2, np.exp(m * sizes / sizes.mean())) * sizes).sum() < target else (low, m)
        want = np.minimum(2, np.exp(low * sizes / sizes.mean()))
        if target < 2 * sizes.sum() - 1e-6:
            assert np.abs(want - [r["mix_rate"] for r in own]).max() < 1e-5


def test_a_mix_that_does_not_settle_says_so(spark):
    hist = spark.createDataFrame([("a", 1, 5), ("a", 9, 5)], "source string, size long, n long")
    goals = spark.createDataFrame([("a", 50, 10, 31.0, False)], "source string, source_size long, n_docs long, target double, full boolean")
    with pytest.raises(RuntimeError):
        mixing.multipliers(hist, goals, 2.0, Scratch(spark), most=1)


def planted(share_good, n=40_000, seed=0):
    """Patterns of votes drawn from known rates."""
    rnd = np.random.default_rng(seed)
    good = rnd.random(n) < share_good
    seen = np.array([0.35, 0.3, 0.25, 0.4, 0.3, 0.35])
    bad = np.where(good[:, None], rnd.random((n, 6)) < 0.01, rnd.random((n, 6)) < seen)
    abstain = rnd.random((n, 6)) < 0.1
    votes = np.where(abstain, 1, np.where(bad, 0, 2))
    names = ["".join("-0+"[v] for v in row) for row in votes]
    return names, good


@pytest.mark.parametrize("share", [0.9, 0.6, 0.2])
def test_em_finds_planted_quality(share):
    names, good = planted(share)
    counts = {}
    for p in names:
        counts[p] = counts.get(p, 0) + 1
    posterior = rules.estimate(counts)
    kept = np.array([posterior[p] >= 0.5 for p in names])
    # at least as many right as a document without a bad vote being good, and the share follows the planted one
    best = max((kept == good).mean(), 0)
    plain = np.array(["-" not in p for p in names])
    assert best >= (plain == good).mean() - 0.02
    assert abs(np.mean([posterior[p] for p in names]) - share) < 0.2


def test_rules_with_clashing_names_and_long_texts(spark):
    rows = [(1, "word " * 200_000, "k"), (1, "word " * 200_000, "k"), (2, None, None), (None, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pattern string").withColumn("key", F.lit(1)).withColumn("quality", F.lit(2))
    got = rules.judge(frame).collect()
    assert sorted(r["n_words"] for r in got) == [0, 0, 200_000, 200_000] and all(r["base_failed"] and not r["kept"] for r in got)


# ---------------------------------------------------------------------- licences

MIT = licences.KNOWN["MIT"][1]
BSD2 = licences.KNOWN["BSD-2-Clause"][0]


def test_licence_variants(spark):
    texts = [f"MIT License\n\nCopyright Jane Doe\n\n{MIT}", f"The MIT License (MIT)\n\nCopyright (c) 2020-2024 J. D.\nAll rights reserved.\n{MIT}", BSD2.replace("\n1. ", "\n* ").replace("\n2. ", "\n* "), "\n".join(line[i : i + 1] and line for line in MIT.split("\n") for i in (0,)), "(a) SPDX-License-Identifier: MIT", "Copyright Jane Doe", "x " * 100_000 + "\nReleased under the MIT licence.\n", "", None, MIT + " and more"]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, licence string, key string")
    got = {r["doc_id"]: r for r in licences.scan(frame.unionByName(frame.filter("doc_id = 0"))).collect()}
    assert [got[i]["licence"] for i in range(len(texts))] == ["MIT", "MIT", "BSD-2-Clause", "MIT", "MIT", None, None, None, None, None]
    assert got[6]["notices"] == ["MIT"]
    assert licences.scan(frame.limit(0)).count() == 0
    own = spark.createDataFrame([("Own", "My own licence, 1.\nDo as you like.")], "licence string, text string")
    found = licences.scan(spark.createDataFrame([(1, "my OWN license 1 do as YOU like")], "doc_id long, text string"), own).first()
    assert found["licence"] == "Own"


def test_long_licences(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    if not (folder / "GPL-3").exists():
        pytest.skip("no licence texts on this machine")
    rows = [(name, (folder / file).read_text()) for name, file in (("GPL-3.0-only", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))]
    got = licences.scan(spark.createDataFrame([(n, " ".join(t.split(" ")).upper()) for n, t in rows], "doc_id string, text string")).collect()
    assert all(r["doc_id"] == r["licence"] for r in got) and len(got) == 4


# ---------------------------------------------------------------------- classifier, encoder, search

def test_scores_are_those_of_nearest_neighbours(spark):
    """The model against a plain loop over all neighbours."""
    rnd = random.Random(6)
    good, bad = [f"wort{i}" for i in range(80)], [f"#x{i}!" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(good if i % 3 else bad) for _ in range(rnd.randrange(5, 80)))) for i in range(400)] + [(900, ""), (901, None), (902, "a" * 300_000)]
    docs = spark.createDataFrame([(*r, "k", 0.5) for r in rows], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(0, 400, 2)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in classifier.score(docs, model).collect()}
    of = classifier.Terms()
    for i, text in rows[::25] + rows[-3:]:
        terms = of.counts(text)
        if not len(terms[0]):
            assert got[i] == pytest.approx(model.prior)
            continue
        cosine = [float(v @ model.embed([terms])[0]) for v in model.vectors]
        near = sorted(range(len(cosine)), key=lambda j: -cosine[j])[: model.neighbours]
        weight = [max(cosine[j], 0) ** 8 * model.votes[j] for j in near]
        want = (sum(w * model.labels[j] for w, j in zip(weight, near)) + 0.02 * model.prior) / (sum(weight) + 0.02)
        assert got[i] == pytest.approx(min(1, max(0, want)), abs=2e-3)
    told = [(got[i] >= 0.5) == bool(i % 3) for i, _ in rows[:400] if i % 2]
    assert sum(told) / len(told) > 0.95
    assert classifier.keep(docs, model).columns == docs.columns


def test_encoder_forgets_long_words():
    encoder = bpe.Encoder(bpe.Vocabulary.read(bpe.default_path()))
    texts = ["x" * 50_000 + " short words", "short " + "ab" * 30_000]
    first = list(encoder.encode(texts))
    assert first == list(encoder.encode(texts)) and all(len(k) <= bpe.LONG for k in encoder.known if isinstance(k, str)) and all(len(k) <= bpe.LONG for k in encoder.pieces)


def test_search_in_many_blocks(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=6).tolist() if i % 9 else None) for i in range(300)] + [(1000, [1e300] * 6), (1001, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    built = topk.index(frame, shard=40)
    asked = frame.filter("vec_id % 2 = 0")
    a, b = ({tuple(r) for r in topk.search(built, asked, 4, block=n).collect()} for n in (7, 1024))
    assert a == b and len({r[0] for r in a}) == asked.filter("embedding is not null").count()


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError):
        shared_folder(Session())
    assert shared_folder(spark)
