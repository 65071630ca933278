import math
import random
import re
from collections import Counter

import numpy as np
from conftest import DATA

from fichero.llm import treaps
from fichero.llm.treaps import Best, Treaps, _merged, _Shard, _treaps, search, terms

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, k=20):
    """Every document scored for every item."""
    own = [(i, PATTERN.findall(lower(t))) for i, t in docs if i is not None]
    own = [(i, t) for i, t in own if t]
    n_docs, total = len(own), sum(len(t) for _, t in own)
    df = Counter(t for _, ts in own for t in set(ts))
    least = {}
    for i, t in items:
        if i is not None and t is not None:
            least[i] = min(t, least.get(i, t))
    out = set()
    for item, text in least.items():
        scored = []
        for i, ts in own:
            tf, m = Counter(ts), 75 + (25 * len(ts) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in PATTERN.findall(lower(text)) if tf[t])
            if score > 0:
                scored.append((-score, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") * rnd.choice((1, 1, 2, 3)) + rnd.choice(["", "X", "é", "9"])
    docs = [(i, " ".join(word() for _ in range(rnd.choice((1, 5, 30, 90))))) for i in rnd.sample(range(-1000, 5000), n)]
    return docs + [(9000 + i, docs[0][1]) for i in range(30)]


HARD = [(-5000, None), (-5001, ""), (-5002, " .-\n"), (-5003, "Éa ÉA éa"), (-5004, "only_here\x00twice ONLY-here"), (None, "a b c"), (-5005, "a " * 30000), (-5006, "x y  z")]


def test_against_plain(spark, monkeypatch):
    docs = corpus(400, 1) + HARD
    docs.append(docs[0])
    items = [(i, t) for i, (_, t) in enumerate(corpus(25, 2))] + [(100, None), (101, ""), (102, "absent words"), (103, "twice only ONLY here"), (104, "a a a"), (104, "b b"), (None, "a"), (105, "éa ÉA"), (106, "x y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", treaps.F.lit("clash")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", treaps.F.lit("clash"))
    want = plain(docs, items)
    for wanted in (treaps.WANTED, 3):  # all terms are packed where the queries have more than that
        assert {tuple(r) for r in search(frame, asked, wanted=wanted).collect()} == want
    monkeypatch.setattr(treaps, "BLOCK", 4)
    assert {tuple(r) for r in search(frame, asked, k=3).collect()} == plain(docs, items, 3)


def test_empty(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, item_id long, text string")
    for docs, items in (([], [(1, 1, "a")]), ([(1, 1, "a")], []), ([(1, 1, " ")], [(1, 1, "a")]), ([(1, 1, "a")], [(1, 1, "b")])):
        assert search(frame(docs), frame(items)).collect() == []


def built(docs):
    shard = _Shard()
    for i, t in docs:
        shard.add(i, t.encode(), None)
    return Treaps(_merged([{c: v[0] for c, v in shard.row().to_pydict().items()}], shard.documents, shard.total).to_pylist()[0])


def test_treaps_are_heaps_and_search_trees():
    rnd = np.random.default_rng(3)
    sizes = np.array([1, 500, 2000])
    doc = np.concatenate([np.sort(rnd.choice(5000, n, replace=False)) for n in sizes])
    impact = np.concatenate([rnd.integers(0, 20, 501), np.full(2000, 7)])
    roots, left, right = _treaps(impact, doc, sizes)
    seen, deepest = set(), 0

    def check(i, low, high, most, depth):
        nonlocal deepest
        if i == len(doc):
            return
        assert low <= doc[i] < high and impact[i] <= most
        seen.add(int(i))
        deepest = max(deepest, depth)
        check(left[i], low, doc[i], impact[i], depth + 1)
        check(right[i], doc[i] + 1, high, impact[i], depth + 1)

    for r in roots:
        check(r, 0, 5000, 20, 1)
    assert seen == set(range(len(doc)))
    assert deepest < 60  # equal impacts, too, make a tree of logarithmic depth


def test_pruning_scores_few_documents():
    rnd = random.Random(5)
    docs = [(i, " ".join(f"w{min(int(rnd.paretovariate(0.6)), 3000)}" for _ in range(60))) for i in range(5000)]
    index = built(docs)
    best = Best(20)
    scored = index.search([(b"w1500", 5000), (b"w40", 2000), (b"w3", 20)], best)
    have = sum(any(w in t.split() for w in ("w1500", "w40", "w3")) for _, t in docs)
    assert scored < have / 5
    assert (np.diff(best.scores) <= 0).all() and len(best.ids) == 20
    for batch in (1, 3, 1000):
        other = Best(20)
        index.search([(b"w1500", 5000), (b"w40", 2000), (b"w3", 20)], other, batch)
        assert other.ids.tolist() == best.ids.tolist() and other.scores.tolist() == best.scores.tolist()


def test_terms():
    text = "".join(map(chr, range(0x250))) + "Ab-Ç9_x"
    assert [t.decode() for t in terms(text.encode())] == PATTERN.findall(lower(text))


def test_same_as_sql(compare):
    compare(treaps.op12_treap_search, treaps.ORACLE, f"{DATA}/sf0.001")
