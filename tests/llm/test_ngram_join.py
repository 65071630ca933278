import random

import numpy as np
import pytest
from conftest import DATA

from fichero.llm import ngram_join, near_dups
from fichero.llm.near_dups import linked, shingles
from fichero.llm.ngram_join import Mark, _near, group, in_order, mark, prefix_length


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def plain(rows, percent=90):
    """Size and component of every id, from all pairs."""
    s = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None and t is not None), reverse=True):
        s[i] = sets(t)  # the least text of an id comes last
    s |= {i: frozenset() for i, t in rows if i is not None and i not in s}
    label = {i: i for i in s}
    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if s[a] and s[b] and label[a] != label[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return {i: (len(s[i]), label[i]) for i in s}


def fixture():
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    rows, n = [], 0
    for size in (12, 60, 61):
        base = [word() for _ in range(size)]
        for _ in range(20):  # copies with few or many edits: links run through the base
            x = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 4))):
                x[rnd.randrange(len(x))] = word()
            rows.append((n, " ".join(x[: rnd.choice((len(x), len(x) - 1, len(x) - 9))])))
            n += 1
    shared = [word() for _ in range(60)]
    rows += [(1000 + i, " ".join(shared + [word() for _ in range(30)])) for i in range(40)]
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, "two words"), (2004, "TWO\twords"), (2005, "a b c"), (2006, "same " * 300), (2007, "same " * 9), rows[0], (2008, "É b c"), (2009, "é b c"), (2010, "x"), (2011, "X"), (2012, "x y")]


@pytest.mark.parametrize("bucket", [near_dups.BUCKET, 12])
def test_against_plain(spark, bucket):
    rows = [*fixture(), (None, "a b c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", ngram_join.F.lit("clash"))
    got = group(frame, bucket=bucket).collect()
    assert len(got) == len(rows)
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == plain(rows)
    assert [tuple(r) for r in got if r[0] is None] == [(None, 1, None)]


def test_ids_with_several_texts_and_empty(spark):
    rows = [(1, "a b c d"), (1, "a b c"), (2, "A b c"), (3, "a b c d"), (4, None), (4, "q"), (5, "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r[0], r[1], r[2]) for r in group(frame).collect()}
    assert got == {(i, *v) for i, v in plain(rows).items()}
    assert group(frame.limit(0)).collect() == []


def test_similar_sets_share_a_prefix_token_under_every_order():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(1, 120))
        a = rnd.integers(1, 2**63, n).astype(np.uint64)
        keep = int(np.ceil(0.9 * n))
        b = np.unique(np.concatenate([a[:keep], rnd.integers(1, 2**63, max(0, int(keep / 0.9) - n)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 90 * (len(a) + len(b) - common):
            continue
        for order in range(1, ngram_join.ORDERS):
            p, q = (in_order(x, order, prefix_length(len(x))) for x in (a, b))
            assert len(np.intersect1d(p, q)) and len(p) == min(n, prefix_length(n))


def test_filters_drop_no_pair():
    texts = [t for _, t in fixture() if t and t.split()]
    own = [shingles(t, 3) for t in texts]
    marks = [Mark(mark(s)) for s in own]
    near = _near(marks, 90)
    allowed = 0
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            common = len(np.intersect1d(a, b))
            link = 100 * common >= 90 * (len(a) + len(b) - common)
            pair = _near([marks[i], marks[j]], 90)[0, 1] and marks[i].meets(marks[j])
            assert pair or not link
            assert near[i, j] or not link
            allowed += pair and not link
    assert allowed < 0.05 * len(own) ** 2 / 2
    assert len(linked(near, np.arange(len(own)), own, 90)) < len(own)


def test_postings_of_a_common_token_grow_less_than_its_square(spark):
    """One shingle that all documents share, in a single list: rows that tasks compare stay near their number."""
    F = ngram_join.F
    n = 200_000
    live = spark.range(n).select(F.lit(1).cast("long").alias("band"), F.col("id").alias("rep"), F.col("id").alias("component"), (10 + F.col("id") % 5000).alias("n_shingles"))
    levels = near_dups.by_size(live, 90)
    assert levels.count() <= 2 * n
    assert near_dups.in_blocks(levels, near_dups.BUCKET).count() < n**1.5


def test_same_as_sql(compare):
    compare(ngram_join.op13_ngram_join, ngram_join.ORACLE, f"{DATA}/sf0.001")
