import random

import numpy as np

from fichero.llm import near_dups
from fichero.llm.components import components
from fichero.llm.common import Scratch


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """Size and component of every id, from all pairs."""
    s = {i: sets(t) for i, t in rows if i is not None}
    label = {i: i for i in s}
    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if s[a] and s[b] and label[a] != label[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return {i: (len(s[i]), label[i], i == label[i]) for i in s}


def fixture():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    rows, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(200)]
        for _ in range(25):  # copies with few or many edits: links run through the base
            x = list(base)
            for _ in range(rnd.choice((0, 1, 3, 6, 8, 12, 20))):
                x[rnd.randrange(len(x))] = word()
            rows.append((n, " ".join(x)))
            n += 1
    shared = [word() for _ in range(60)]
    rows += [(1000 + i, " ".join(shared + [word() for _ in range(100)])) for i in range(20)]
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, "two words"), (2004, "TWO\twords"), (2005, "a b c d"), (2006, "same " * 300), (2007, "same " * 9), rows[0], (None, rows[0][1])]


def test_against_plain(spark):
    rows = fixture()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (near_dups.BUCKET, 4):
        got = near_dups.group(frame, bucket=bucket).collect()
        assert len(got) == len(rows)
        assert {r[0]: (r[1], r[2], r[3]) for r in got if r[0] is not None} == plain(rows)
        assert [r["kept"] for r in got if r[0] is None] == [True]


def test_drop(spark):
    frame = spark.createDataFrame([(3, "a b c d e f", 1), (2, "a b c d e f", 2), (5, "x", 3), (5, "x", 3), (None, "x", 4)], "doc_id long, text string, component_id int")
    assert sorted((r[0] or 0, r[2]) for r in near_dups.drop_near_duplicates(frame).collect()) == [(0, 4), (2, 2), (5, 3)]
    assert near_dups.drop_near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (102, 103), (7, 7), (200, 201), (201, 200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 103: 100, 201: 200}


def test_members_are_compared_by_whole_hashes(spark, monkeypatch):
    import pandas as pd

    # six hashes of eight are common, of which two share their upper half
    common = [1 << 40, (1 << 40) + 1, *(k << 40 for k in range(2, 6))]
    sets = {f"t{i}": np.array(sorted([*common, own << 50]), np.uint64) for i, own in ((1, 7), (2, 9))}
    monkeypatch.setattr(near_dups, "shingles", sets.get)
    made = next(near_dups._with_hashes(iter([pd.DataFrame({"rep": [1, 2], "text": ["t1", "t2"]})])))
    rows = [(0, 0, 0, 0, False, rep, rep, h) for rep, h in zip(made["rep"].tolist(), made["hashes"])]
    members = spark.createDataFrame(rows, "band long, level long, part int, block int, upper boolean, rep long, component long, hashes binary")
    assert [tuple(r) for r in near_dups.scan(members).collect()] == [(1, 2)]
