import random

from fichero.llm import rules


def plain(text):
    """Base counts, word by word."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_measure():
    rnd = random.Random(3)
    texts = ["", None, " \n\t", "a", "a a a a a", "x\ny\nx\n \n x", "é #1\x0b$\x0c2 a b c a b c"] + ["".join(rnd.choice("ab \n#é\t") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    for t in texts:
        m = rules.measure(t)
        assert tuple(m[c] for c in rules.BASE) == plain(t), repr(t)


def test_verdicts(spark):
    rnd = random.Random(5)
    prose = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(120)) + "."
    rows = [(i, prose()) for i in range(300)] + [(1000 + i, prose().replace(" ", "### ")) for i in range(40)] + [(2000, None), (2001, ""), (2002, "short text"), (2003, "same words " * 80), (None, prose())]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["kept"] for i in range(300)) and got[None]["kept"]
    assert not any(got[1000 + i]["kept"] for i in range(40))
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (2000, 2001, 2002, 2003))
    assert rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_single_pattern():
    assert rules.estimate({}) == {} and rules.estimate({"+" * 9: 3})["+" * 9] > 0.9
