import random

from conftest import DATA

from fichero.llm import line_dedup


def plain(rows, threshold=0.8, least=5):
    """removed, by comparing every line with all earlier ones."""
    lines = [((i, k), set(x.split())) for i, t in sorted(r for r in rows if r[0] is not None and r[1]) for k, x in enumerate(t.encode().lower().split(b"\n"))]
    lines = [(p, s) for p, s in lines if len(s) >= least]
    return {p: any(len(s & o) >= threshold * len(s | o) - 1e-9 for q, o in lines[:n] if q < p) for n, (p, s) in enumerate(lines)}


def fixture():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    base = [[rnd.choice(words) for _ in range(rnd.choice((6, 9, 20, 60, 150)))] for _ in range(40)]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(4):
            x = list(rnd.choice(base))
            for _ in range(rnd.choice((0, 0, 1, 3))):
                x[rnd.randrange(len(x))] = rnd.choice((rnd.choice(words), f"n{rnd.randrange(10**6)}"))
            lines.append(" ".join(x))
        rows.append((i, "\n".join(lines)))
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (503, "short line"), (None, rows[0][1]), (504, "É é Ü a b\n" + "x" * 5000), rows[3]]


def test_against_plain(spark):
    rows = fixture()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    want = plain([*dict.fromkeys(rows)])
    for most in (line_dedup.LIST, 6):
        got = {(r["doc_id"], r["line_no"]): r["removed"] for r in line_dedup.judge(frame, most=most).collect()}
        assert got == want
    assert line_dedup.judge(frame.limit(0)).count() == 0


def test_drop(spark):
    rows = [(1, "one two three four five\nkeep"), (2, "five four three two one"), (3, "ONE two three four five six\nother words are on this line"), (4, ""), (None, "one two three four five")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.drop_repeated_lines(frame).collect()}
    assert got == {1: (rows[0][1], 0), 3: ("other words are on this line", 28), 4: ("", 0), None: (rows[4][1], 0)}


def test_hashes_are_of_words():
    from fichero.llm.hashing import word_hashes

    h, at = word_hashes(" Ab ab\tÄb\x0bab\n".encode())
    assert h[0] == h[1] == h[3] != h[2] and at.tolist() == [1, 4, 7, 11]
    assert word_hashes(b"")[0].size == word_hashes(b" \n")[0].size == 0
    many = [f"w{i}" for i in range(50_000)]
    assert len(set(word_hashes(" ".join(many).encode())[0].tolist())) == len(many)


def test_runs_on_tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert line_dedup.judge(docs).filter("removed").count() == sum(plain([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]).values())


def test_short_lines(spark, tmp_path):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.choice((0, 1, 2, 3, 4, 5, 6, 12)))) for _ in range(5))) for i in range(60)]
    rows += [(100, "All rights reserved\nread on"), (101, "a a b b a b a\nALL RIGHTS reserved\none two three four"), (102, "b a\none two three four five\nread more"), (103, "\n \n")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain(rows, least=1)
    got = {(r["doc_id"], r["line_no"]): r["removed"] for r in line_dedup.op5_line_sets(spark, str(tmp_path)).collect()}
    assert got == want
    assert got[101, 1] and got[102, 0] and got[102, 1] and not got[102, 2]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(frame).collect()}
    assert all(line in kept[i].split("\n") for i, t in rows if i in kept for k, line in enumerate(t.split("\n")) if line.split() and not want[i, k])
    assert kept[101] == "a a b b a b a\none two three four" and kept[102] == "read more" and kept[103] == "\n \n"
