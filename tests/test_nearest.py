import numpy as np
import pandas as pd

from fichero.functions import vectors


def test_ties_keep_k_rows_and_the_least_ids():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        cosines = rnd.integers(0, 3, (5, rnd.integers(1, 12))) / 4
        k = int(rnd.integers(1, 5))
        keys = np.arange(cosines.shape[1]) + 10
        got = vectors._Best._tile(0, cosines, keys, k)
        for q in range(5):
            want = sorted(zip(-cosines[q], keys))[:k]
            assert sorted(zip(got.loc[got["q"] == q, "shown"], got.loc[got["q"] == q, "id"])) == want


def test_a_tile_bounds_what_a_task_holds(monkeypatch):
    """Memory does not grow with the copies of a vector, nor with queries times rows."""
    import tracemalloc

    monkeypatch.setattr(vectors, "TILE", 1 << 16)
    rows, asked = np.ones((20_000, 4)) / 2, np.ones((1024, 4)) / 2
    best = vectors._Best(range(1024), 4, asked.tobytes())
    tracemalloc.start()
    best.offer(list(range(20_000)), ["texto"] * 20_000, rows.tobytes(), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    (found,) = best.result()
    assert len(found) == 3072 and set(found["id"]) == {0, 1, 2}


def test_copies_of_queries_and_rows(spark, monkeypatch):
    """Equal vectors are compared once and every query is answered; all as by brute force."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "SHARD_BYTES", 300)
    rnd = np.random.default_rng(5)
    base = rnd.integers(-2, 3, (30, 3)).astype(float)
    rows = [(i, [float(x) for x in base[i % 30]], ("a", "b", None)[i % 3]) for i in range(300)]
    asked = [(i, [float(x) for x in base[i % 7]]) for i in range(40)] + [(99, None)]
    calls = []
    own = vectors._packed
    monkeypatch.setattr(vectors, "_packed", lambda df, most: calls.append(df.count()) or own(df, most))
    got = vectors.nearest(spark.createDataFrame(asked, "query_id long, query_vector array<double>"), spark.createDataFrame(rows, "id long, embedding array<double>, tipo string"), 4).toPandas()
    assert calls[0] <= 7 and calls[1] <= 30 * 3 * 4
    want = []
    unit = vectors.unit(np.array([r[1] for r in rows]))
    for i, v in asked[:-1]:
        cos = np.round(unit @ vectors.unit(np.array([v]))[0], 9)
        for kind in ("a", "b", None):
            best = sorted((-cos[j], r[0]) for j, r in enumerate(rows) if r[2] == kind)[:4]
            want += [(i, j, kind, n) for n, (_, j) in enumerate(best, 1)]
    assert sorted(((q, i, None if pd.isna(t) else t, n) for q, i, t, n in got[["query_id", "id", "tipo", "rank"]].itertuples(index=False)), key=str) == sorted(want, key=str)


def test_single_precision_spares_all_but_near_rows(monkeypatch):
    """Double precision decides, also between cosines that single precision cannot tell apart, but is spent on few rows."""
    rnd = np.random.default_rng(7)
    rows = vectors.unit(rnd.normal(size=(6000, 16)))
    rows[3000:3600] = vectors.unit(rows[:1] + 1e-4 * rnd.normal(size=(600, 16)))  # cosines to the first query differ from the eighth decimal on
    asked, kinds, k, spent = vectors.unit(np.vstack([rows[:1], rnd.normal(size=(63, 16))])), np.array(["a", None])[np.arange(6000) % 2], 5, []
    tile = vectors._Best._tile
    monkeypatch.setattr(vectors, "TILE", 1 << 14)
    monkeypatch.setattr(vectors._Best, "_tile", staticmethod(lambda low, cosines, *rest: spent.append(cosines.size) or tile(low, cosines, *rest)))
    best = vectors._Best(range(64), 16, asked.tobytes())
    for low in range(0, 6000, 1000):
        ids = [f"{i:04d}" for i in range(low, low + 1000)]
        best.offer(ids, list(kinds[low : low + 1000]), rows[low : low + 1000].tobytes(), k)
    assert sum(spent) < 64 * 6000 / 5
    got = {(q, i, None if pd.isna(t) else t) for part in best.result() for q, i, t in part[["same", "id", "tipo"]].itertuples(index=False)}
    shown = np.round(asked @ rows.T, 9)
    want = {(q, f"{i:04d}", t) for q in range(64) for t in ("a", None) for i in sorted((j for j in range(6000) if kinds[j] == t), key=lambda j: (-shown[q, j], j))[:k]}
    assert got == want


def test_words_are_hashed_once_with_the_same_vectors(monkeypatch):
    import zlib

    calls, crc = [], zlib.crc32
    monkeypatch.setattr(vectors.zlib, "crc32", lambda b: calls.append(b) or crc(b))
    got = vectors.HashingEmbedder(8).embed(["uno dos uno", None, "Dos tres dos dos"])
    want = np.zeros((3, 8))
    for row, words in zip(want, (["uno", "dos", "uno"], [], ["dos", "tres", "dos", "dos"])):
        for w in words:
            h = crc(w.encode())
            row[h % 8] += 1 if h >> 31 else -1
    assert len(calls) == 3 and got.dtype == np.float32
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12), atol=1e-7)
