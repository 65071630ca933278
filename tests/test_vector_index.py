import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from fichero.functions import vectors
from fichero.operators import vector_index
from fichero.operators.vector_index import VectorIndex
from fichero.plans.catalogue import ORACLE_SQL, QUERIES


def hits(frame):
    return sorted((str(r["query_id"]), str(r["id"]), str(r["tipo"]), r["rank"], round(r["similarity"], 6)) for r in frame.collect())


def clustered(spark, n=4000, size=16, middles=40):
    rnd = np.random.default_rng(8)
    middle = rnd.normal(size=(middles, size))
    x = middle[rnd.integers(0, middles, n)] + rnd.normal(scale=0.05, size=(n, size))
    return spark.createDataFrame([(i, v.tolist(), "abc"[i % 3]) for i, v in enumerate(x)], "id long, embedding array<double>, tipo string")


def test_equal_to_a_scan_and_reads_few_cells(spark, tmp_path):
    rows = clustered(spark)
    built = VectorIndex(spark, str(tmp_path / "v")).build(rows, cells=40)
    asked = rows.filter("id % 400 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got, told = built.search(asked, 5)
    assert hits(got) == hits(vectors.nearest(asked, rows, 5))
    told = told.collect()
    assert len(told) == 10 * 3 and all(r["rows"] in (1333, 1334) for r in told)
    assert sum(r["rows_read"] for r in told) < 0.2 * sum(r["rows"] for r in told)
    assert all(1 <= r["cells_read"] <= r["cells"] for r in told)


def test_only_folders_of_wanted_slots_are_read(spark, tmp_path):
    rows = clustered(spark)
    built = VectorIndex(spark, str(tmp_path / "v")).build(rows, cells=40)
    every = built._read("ids array<long>, vectors binary, low double, slot int")
    some = built._read("ids array<long>, vectors binary, low double, slot int", [3, 5])
    assert len(some.inputFiles()) == len(every.inputFiles())  # as listed; the plan prunes
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString() and "slot#" in some._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:200]
    some.collect()
    assert len(set(r[0] for r in some.select(F.input_file_name()).distinct().collect())) < len(every.inputFiles()) / 5


def test_hard_cases(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "t"), (2, None, "t"), (3, [1.0], "t"), (4, [float("nan"), 1.0], "t"), (5, [0.0, 0.0], None), (None, [1.0, 0.0], "t"), (6, [1.0, 0.0], "t"), (6, [1.0, 0.0], "t"), (7, [-1.0, 0.0], "u")], "id long, embedding array<double>, tipo string")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [5.0]), (None, [1.0, 1.0]), ("z", [0.0, 0.0])], "query_id string, query_vector array<double>")
    built = VectorIndex(spark, str(tmp_path / "v"))
    assert not built.exists()
    got, told = built.build(rows, size=2).search(asked, 2)
    assert built.exists()
    of_two = [h for h in hits(vectors.nearest(asked, rows, 2)) if h[0] != "d"]
    assert hits(got) == of_two and {r["query_id"] for r in told.collect()} == {"a", "z"}
    got, told = VectorIndex(spark, str(tmp_path / "e")).build(rows.limit(0)).search(asked, 2)
    assert got.collect() == [] and told.collect() == []
    assert VectorIndex(spark, str(tmp_path / "v")).search(asked.limit(0), 2)[0].collect() == []


def test_ties_and_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PACK_BYTES", 64)
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0], "t") for i in range(200)], "id long, embedding array<float>, tipo string")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.5, 1.0])], "query_id int, query_vector array<double>")
    for cells in (1, 2, 3, 30):
        assert hits(VectorIndex(spark, str(tmp_path / f"v{cells}")).build(rows, cells=cells).search(asked, 70)[0]) == hits(vectors.nearest(asked, rows, 70))


def test_large_queries_meet_written_vectors(spark, monkeypatch):
    rows = clustered(spark, 300)
    asked = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = hits(vectors.nearest(asked, rows, 3))
    monkeypatch.setattr(vectors, "SENT_BYTES", 0)
    assert hits(vectors.nearest(asked, rows, 3)) == want


def test_same_as_sql(compare):
    compare(QUERIES["vector_index_topk"], ORACLE_SQL["vector_index_topk"], f"{DATA}/sf0.001")
