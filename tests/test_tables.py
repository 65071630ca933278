import random

import pytest
from conftest import DATA

from fichero.operators import tables
from fichero.plans.catalogue import ORACLE_SQL, QUERIES

SCHEMA = "doc_key string, table_no int, row_no int, col_no int, col_name string, value string"


def raw(n, seed):
    rnd = random.Random(seed)
    words = [None, None, "", " - ", "nan", "ADR", "ADR", " 3\n b ", "77", "12", "1,5", "Sección 4", "SECCIÓN 14: x", "Clase", "Col_0", "0", "a  b", "null"]
    out = []
    for t in range(n):
        rows, columns = rnd.randrange(1, 8), rnd.randrange(1, 6)
        start, step = rnd.randrange(3), rnd.randrange(1, 3)
        dull = rnd.choice([words, words[:5], words[5:], [None]])
        for r in range(rows):
            for c in range(columns):
                if rnd.random() < 0.95:  # ragged, too
                    out.append((rnd.choice(["a", "b"]) if t < 2 else f"d{t}", t, start + r * step, start + c * step, rnd.choice([str(c), "x", ""]), rnd.choice(dull if r else words)))
    return out


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_one_pass_equals_windows(spark):
    cells = spark.createDataFrame(raw(400, 6), SCHEMA).repartition(5)
    want = tables._clean_by_windows(cells, 0.1, 0.6)
    assert want.count() > 1000
    assert same(tables.clean_tables(cells), want)
    assert same(tables.clean_tables(cells, large=12), want)  # most go by windows
    assert same(tables.clean_tables(cells, sparse=0.6, header=0.9), tables._clean_by_windows(cells, 0.6, 0.9))


def test_tables_that_span_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cells = spark.createDataFrame(raw(60, 9), SCHEMA)
        assert same(tables.clean_tables(cells), tables._clean_by_windows(cells, 0.1, 0.6))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_exchange_and_empty(spark):
    cells = spark.createDataFrame(raw(5, 1), SCHEMA).repartition(2).cache()
    plan = tables.clean_tables(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 1
    cells.unpersist()
    assert tables.clean_tables(cells.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["table_long_clean", "table_repeated_names", "table_shapes", "table_validation"])
def test_same_as_sql(name, compare):
    compare(QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", ["table_long_clean", "table_to_text", "table_shapes", "table_validation"])
def test_customers_of_many_orders_with_hardly_a_status(name, spark, tmp_path):
    import duckdb

    status = {1: ["F"] * 40, 2: ["F"] * 18 + ["O"], 3: ["F"] * 9, 4: ["O", "F", "P"] * 11, 5: ["F"]}
    rows = [(100 * c + i, c, s, None if i == 2 else f"{i % 5}-LOW") for c, all_ in status.items() for i, s in enumerate(all_)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_validation_folds_once_and_joins_nothing(spark):
    plan = QUERIES["table_validation"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Expand" not in plan


def test_arrow_groups_are_whole():
    import pyarrow as pa

    from fichero.functions.groups import whole_groups

    keys = [None, None, "a", "b", "b", "b", "b", "b", "c", None]
    batches = pa.table({"k": pa.array(keys, pa.string()), "i": range(10)}).to_batches(max_chunksize=2)
    for together in (1, 3, 100):
        parts = [t["k"].to_pylist() for t in whole_groups(iter(batches), ["k"], together)]
        assert sum(parts, []) == keys
        assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
    assert list(whole_groups(iter([]), ["k"])) == []
