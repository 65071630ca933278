import time

from conftest import DATA
from pyspark.sql import functions as F

from fichero.plans.catalogue import ORACLE_SQL, QUERIES
from fichero.streaming import sync

TURNS = "session_id string, turn long, product string, reset boolean"


def put(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def run(spark, base, minutes=None):
    stream = spark.readStream.schema(TURNS).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    query = sync.session_products(stream, minutes).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    query = (query.trigger(availableNow=True) if minutes is None else query.trigger(once=True)).start()
    assert query.awaitTermination(120)
    return {(r["session_id"], r["turn"]): r["context"] for r in spark.read.parquet(f"{base}/out").collect()}


def test_products_are_carried_reset_and_forgotten(spark, tmp_path):
    base = str(tmp_path)
    put(spark, [("a", 2, None, False), ("a", 1, "Uretano", False), ("b", 1, "Barniz", None), ("c", 1, None, False)], TURNS, f"{base}/in", "1")
    assert run(spark, base, 0.2) == {("a", 1): None, ("a", 2): "Uretano", ("b", 1): None, ("c", 1): None}
    put(spark, [("a", 3, None, False), ("b", 2, None, True), ("b", 3, None, False), ("c", 2, "Fondo", False), ("c", 3, None, False)], TURNS, f"{base}/in", "2")
    got = run(spark, base, 0.2)
    assert (got["b", 2], got["b", 3], got["c", 3]) == (None, None, "Fondo")
    time.sleep(13)  # more than the lifetime
    put(spark, [("a", 4, None, False), ("c", 4, None, False)], TURNS, f"{base}/in", "3")
    got = run(spark, base, 0.2)
    assert (got["a", 4], got["c", 4]) == (None, None)


def test_products_outlive_a_run(spark, tmp_path):
    base = str(tmp_path)
    for n, (minutes, product) in enumerate(((None, "Uretano"), (None, None))):
        put(spark, [("a", n, product, False)], TURNS, f"{base}/in", str(n))
        got = run(spark, base, minutes)
    assert got == {("a", 0): None, ("a", 1): "Uretano"}


def test_each_key_is_taken_in_once_and_the_target_is_not_read(spark, tmp_path):
    base, schema = str(tmp_path), "doc_id long, source string"
    rows = [(i, "x") for i in range(50)]
    put(spark, rows[:30] + rows[:10], schema, f"{base}/in", "1")

    def taken(log=None):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        sync.sync(stream, f"{base}/out", f"{base}/state", ["doc_id"], log=log).awaitTermination()

    log = sync.MetricsLog("taken", f"{base}/metrics")
    taken(log)
    told = log.write()
    assert (sum(r["rows"] for r in told.collect()), sum(r["keys"] for r in told.collect())) == (30, 30)
    out = lambda: sorted(r["doc_id"] for r in spark.read.parquet(f"{base}/out").collect())
    assert out() == list(range(30))
    for f in (tmp_path / "out").rglob("*.parquet"):  # a run that read the target would take all again
        f.unlink()
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    put(spark, rows[20:], schema, f"{base}/in", "2")  # some have come before
    again = sync.MetricsLog("taken", f"{base}/metrics")
    taken(again)
    again.write()
    assert out() == list(range(30, 50))
    assert sum(r["rows"] for r in spark.read.parquet(f"{base}/metrics").collect()) == 50
    taken()
    assert out() == list(range(30, 50))


def test_keys_are_forgotten_after_the_watermark(spark, tmp_path):
    base, schema = str(tmp_path), "k long, at timestamp"
    row = lambda k, at: (k, F.to_timestamp(F.lit(at)))  # noqa: E731, F841
    frame = lambda rows: spark.createDataFrame(rows, "k long, s string").select("k", F.to_timestamp("s").alias("at"))
    out = []
    for n, rows in enumerate(([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10")], [(2, "2024-01-03 00:00:00")], [(1, "2024-01-03 00:00:01"), (2, "2024-01-03 00:00:02")])):
        frame(rows).coalesce(1).write.parquet(f"{base}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        sync.sync(stream, f"{base}/out", f"{base}/state", ["k"], event_time="at", delay="1 hour").awaitTermination()
        out.append(sorted(r["k"] for r in spark.read.parquet(f"{base}/out").collect()))
    assert out == [[1], [1, 2], [1, 1, 2]]  # the first key was forgotten, the second not


def test_same_as_sql(compare):
    for name in ("streaming_sync", "session_stream"):
        compare(QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.001")
