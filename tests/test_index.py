from pyspark.sql import functions as F

from fichero.functions import vectors
from fichero.operators.index import Index
from fichero.operators.retrieval import retrieve
from fichero.plans.sheets import _chunked
from conftest import DATA

FOLDER = f"{DATA}/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lookup_reads_one_bucket(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    chunks = _chunked(spark, FOLDER)
    index.ingest(chunks)
    some = chunks.orderBy("id").first()["id"]
    own = index._rows().filter(F.col("id") == some).select(F.input_file_name()).first()[0]
    others = [f for f in (tmp_path / "i").rglob("part-*.parquet") if not own.endswith(f.name)]
    assert len(others) > 4
    for f in others:  # a file that is opened now breaks the query
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert index.get(some).count() == 1


def test_versions_and_ingestion_do_not_shuffle_the_index(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = Index(spark, str(tmp_path / "i"))
        chunks = _chunked(spark, FOLDER)
        index.ingest(chunks)
        index.ingest(chunks.withColumn("content", F.concat("content", F.lit("!"))))
        assert "Exchange" not in plan(index.chunks())
        held = index._latest(index._rows().select("id", "content_hash", "version"))
        marked = plan(index._new(index._given(chunks), held, index._generation()))
        assert marked.count("Exchange hashpartitioning") == 1  # of the chunks that come
        assert index.chunks().count() == chunks.count() and index.chunks().filter("content like '%!'").count() == chunks.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_session_sees_the_same_index(spark, tmp_path):
    Index(spark, str(tmp_path / "i"), buckets=3).ingest(_chunked(spark, FOLDER))
    other = Index(spark.newSession(), str(tmp_path / "i"))
    assert other.chunks().count() == _chunked(spark, FOLDER).count()


def test_replace_is_one_step_and_keeps_the_last_generation(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    chunks = _chunked(spark, FOLDER)
    index.ingest(chunks)
    reader = index.chunks()
    n = reader.count()
    own = chunks.filter("doc_key = '2'").withColumn("content", F.lit("new"))
    told = index.replace(spark.createDataFrame([("2",)], "doc_key string"), own)
    assert sum(r["count"] for r in told.collect()) == own.count() and {r["status"] for r in told.collect()} == {"added"}
    assert index.chunks().count() == n and index.chunks().filter("content = 'new'").count() == own.count()
    assert reader.count() == n  # a reader that began before still finds its files
    index.forget(spark.createDataFrame([("2",)], "doc_key string"))
    assert index.chunks().count() == n - own.count()
    assert len([p for p in (tmp_path / "i").iterdir() if p.name.startswith("generation-")]) == 2


def test_search_by_the_inverted_file(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    chunks = _chunked(spark, FOLDER)
    index.ingest(chunks)
    asked = chunks.orderBy("id").limit(3).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), F.lit(None).cast("string").alias("product"))
    rows = lambda f: sorted((r["query_id"], r["position"], r["id"], round(r["similarity"], 6)) for r in f.collect())
    want = rows(retrieve(asked, index.chunks(), 4, 6))
    assert index.vectors() is None and rows(retrieve(asked, index.chunks(), 4, 6, search=index.nearest)) == want
    index.build_vectors()
    assert index.vectors() is not None and rows(retrieve(asked, index.chunks(), 4, 6, search=index.nearest)) == want
    index.ingest(chunks.limit(1).withColumn("id", F.lit("z")).withColumn("embedding", vectors.embed("content", vectors.HashingEmbedder(64))))
    assert index.vectors() is None  # not of these chunks any more
