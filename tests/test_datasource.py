import os
import time

from fichero.sources import datasource


def options(reader, base, **more):
    for k, v in {"decoder": "fichero.sources.datasource:text_of", "columns": "text string", "pattern": "*.txt", **more}.items():
        reader = reader.option(k, v)
    return reader.format(datasource.NAME).load(str(base))


def test_read_with_errors_as_rows(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(9):
        (tmp_path / "in" / f"f{i}.txt").write_text(f"text {i} é")
    (tmp_path / "in" / "deep" / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "other.pdf").write_bytes(b"x")
    frame = options(spark.read, tmp_path / "in", partitionBytes="20")
    rows = {r["doc_key"]: r for r in frame.collect()}
    assert set(rows) == {f"f{i}" for i in range(9)} | {"bad"}
    assert rows["f3"]["text"] == "text 3 é" and rows["f3"]["error"] is None and rows["f3"]["changed"] is not None
    assert rows["bad"]["text"] is None and rows["bad"]["error"].startswith("UnicodeDecodeError")
    assert frame.rdd.getNumPartitions() > 2
    assert options(spark.read, tmp_path / "none").collect() == []


def test_stream_takes_what_comes_and_changes(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()

    def put(name, text, at):
        (tmp_path / "in" / name).write_text(text)
        os.utime(tmp_path / "in" / name, (at, at))

    def run():
        stream = options(spark.readStream, tmp_path / "in").select("doc_key", "text")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    now = time.time()
    put("a.txt", "a1", now - 100)
    put("b.txt", "b1", now - 90)
    assert run() == ["a1", "b1"]
    assert run() == ["a1", "b1"]
    put("a.txt", "a2", now - 80)
    put("c.txt", "c1", now - 70)
    assert run() == ["a1", "a2", "b1", "c1"]
