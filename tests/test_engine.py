import difflib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from fichero import fixed
from fichero.config import EngineConfig
from fichero.functions import vectors
from fichero.functions.fuzzy import ratio
from fichero.operators import analysis, conversation, incremental, retrieval, sections, tables
from fichero.plans.engine import Engine, find_documents
from fichero.sources import files, sinks

TURNS = [
    ("Cuales son los componentes peligrosos del esmalte epoxico?", "peligros", "Epóxico"),
    ("Y sus peligros?", "peligros", "Epóxico"),
    ("Dame sus precauciones", "proteccion", "Epóxico"),
    ("Que componentes tiene?", "componentes", "Epóxico"),
    ("Y es inflamable?", "peligros", "Epóxico"),
    ("Que peligros tiene el esmalte uretano?", "peligros", "Uretano"),
    ("Que componentes tiene el esmalte alquidico?", "componentes", "Alquídico"),
    ("Que precauciones tiene la pintura texturizada?", "proteccion", "Texturizada"),
]


def requests(spark, texts, session="s"):
    return spark.createDataFrame([(f"{session}{i}", session, i, t, True) for i, t in enumerate(texts)], "query_id string, session_id string, turn long, text string, use_context boolean")


def test_conversation(spark):
    got = conversation.understood(requests(spark, [t for t, _, _ in TURNS])).orderBy("turn").collect()
    assert [(r["query_type"], r["product"]) for r in got] == [(a, b) for _, a, b in TURNS]
    assert got[1]["question"] == "Y sus peligros? Epóxico" and got[5]["question"] == TURNS[5][0]


def test_fuzzy(spark):
    asked = requests(spark, ["la protección", "algo peligrs", "nada de nada", None, "el esmalte uretanno"])
    types = {r["query_id"]: r["query_type"] for r in analysis.query_type(asked).collect()}
    assert (types["s0"], types["s1"], types["s3"]) == ("proteccion", "peligros", None)
    products = {r["query_id"]: r["product"] for r in analysis.product(asked).collect()}
    assert products["s4"] == "Uretano" and products["s2"] is None
    got = spark.createDataFrame([("abcd", "abxd"), ("casa", "cosas"), (None, "x")], "a string, b string").select(ratio("a", "b").alias("r")).collect()
    want = [difflib.SequenceMatcher(None, b, a).ratio() for a, b in (("abcd", "abxd"), ("casa", "cosas"))]
    assert [r["r"] for r in got] == [*want, None]


def test_reset(spark):
    turns = spark.createDataFrame([("s", 1, "a", False), ("s", 2, None, False), ("s", 3, None, True), ("s", 4, None, None)], "session_id string, turn long, product string, reset boolean")
    got = conversation.carried(turns, "product", reset="reset").orderBy("turn").collect()
    assert [r["context"] for r in got] == [None, "a", None, None]


def test_tables(spark):
    raw = [["SECCIÓN 14: x", None, None, None], [None, "ADR", "ADR", None], ["Clase", " 3\n b ", "-", None], ["77", "x", "y", None], ["Grupo", "III", "nan", None], [None, None, None, None]]
    cells = spark.createDataFrame([("d", 0, r, c, str(c), v) for r, row in enumerate(raw) for c, v in enumerate(row)], "doc_key string, table_no int, row_no int, col_no int, col_name string, value string")
    got = tables.clean_tables(cells)
    rows = {(r["row_no"], r["col_name"]): r["value"] for r in got.collect()}
    assert rows == {(0, "Concepto"): "Clase", (0, "ADR"): "3 b", (0, "ADR_1"): None, (1, "Concepto"): "Grupo", (1, "ADR"): "III", (1, "ADR_1"): None}
    two = got.unionByName(got.withColumn("table_no", F.lit(1)))
    assert [r["table_no"] for r in tables.distinct_tables(two).select("table_no").distinct().collect()] == [0]
    text = tables.to_text(got).first()["text"]
    assert text.startswith("Tabla con 2 filas y ") and "Concepto: Clase | ADR: 3 b" in text
    assert tables.clean_tables(cells.limit(0)).count() == 0


def test_retrieval_rules(spark):
    hits = spark.createDataFrame([("q", "a", "texto", 0.5, 1), ("q", "b", "imagen", 0.45, 1), ("q", "c", "tabla", 0.54, 1), ("q", "d", "imagen", -0.1, 2)], "query_id string, id string, tipo string, similarity double, rank int")
    got = retrieval.finish(hits, 4).orderBy("position").collect()
    assert [r["id"] for r in got] == ["c", "b", "a", "d"]  # equal once boosted: kinds in order
    assert got[-1]["similarity"] == pytest.approx(-0.12)
    name = lambda p, w, fold=False: spark.range(1).select(retrieval.product_matches(F.lit(p), F.lit(w), fold).alias("x")).first()["x"]
    assert name("Esmalte EPÓXICO", "Epóxico") and not name("Epoxi 100", "Epóxico") and name("Epoxico 100", "Epóxico", True)
    assert name(None, None) and not name(None, "x")


def test_nearest_is_exact(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.lit("t").alias("tipo"))
    asked = rows.filter("id < 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = vectors.nearest(asked, rows, 4).collect()
    pairs = asked.crossJoin(rows).select("query_id", "id", vectors.cosine("query_vector", "embedding").alias("s")).collect()
    for q in range(3):
        want = sorted(((-round(r["s"], 9), r["id"]) for r in pairs if r["query_id"] == q))[:4]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in want]
    assert vectors.nearest(asked.limit(0), rows, 4).count() == 0


def test_changes(spark):
    now = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], "name string, hash string, size long")
    then = spark.createDataFrame([("a", "1", 1), ("b", "x", 1), ("z", "9", 1)], "name string, hash string, size long")
    changed = incremental.changes(now, then)
    assert {r["name"]: r["status"] for r in changed.collect()} == {"a": "same", "b": "modified", "c": "new", "z": "deleted"}
    assert {r["name"] for r in incremental.work_list(changed).collect()} == {"b", "c"}


SHEET = "Fecha de emisión: 05.03.2021\nCódigo: {code}\nNombre del producto\n{name}\nFabricante\nFábrica Ejemplo\nSECCIÓN 1: Identificación\n{fill}\nSECCIÓN 2: Peligros\nH226 Arde.\nH411 Mata peces.\nP210 Lejos del calor.\n{fill}\nSECCIÓN 3: Composición\nXileno CAS: 1330-20-7 10% - 20%\n{fill}"


def test_engine(spark, tmp_path):
    config = EngineConfig(str(tmp_path))
    engine = Engine(spark, config, vectors.HashingEmbedder(64))
    assert "index" in config.missing(spark)
    config.create(spark)
    config.drop(spark, "index", confirm=True)
    for k, name in (("1", "Esmalte Uretano Azul"), ("2", "Pintura Texturizada Roja")):
        (tmp_path / "gold/texts" / f"F {k}_texto_limpio.txt").write_text(SHEET.format(code=k, name=name, fill=f"palabras de {name} " * 6))
    (tmp_path / "gold/tables/F 1_tabla_0.csv").write_text("Concepto,ADR\nClase,3\nGrupo,\n")
    (tmp_path / "bronze" / "F 1.pdf").write_bytes(b"x")
    assert [(r["name"], r["status"]) for r in engine.sync().collect()] == [("F 1.pdf", "new")]
    engine.commit()
    assert [r["status"] for r in engine.sync().collect()] == ["same"]

    docs = engine.extract()
    assert {r["doc_key"] for r in docs.collect()} == {"F 1", "F 2"}
    cells = files.tables_csv(spark, config.path("gold_tables"))
    chunks = engine.chunk(docs, cells)
    assert {(r["tipo_contenido"], r["status"]): r["count"] for r in engine.ingest(chunks).collect()} == {("texto", "added"): 6, ("tabla", "added"): 1}
    assert {(r["tipo_contenido"], r["status"]): r["count"] for r in engine.ingest(chunks).collect()} == {("texto", "skipped"): 6, ("tabla", "skipped"): 1}
    assert engine.index.chunks().count() == 7 and engine.index.verify().first()["dim"] == 64
    some = engine.index.sample(1).first()["id"]
    assert engine.index.get(some).count() == 1 and engine.index.get("none").count() == 0
    assert engine.index.where_section(fixed.SECTIONS[2]).count() == 2
    table = engine.index.chunks().filter("tipo_contenido = 'tabla'").first()
    assert table["content"].startswith("Tabla con 2 filas y 2 columnas\nColumnas: Concepto, ADR\n\nConcepto: Clase | ADR: 3")
    profile = engine.profile()
    assert profile["totals"].filter("tipo_contenido is null").first()["count"] == 7
    assert profile["coverage"].filter("producto = 'Esmalte Uretano Azul' and tipo_contenido = 'texto'").first()["missing"] == ["controles_exposicion_proteccion", "primeros_auxilios"]

    out = {r["query_id"]: r for r in engine.chat(requests(spark, ["Que peligros tiene el esmalte uretano?", "Que componentes tiene?", "peligros de sikawall"]), log=True).collect()}
    first, second, third = (out[f"s{i}"] for i in range(3))
    assert first["product"] == second["product"] == "Uretano" and first["fds_reference"]["codigo"] == "1"
    assert [c["codigo"] for c in first["structured_metadata"]["codigos_h"]] == ["H226", "H411"]
    assert first["structured_metadata"]["codigos_h"][1]["descripcion"] == fixed.NO_DESCRIPTION
    assert [c["cas"] for c in second["structured_metadata"]["componentes_cas"]] == ["1330-20-7"]
    assert {s["producto"] for s in first["sources"]} == {"Esmalte Uretano Azul"} and first["sources"][0]["content_preview"].endswith("...")
    assert third["answer"] == fixed.NO_TEXT_ANSWER and third["metrics"]["total_chunks"] == 0 and third["sources"] == []
    assert spark.read.parquet(config.path("metrics")).count() == 3
    assert '"session_id":"s"' in sinks.response_json(engine.chat(requests(spark, ["hola"]))).first()["json"]

    engine.index.forget(spark.createDataFrame([("1",)], "codigo_producto string"))
    assert {r["codigo"] for r in engine.index.chunks().select(F.col("metadata.codigo_producto").alias("codigo")).distinct().collect()} == {"2"}


def test_vectors_that_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "t"), (2, None, "t"), (3, [1.0], "t"), (4, [float("nan"), 1.0], "t"), (5, [0.0, 0.0], None), (None, [1.0, 0.0], "t")], "id long, embedding array<double>, tipo string")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [5.0]), (None, [1.0, 1.0])], "query_id string, query_vector array<double>")
    got = sorted((r["query_id"], r["id"], r["tipo"], round(r["similarity"], 6), r["rank"]) for r in vectors.nearest(asked, rows, 2).collect())
    assert got == [("a", 1, "t", 1.0, 1), ("a", 5, None, 0.0, 1), ("d", 3, "t", 1.0, 1)]


def test_versions_and_retrieval(spark, tmp_path):
    engine = Engine(spark, EngineConfig(str(tmp_path)), vectors.HashingEmbedder(32))
    engine.config.create(spark)
    docs = sections.extract(spark.createDataFrame([("F 1", SHEET.format(code="1", name="Esmalte Uretano Azul", fill="palabras de la hoja " * 8))], "doc_key string, text string"))
    chunks = engine.chunk(docs)
    engine.ingest(chunks)
    again = chunks.withColumn("content", F.concat("content", F.lit(" mas"))).withColumn("embedding", vectors.embed("content", engine.embedder))
    for told in ("added", "skipped"):
        assert [r["status"] for r in engine.ingest(again).collect()] == [told]
    out = engine.chat(requests(spark, ["Que peligros tiene el esmalte uretano?"])).first()
    assert len(out["sources"]) == engine.index.chunks().count() == 3 and len({s["chunk_id"] for s in out["sources"]}) == 3
    assert engine.index.chunks().filter("not content like '% mas'").isEmpty()
    engine.ingest(chunks)  # back to what it was: a later version still
    assert engine.index.chunks().filter("content like '% mas'").isEmpty() and engine.index.get(engine.index.sample(1).first()["id"]).count() == 1
    engine.check()


def test_index_survives_a_failure_while_forgetting(spark, tmp_path, monkeypatch):
    engine = Engine(spark, EngineConfig(str(tmp_path)), vectors.HashingEmbedder(8))
    docs = sections.extract(spark.createDataFrame([(f"F {k}", SHEET.format(code=k, name="Nombre", fill="palabras de la hoja " * 8)) for k in (1, 2)], "doc_key string, text string"))
    engine.ingest(engine.chunk(docs))
    before = sorted(r["id"] for r in engine.index.ids().collect())

    def fails(*_):
        raise OSError("no space")

    monkeypatch.setattr(sinks, "write_word", fails)
    with pytest.raises(OSError):
        engine.index.forget(spark.createDataFrame([("F 1",)], "doc_key string"))
    assert sorted(r["id"] for r in engine.index.ids().collect()) == before
    monkeypatch.undo()
    engine.index.forget(spark.createDataFrame([("F 1",)], "doc_key string"))
    assert engine.index.chunks().count() == 3 and engine.index.chunks().filter("doc_key = 'F 1'").isEmpty()


def test_decoding(spark, tmp_path):
    engine = Engine(spark, EngineConfig(str(tmp_path)), vectors.HashingEmbedder(8))
    engine.config.create(spark)
    for k, text in (("a", "Código: 7\n1;x\n2;y"), ("b", "nothing"), ("bad", "!")):
        (tmp_path / "bronze" / f"{k}.pdf").write_bytes(text.encode())

    def text_of(content):
        if content == b"!":
            raise ValueError("no sheet")
        yield (content.decode(),)

    def cells_of(content):
        for r, line in enumerate(x for x in content.decode().split("\n") if ";" in x):
            yield from ((0, r, c, str(c), f"{'v' if c else 'n'} {v}") for c, v in enumerate(line.split(";")))

    def always(content):
        yield from ((5, r, c, str(c), f"f {r} {c}") for r in range(3) for c in range(2))

    out = engine.decode({"text": text_of, "tables": [cells_of], "fallback": always, "images": lambda c: iter([(1, 1, "png", b"x")])})
    assert {r["doc_key"] for r in out["texts"].collect()} == {"a", "b"} and {(r["doc_key"], r["error"]) for r in out["errors"].collect()} == {("bad", "ValueError: no sheet")}
    assert {(r["doc_key"], r["table_no"]) for r in out["cells"].collect()} <= {("a", 0), ("b", 5), ("bad", 5)} and ("b", 5) in {(r["doc_key"], r["table_no"]) for r in out["cells"].collect()}
    assert out["images"].count() == 3 and spark.read.parquet(engine.config.path("gold_texts", "decoded")).count() == 2


def test_requests_without_and_with_repeated_ids(spark):
    rows = [("a", "s", 1, "peligros del uretano", True), ("a", "s", 1, "peligros del uretano", True), (None, "s", 2, "x", True), ("b", "s", 3, None, None)]
    got = conversation.understood(spark.createDataFrame(rows, "query_id string, session_id string, turn long, text string, use_context boolean")).collect()
    assert sorted((r["query_id"], r["product"]) for r in got) == [("a", "Uretano"), ("b", "Uretano")]


def test_find_documents(spark):
    listing = spark.createDataFrame([("FDS 21 - Esmalte",), ("Otro",), ("Pintura esm",)], "stem string")
    assert [r["stem"] for r in find_documents(listing, "esmalte%20azul").collect()] == ["FDS 21 - Esmalte"]
    assert find_documents(listing, "xyz").count() == 0


def test_sources(spark, tmp_path):
    docs = sections.extract(spark.createDataFrame([("a b", SHEET.format(code="7", name="Nombre", fill="x " * 40))], "doc_key string, text string"))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a b_metadata.json").write_text(docs.drop("doc_key").toJSON().first())
    back = files.metadata_json(spark, str(tmp_path / "m")).first()
    assert back["doc_key"] == "a b" and back["metadata"]["codigo"] == "7" and len(back["metadata"]["secciones"]) == 3
    found = files.decoded(spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b""))], "doc_key string, content binary"), lambda c: iter([(len(c) // (len(c) > 0),)]), "n int")
    assert {r["doc_key"]: (r["n"], r["error"] is None) for r in found.collect()} == {"a": (2, True), "b": (None, False)}
    listing = files.listing(spark, str(tmp_path / "m"))
    assert listing.first()["name"] == "a b_metadata.json"
    assert files.related(spark.createDataFrame([("a b_p1_img2.jpg", "p"), ("z_p1_img1.png", "q")], "name string, path string"), docs, files.IMAGE_FILE).first()["doc_key"] == "a b"
    none, one = docs.select("doc_key").limit(0), docs.select("doc_key")
    assert files.first_yield(one, [none, none], one).count() == 1 and files.first_yield(one, [one], one).count() == 1
    assert files.folder_counts(spark, str(tmp_path / "m")).first()["files"] == 1


def test_session_stream(spark, tmp_path):
    from fichero.streaming import sync

    schema = "session_id string, turn long, product string, reset boolean"
    spark.createDataFrame([("a", 1, "Uretano", False), ("a", 2, None, False), ("b", 1, None, False), ("a", 3, None, True)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = sync.session_products(stream).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["session_id"], r["turn"]): r["context"] for r in spark.table("carried").collect()}
    assert got == {("a", 1): None, ("a", 2): "Uretano", ("a", 3): None, ("b", 1): None}
