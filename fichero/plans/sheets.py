"""Queries over sheets: texts in the form of the domain, made from the table `part`, whose fields the SQL knows from its columns.

They run the extraction, the chunks, the index and its jobs as the engine does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fixed
from ..config import EngineConfig
from ..functions import codes, vectors
from ..functions import text as T
from ..operators import answer, chunking, conversation, metadata, profile, retrieval, sections, tables
from ..operators.index import Index
from ..schemas import CHUNK_METADATA
from ..shared import scratch_path, settled
from ..sources import sinks
from .catalogue import query, table
from .engine import Engine

_H = ["H225", "H226", "H304", "H315", "H317", "H319", "H335", "H336", "H373", "H412"]
_FILL = "Texto que sigue en esta parte de la hoja. "
#: Sections 2, 3 and 9 and the whole text, as SQL that both engines read (pipes join texts).
_S2 = f"'Peligros' || chr(10) || h1 || ' Arde con ' || p_name || '.' || chr(10) || h2 || ' Mata peces.' || chr(10) || 'P210 Lejos del calor.' || chr(10) || 'P301 + P310 Llamar al centro.' || chr(10) || '{_FILL.strip()}'"
_S3 = f"'Componentes' || chr(10) || 'Xileno ' || p_name || ' CAS: 1330-20-' || CAST(p_partkey % 10 AS VARCHAR(9)) || ' 10% - 20%' || chr(10) || 'Resina CAS: 25068-38-6' || chr(10) || '{(_FILL * 2).strip()}'"
_S9 = f"'Propiedades' || chr(10) || 'Estado físico: ' || p_type || chr(10) || 'Color: ' || p_brand || chr(10) || 'pH: 7.5' || chr(10) || 'Punto de inflamación: ' || CAST(p_partkey % 50 AS VARCHAR(9)) || ' C' || chr(10) || 'Densidad: 1.2 g/cm3' || chr(10) || '{_FILL.strip()}'"
_HEAD = "'Fecha de emisión: ' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR(9)), 2, '0') || '.03.2021' || chr(10) || 'Código: C' || CAST(p_partkey AS VARCHAR(19)) || chr(10) || 'Nombre del producto' || chr(10) || p_name || chr(10) || 'Fabricante' || chr(10) || p_brand || ' S.A.' || chr(10) || 'Uso del producto: pintura ' || p_type || chr(10)"
_TEXT = f"{_HEAD} || 'SECCIÓN 2: ' || {_S2} || chr(10) || 'SECCIÓN 3: ' || {_S3} || chr(10) || 'SECCIÓN 9: ' || {_S9}"
_CODES = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_H)) + " END AS h1, CASE WHEN p_partkey % 3 = 0 THEN 'H999' ELSE 'H411' END AS h2"
_PARTS = f"WITH x AS (SELECT *, {_CODES} FROM part), s AS (SELECT *, {_S2} AS s2, {_S3} AS s3, {_S9} AS s9 FROM x)"


def _sheets(spark, folder) -> DataFrame:
    # one small file makes much work: all cores take part
    parts = table(spark, folder, "part").repartition(spark.sparkContext.defaultParallelism)
    return parts.selectExpr("*", *_CODES.split(", ")).select(F.col("p_partkey").cast("string").alias("doc_key"), F.expr(_TEXT).alias("text"))


def _documents(spark, folder) -> DataFrame:
    return sections.extract(_sheets(spark, folder))


def _fields(spark, folder) -> DataFrame:
    return sections.fields(_sheets(spark, folder))


def _joined(items, *fields: str) -> F.Column:
    """A list of structs as one text."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws("=", *[x[f] for f in fields])), "|")


# ---------------------------------------------------------------------- extraction

@query(f"""{_PARTS} SELECT CAST(p_partkey AS VARCHAR) AS doc_key, p_name AS nombre, p_brand || ' S.A.' AS proveedor, 'C' || p_partkey AS codigo, lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || '.03.2021' AS fecha,
'2021-03-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS dia, 'pintura ' || p_type AS uso, p_type AS estado, p_brand AS color, '7.5' AS ph, (p_partkey % 50) || ' C' AS punto, '1.2 g/cm3' AS densidad FROM s""")
def sheet_fields(spark, folder):
    """Name, maker, code, date, use and physical properties of every sheet."""
    p = F.col("propiedades_fisicoquimicas")
    return _fields(spark, folder).select("doc_key", F.col("nombre_producto").alias("nombre"), F.col("proveedor").alias("proveedor"), F.col("codigo").alias("codigo"), F.col("fecha_emision").alias("fecha"), T.parsed_date(F.col("fecha_emision")).cast("string").alias("dia"), F.col("uso_producto").alias("uso"), p["estado_fisico"].alias("estado"), p["color"].alias("color"), p["ph"].alias("ph"), p["punto_inflamacion"].alias("punto"), p["densidad"].alias("densidad"))


@query(f"""{_PARTS} SELECT CAST(p_partkey AS VARCHAR) AS doc_key, CASE WHEN h1 < h2 THEN h1 || ',' || h2 ELSE h2 || ',' || h1 END AS h, 'P210,P301 + P310' AS p,
CASE WHEN h1 < h2 THEN h1 || '=Arde con ' || p_name || '.|' || h2 || '=Mata peces.' ELSE h2 || '=Mata peces.|' || h1 || '=Arde con ' || p_name || '.' END AS h_detalle, 'P210=Lejos del calor.|P301 + P310=Llamar al centro.' AS p_detalle FROM s""")
def sheet_codes(spark, folder):
    """Hazard and precaution codes of every sheet, combinations included, and what the sheet says of each."""
    return _fields(spark, folder).select("doc_key", F.array_join(F.col("indicaciones_peligro"), ",").alias("h"), F.array_join(F.col("frases_precaucion"), ",").alias("p"), _joined(F.col("indicaciones_peligro_detalle"), "codigo", "descripcion").alias("h_detalle"), _joined(F.col("frases_precaucion_detalle"), "codigo", "descripcion").alias("p_detalle"))


@query(f"{_PARTS} SELECT CAST(p_partkey AS VARCHAR) AS doc_key, 'Xileno ' || p_name || '=1330-20-' || (p_partkey % 10) || '=10% - 20%|Resina=25068-38-6' AS componentes FROM s")
def sheet_components(spark, folder):
    """Components of every sheet with CAS number and concentration."""
    return _fields(spark, folder).select("doc_key", _joined(F.col("componentes_quimicos"), "nombre", "cas", "concentracion").alias("componentes"))


@query(f"""{_PARTS}, c AS (SELECT p_partkey, unnest([0, 1, 2]) AS i, unnest(['identificacion_peligros', 'composicion_componentes', 'propiedades_fisicas_quimicas']) AS seccion, unnest([s2, s3, s9]) AS body, p_name FROM s),
d AS (SELECT *, 'Documento: ' || p_name || chr(10) || 'Sección: ' || seccion || chr(10) || chr(10) || body AS content FROM c)
SELECT CAST(p_partkey AS VARCHAR) AS doc_key, printf('C%d_chunk_%03d_%s', p_partkey, i, substr(md5(content), 1, 8)) AS id, CAST(i AS INTEGER) AS chunk_index, 1 AS total_chunks, seccion, 'texto' AS tipo, CAST(length(content) AS INTEGER) AS char_count, CAST(length(content) // 4 AS INTEGER) AS token_count FROM d""")
def sheet_chunks(spark, folder):
    """Chunks of every sheet's sections, headed by product and section."""
    m = F.col("metadata")
    return chunking.build(_documents(spark, folder)).select("doc_key", "id", m["chunk_index"].alias("chunk_index"), m["total_chunks"].alias("total_chunks"), m["seccion"].alias("seccion"), m["tipo_contenido"].alias("tipo"), m["char_count"].alias("char_count"), m["token_count"].alias("token_count"))


@query(f"{_PARTS} SELECT CAST(p_partkey AS VARCHAR) AS doc_key, '{{\"codigo\":\"P210\",\"descripcion\":\"Lejos del calor.\"}},{{\"codigo\":\"P301 + P310\",\"descripcion\":\"Llamar al centro.\"}}' AS codigos_p, '' AS imagen, count(*) AS n FROM s, range(3) GROUP BY p_partkey")
def chunk_flattened(spark, folder):
    """Metadata of chunks as text and numbers only."""
    m = F.col("metadata")
    flat = sinks.flattened(chunking.build(_documents(spark, folder)))
    return flat.groupBy("doc_key", m["codigos_p"].alias("codigos_p"), m["imagen_nombre"].alias("imagen")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- codes as text

@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'P210:Mantener alejado de fuentes de ignición|P310:Descripción no disponible' WHEN 1 THEN 'P280:Llevar guantes/ropa/gafas de protección' WHEN 2 THEN 'P501:Eliminar el contenido/recipiente según normativa|P999:Descripción no disponible' ELSE 'P403:Almacenar en un lugar bien ventilado' END AS codes FROM events")
def precautions_parse(spark, folder):
    """Precaution codes as plain text with combinations, dictionaries, JSON and broken JSON."""
    given = F.element_at(F.array(F.lit("P210+P310"), F.lit("{'codigo': 'P280'}"), F.lit('[{"codigo": "P501"}, {"codigo": "P999"}]'), F.lit("[{broken P403 P403")), (F.col("event_id") % 4 + 1).cast("int"))
    found = F.transform(codes.parse_precautions(given), lambda c: F.concat_ws(":", c["codigo"], c["descripcion"]))
    return table(spark, folder, "events").select("event_id", F.array_join(found, "|").alias("codes"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Xileno=1330-20-7=10%' WHEN 1 THEN 'Resina=25068-38-6=No especificada|Agua=7732-18-5=5%' ELSE '' END AS components FROM events")
def components_parse(spark, folder):
    """Components as dictionaries and JSON; entries without name or CAS, and broken lists, give none."""
    given = F.element_at(F.array(F.lit("{'nombre': 'Xileno', 'cas': '1330-20-7', 'concentracion': '10%'}"), F.lit('[{"nombre": "Resina", "cas": "25068-38-6"}, {"nombre": "Agua", "cas": "7732-18-5", "concentracion": "5%"}]'), F.lit("[{'nombre': 'Sin cas'}]"), F.lit("[{broken")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", _joined(codes.parse_components(given), "nombre", "cas", "concentracion").alias("components"))


def _asked(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Hits of queries by page: two to three chunks each, with codes and components; and the queries' types."""
    pages = table(spark, folder, "pages")
    code = lambda c, d: F.struct(F.lit(c).alias("codigo"), F.lit(d).alias("descripcion"))
    part = lambda n, c, a: F.struct(F.lit(n).alias("nombre"), F.lit(c).alias("cas"), F.lit(a).cast("string").alias("concentracion"))
    lists = [(F.array(code("H226", "own"), code("H999", "own")), F.array(code("P501", "a"), code("P210", "b")), F.array(part("Xileno", "1330-20-7", None), part("Agua", "7732-18-5", "5%"))), (F.array(code("H225", "own"), code("H226", "later")), F.array(code("P210", "c"), code("P301 + P310", "d")), F.array(part("Xilol", "1330-20-7", "9%"), part("Aire", "0-0-0", "1%")))]
    each = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.struct(h.alias("codigos_h"), p.alias("codigos_p"), c.alias("componentes_cas")).alias("metadata")) for i, (h, p, c) in enumerate(lists)])
    hits = pages.select(F.col("page_id").alias("query_id"), F.explode(each).alias("x")).select("query_id", "x.*")
    kinds = F.array(*[F.lit(k) for k in ("peligros", "proteccion", "componentes", "propiedades", "precauciones")])
    return hits, pages.select(F.col("page_id").alias("query_id"), F.get(kinds, (F.col("page_id") % 6).cast("int")).alias("query_type"))


@query(f"""SELECT page_id AS query_id, CASE page_id % 6 WHEN 0 THEN 'H225={fixed.HAZARDS["H225"]}|H226={fixed.HAZARDS["H226"]}|H999={fixed.NO_DESCRIPTION}' ELSE '' END AS h,
CASE WHEN page_id % 6 IN (1, 4) THEN 'P210={fixed.PRECAUTIONS["P210"]}|P301 + P310={fixed.NO_DESCRIPTION}|P501={fixed.PRECAUTIONS["P501"]}' ELSE '' END AS p,
CASE page_id % 6 WHEN 2 THEN 'Agua=7732-18-5=5%|Aire=0-0-0=1%|Xileno=1330-20-7=No especificada' ELSE '' END AS c, CASE WHEN page_id % 6 IN (0, 1, 2, 4) THEN 2 ELSE 0 END AS n FROM pages""")
def structured_metadata(spark, folder):
    """The field that a query's type asks for: codes with the descriptions of the fixed lists, components once by CAS."""
    out = metadata.structured(*_asked(spark, folder))
    return out.select("query_id", _joined("codigos_h", "codigo", "descripcion").alias("h"), _joined("codigos_p", "codigo", "descripcion").alias("p"), _joined("componentes_cas", "nombre", "cas", "concentracion").alias("c"), F.col("total_chunks").cast("int").alias("n"))


# ---------------------------------------------------------------------- the index

_INDEXED = "i AS (SELECT printf('v%08d', vec_id) AS id, 'Vector ' || vec_id AS content, 'Producto ' || label AS producto, 'seccion_' || (vec_id % 4) AS seccion, CASE label % 3 WHEN 0 THEN 'texto' WHEN 1 THEN 'tabla' ELSE 'imagen' END AS tipo, CAST(len(embedding) AS INTEGER) AS dim, vec_id % 5 AS doc FROM embeddings)"


def _chunked(spark, folder) -> DataFrame:
    """Vectors as chunks."""
    kind = F.element_at(F.array(*[F.lit(k) for k in fixed.KINDS]), F.col("label") % 3 + 1)
    own = {"producto": F.concat(F.lit("Producto "), "label"), "seccion": F.concat(F.lit("seccion_"), F.col("vec_id") % 4), "tipo_contenido": kind, "codigo_producto": (F.col("vec_id") % 5).cast("string"), "chunk_id": F.format_string("v%08d", "vec_id"), "codigos_h": F.when(F.col("vec_id") % 3 == 0, F.array(F.struct(F.lit("H226").alias("codigo"), F.lit("x").alias("descripcion")))), "imagen_nombre": F.when(kind == "imagen", F.concat(F.col("vec_id").cast("string"), F.lit(".png")))}
    fields = StructType.fromDDL(f"m {CHUNK_METADATA}")["m"].dataType
    m = F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields.fields])
    return table(spark, folder, "embeddings").select(F.format_string("v%08d", "vec_id").alias("id"), F.concat(F.lit("Vector "), "vec_id").alias("content"), F.col("embedding").cast("array<float>").alias("embedding"), m.alias("metadata"), (F.col("vec_id") % 5).cast("string").alias("doc_key"))


def _index(spark, folder) -> Index:
    index = Index(spark, scratch_path(spark, "index"))
    index.ingest(_chunked(spark, folder))
    return index


@query(f"WITH {_INDEXED} SELECT id, content, producto, dim FROM i WHERE id = 'v00000007'")
def index_get(spark, folder):
    """One chunk by id with the length of its vector."""
    return _index(spark, folder).get("v00000007").select("id", "content", F.col("metadata.producto").alias("producto"), "dim")


@query(f"WITH {_INDEXED} SELECT id FROM i")
def index_ids(spark, folder):
    """All ids of the index."""
    return _index(spark, folder).ids()


@query(f"WITH {_INDEXED} SELECT id, content, tipo FROM i ORDER BY id LIMIT 50")
def index_sample(spark, folder):
    """The first fifty chunks by id."""
    return _index(spark, folder).sample(50).select("id", "content", F.col("tipo_contenido").alias("tipo"))


@query(f"WITH {_INDEXED} SELECT tipo AS tipo_contenido, count(*) AS count FROM i GROUP BY tipo")
def index_counts(spark, folder):
    """Chunks of the index by kind."""
    return _index(spark, folder).counts()


@query(f"WITH {_INDEXED} SELECT id, content, dim FROM i WHERE tipo = 'texto' ORDER BY id LIMIT 1")
def index_verify(spark, folder):
    """The first text chunk, looked up again."""
    return _index(spark, folder).verify().select("id", "content", "dim")


@query(f"WITH {_INDEXED} SELECT id, seccion FROM i WHERE seccion = 'seccion_2' ORDER BY id LIMIT 5")
def index_where_section(spark, folder):
    """Five chunks of a section."""
    return _index(spark, folder).where_section("seccion_2").select("id", F.col("metadata.seccion").alias("seccion"))


@query(f"WITH {_INDEXED} SELECT id, producto FROM i WHERE contains(producto, 'ducto 3')")
def index_where_product(spark, folder):
    """All chunks whose product holds a text."""
    return _index(spark, folder).where_product("ducto 3", None).select("id", F.col("metadata.producto").alias("producto"))


@query(f"WITH {_INDEXED} SELECT id, CASE WHEN doc = 1 THEN content || ' (2)' ELSE content END AS content FROM i")
def index_versions(spark, folder):
    """An index into which changed and unchanged chunks were ingested again: each id once, with its latest content."""
    index, chunks = _index(spark, folder), _chunked(spark, folder)
    index.ingest(chunks.withColumn("content", F.when(F.col("doc_key") == "1", F.concat("content", F.lit(" (2)"))).otherwise(F.col("content"))))
    return index.chunks().select("id", "content")


@query(f"WITH {_INDEXED} SELECT CASE WHEN doc = 2 THEN 'added' ELSE 'skipped' END AS status, tipo AS tipo_contenido, count(*) AS count FROM i GROUP BY ALL")
def index_forget(spark, folder):
    """A document is forgotten and all are ingested again: only its chunks are added."""
    index = _index(spark, folder)
    index.forget(spark.createDataFrame([("2",)], "doc_key string"))
    return index.ingest(_chunked(spark, folder)).select("status", "tipo_contenido", "count")


@query(f"""WITH {_INDEXED} SELECT 'totals' AS part, coalesce(tipo, '') AS name, count(*) AS n FROM i GROUP BY ROLLUP (tipo) UNION ALL SELECT * FROM (SELECT 'products', producto, count(*) FROM i GROUP BY producto ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT 'sections', seccion, count(*) FROM i GROUP BY seccion UNION ALL SELECT 'con_codigos_h', '', count(*) FROM i WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 0 UNION ALL SELECT 'con_codigos_p', '', 0
UNION ALL SELECT 'missing', tipo || ' ' || producto, 5 FROM i GROUP BY tipo, producto""")
def profile_report(spark, folder):
    """The profile of an index: totals, products, sections, chunks with codes, sections that products lack."""
    told = profile.report(_index(spark, folder).chunks())
    one = lambda name, df, label: df.select(F.lit(name).alias("part"), F.coalesce(label, F.lit("")).alias("name"), F.col("count").alias("n"))
    out = one("totals", told["totals"], "tipo_contenido").unionByName(one("products", told["products"], "producto")).unionByName(one("sections", told["sections"], "seccion"))
    for field in ("con_codigos_h", "con_codigos_p"):
        out = out.unionByName(told["filled"].select(F.lit(field).alias("part"), F.lit("").alias("name"), F.col(field).alias("n")))
    missing = told["coverage"].select(F.lit("missing").alias("part"), F.concat_ws(" ", "tipo_contenido", "producto").alias("name"), F.size("missing").cast("long").alias("n"))
    return out.unionByName(missing)


@query(f"""WITH {_INDEXED}, m AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY id) AS k FROM i WHERE tipo = 'imagen') SELECT CASE WHEN k <= 2 THEN 'updated' WHEN k = 3 THEN 'error' ELSE 'skipped' END AS status, count(*) AS count FROM m GROUP BY ALL""")
def images_enriched(spark, folder):
    """Image chunks described anew from the files of their document: the third file of each has no description."""
    engine = _engine(spark)
    engine.ingest(_chunked(spark, folder))
    names = table(spark, folder, "embeddings").select((F.col("vec_id") % 5).cast("string").alias("doc_key")).distinct()
    files = names.select("doc_key", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("doc_key", F.format_string("/img/%s_p1_img%d.png", "doc_key", "k").alias("path"), F.when(F.col("k") < 3, F.lit("una calavera")).alias("seen"))
    told = engine.enrich_images(files, F.col("seen"))
    redone = engine.index.chunks().filter("content = 'una calavera' and metadata.pictograma_tipo = 'toxico'").agg(F.count(F.lit(1)).alias("redone"))
    return settled(told).crossJoin(F.broadcast(redone)).filter("status <> 'updated' or count = redone").select("status", "count")  # one row


def _engine(spark) -> Engine:
    return Engine(spark, EngineConfig(scratch_path(spark, "engine")), vectors.HashingEmbedder(32))


def _decoded(content: bytes):
    yield (content.decode(),)


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT 1 AS run, 'archivo' AS kind, 'new' AS status, count(*) AS count FROM n UNION ALL SELECT 1, 'texto', 'added', 3 * count(*) FROM n
UNION ALL SELECT 2, 'archivo', CASE WHEN k % 5 = 1 THEN 'deleted' WHEN k % 5 = 2 THEN 'modified' ELSE 'same' END, count(*) FROM n GROUP BY ALL UNION ALL SELECT 2, 'texto', 'added', 3 * count(*) FROM n WHERE k % 5 = 2
UNION ALL SELECT 3, 'archivo', 'same', count(*) FROM n WHERE k % 5 <> 1 UNION ALL SELECT 9, 'index', CASE WHEN k % 5 = 2 THEN 'second' ELSE 'first' END, 3 * count(*) FROM n WHERE k % 5 <> 1 GROUP BY ALL""")
def index_updated(spark, folder):
    """Files that come, change and go, taken into the index by three runs of the update job; what is left is told by content."""
    engine, jvm, conf = _engine(spark), spark._jvm, spark._jsc.hadoopConfiguration()
    engine.config.create(spark)
    keys = [r[0] for r in table(spark, folder, "nation").select("n_nationkey").collect()]  # a table of 25 rows
    fill = "palabras de la hoja que siguen y siguen " * 3

    def put(k: int, word: str) -> None:
        path = jvm.org.apache.hadoop.fs.Path(engine.config.path("bronze", f"N{k}.pdf"))
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(f"Código: N{k}\nNombre del producto\nHoja numero {k}\nFabricante\nFábrica uno\nSECCIÓN 1: Datos\n{word} {fill}\nSECCIÓN 2: Peligros\n{word} {fill}\nSECCIÓN 3: Partes\n{word} {fill}".encode()))
        out.close()

    for k in keys:
        put(k, "first")
    runs = [engine.update({"text": _decoded})]
    for k in keys:
        if k % 5 == 2:
            put(k, "second")
        elif k % 5 == 1:
            sinks.remove(spark, engine.config.path("bronze", f"N{k}.pdf"))
    runs += [engine.update({"text": _decoded}), engine.update({"text": _decoded})]
    out = None
    for i, told in enumerate(runs, 1):
        one = told.select(F.lit(i).alias("run"), "kind", "status", "count")
        out = one if out is None else out.unionByName(one)
    left = engine.index.chunks().groupBy(F.when(F.col("content").contains("second"), "second").otherwise("first").alias("status")).count()
    return out.unionByName(left.select(F.lit(9).alias("run"), F.lit("index").alias("kind"), "status", "count"))


# ---------------------------------------------------------------------- hits and tables

@query(f"""WITH {_INDEXED} SELECT CAST(doc AS VARCHAR) AS query_id, id, CAST(substr(id, 2) AS BIGINT) || '.png' AS imagen_nombre, round_even(doc / 7.0, 3) AS similarity FROM i WHERE tipo = 'imagen'""")
def image_hits(spark, folder):
    """Hits that are images, with their file."""
    chunks = _chunked(spark, folder)
    hits = chunks.select(F.col("doc_key").alias("query_id"), F.lit(1).alias("position"), "id", F.col("metadata.tipo_contenido").alias("tipo"), (F.col("doc_key").cast("int") / 7.0).alias("similarity"), "content", "metadata")
    return retrieval.images(hits).join(hits.select("id", "query_id", F.col("metadata.imagen_nombre").alias("imagen_nombre")), ["query_id", "imagen_nombre"]).select("query_id", "id", "imagen_nombre", "similarity")


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_key, CAST(t.n * 2 AS INTEGER) AS table_no FROM customer, range(2) t(n)")
def tables_once(spark, folder):
    """Of two pairs of equal tables of every customer the first of each pair."""
    each = F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", each.alias("table_no"))
    cell = lambda c, v: F.struct(F.lit(0).alias("row_no"), F.lit(c).alias("col_no"), F.lit(f"c{c}").alias("col_name"), v.alias("value"))
    cells = rows.select(F.col("c_custkey").cast("string").alias("doc_key"), "table_no", F.inline(F.array(cell(0, F.col("c_name")), cell(1, F.when(F.col("table_no") < 2, F.col("c_mktsegment"))))))
    return tables.distinct_tables(cells).select("doc_key", "table_no").distinct()


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_key, 0 AS row_no, unnest([0, 1, 2]) AS col_no, unnest(['Clase', 'ADR', 'ADR_1']) AS col_name, unnest(['nombre', c_name, c_mktsegment]) AS value FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, unnest([0, 1, 2]), unnest(['Clase', 'ADR', 'ADR_1']), unnest(['nacion', CAST(c_nationkey AS VARCHAR), NULL]) FROM customer""")
def table_repeated_names(spark, folder):
    """Tables whose header repeats a name and whose first cells number some rows: names are told apart, those rows go."""
    c = table(spark, folder, "customer")
    rows = [(0, "Clase", F.lit("ADR"), F.lit("ADR")), (1, "77", F.lit("x"), F.lit("y")), (2, "nombre", F.col("c_name"), F.col("c_mktsegment")), (3, " nacion ", F.col("c_nationkey").cast("string"), F.lit("nan"))]
    cells = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(k).alias("col_no"), F.lit(str(k)).alias("col_name"), (F.lit(v) if isinstance(v, str) else v).alias("value")) for r, *vs in rows for k, v in enumerate(vs)])
    raw = c.select(F.col("c_custkey").cast("string").alias("doc_key"), F.lit(0).alias("table_no"), F.inline(cells))
    return tables.clean_tables(raw).select("doc_key", "row_no", "col_no", "col_name", "value")


@query("""SELECT event_id AS query_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n_sources, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'N/A' END AS producto, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1000 END AS n_preview, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE value END AS avg_similarity, 0.0 AS total_chunks,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'N/A' END AS fabricante, 0 AS n_pictogramas FROM events""")
def responses_normalised(spark, folder):
    """Responses with missing parts, as clients get them."""
    source = F.struct(F.lit(None).cast("string").alias("producto"), F.lit("s").alias("seccion"), F.lit(0.5).alias("similarity"), F.lit("texto").alias("tipo"), F.lit("c").alias("chunk_id"), F.repeat(F.lit("x"), 3000).alias("content_preview"))
    some = F.col("event_id") % 3 != 0
    reference = F.struct(F.lit("p").alias("producto"), F.lit(None).cast("string").alias("fabricante"), F.lit("c").alias("codigo"), F.lit("f").alias("fecha"))
    given = table(spark, folder, "events").select(F.col("event_id").alias("query_id"), F.lit(None).cast("string").alias("answer"), F.when(some, F.array(source)).alias("sources"), F.when(F.col("event_id") % 2 == 1, F.create_map(F.lit("avg_similarity"), F.col("value"))).alias("metrics"), F.lit(None).cast("array<string>").alias("pictogramas"), F.when(some, reference).alias("fds_reference"))
    out = answer.normalised(given)
    first = F.get("sources", F.lit(0))
    return out.select("query_id", F.size("sources").alias("n_sources"), F.coalesce(first["producto"], F.lit("")).alias("producto"), F.coalesce(F.length(first["content_preview"]), F.lit(0)).alias("n_preview"), F.col("metrics")["avg_similarity"].alias("avg_similarity"), F.col("metrics")["total_chunks"].alias("total_chunks"), F.col("fds_reference.fabricante").alias("fabricante"), F.size("pictogramas").alias("n_pictogramas"))


@query("SELECT c.conv_id, c.turn, CASE WHEN c.conv_id % 2 = 0 THEN 'Uretano' END AS product FROM conversations c")
def session_state(spark, folder):
    """Turns with the state of their session; sessions without one begin without product."""
    turns = table(spark, folder, "conversations").withColumnRenamed("conv_id", "session_id")
    state = turns.select("session_id").distinct().filter("session_id % 2 = 0").withColumn("product", F.lit("Uretano"))
    return conversation.sessions(turns, state).select(F.col("session_id").alias("conv_id"), "turn", "product")


# ---------------------------------------------------------------------- answers

class Letters:
    """An embedder that SQL can follow: how often a text has each letter and digit."""

    SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"
    size = len(SIGNS)

    def embed(self, texts: list[str | None]) -> np.ndarray:
        return np.array([[(t or "").lower().count(c) for c in self.SIGNS] for t in texts], np.float32).reshape(len(texts), self.size)


_COUNTED = f"list_transform(string_split('{Letters.SIGNS}', ''), lambda x: CAST(length(lower({{0}})) - length(replace(lower({{0}}), x, '')) AS DOUBLE))"
_PRODUCT = "CASE p_partkey % 4 WHEN 0 THEN 'Esmalte Uretano' WHEN 1 THEN 'Pintura Texturizada' ELSE 'Otro' END || ' ' || p_brand"
_ASKED = "CASE s_suppkey % 3 WHEN 0 THEN 'componentes del esmalte uretano ' WHEN 1 THEN 'componentes de la pintura texturizada ' ELSE 'componentes de ' END || s_name"


@query(f"""WITH c AS (SELECT p_partkey AS k, 'c' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_name || ' ' || p_type AS content, {_PRODUCT} AS producto, p_brand, p_partkey % 3 AS kind FROM part),
q AS (SELECT s_suppkey AS qid, {_ASKED} AS text, CASE s_suppkey % 3 WHEN 0 THEN 'Uretano' WHEN 1 THEN 'Texturizada' END AS product FROM supplier),
s AS (SELECT q.qid, q.product, c.*, list_cosine_similarity({_COUNTED.format("c.content")}, {_COUNTED.format("q.text")}) AS sim FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY round(sim, 9) DESC, id) AS rank FROM s),
b AS (SELECT *, CASE WHEN kind = 2 THEN sim * 1.2 ELSE sim END AS boosted FROM r WHERE rank <= 30 AND (product IS NULL OR contains(lower(producto), lower(product)))),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(boosted, 9) DESC, kind, rank, id) AS position FROM b),
h AS (SELECT * FROM p WHERE position <= 15)
SELECT 's' || q.qid AS query_id, q.product, count(h.id) AS n, round(coalesce(max(h.boosted) FILTER (position = 1), 0), 6) AS top, max(h.id) FILTER (position = 1) AS best, max(h.producto) FILTER (position = 1) AS producto,
CASE WHEN q.product IS NOT NULL THEN max(p_brand) FILTER (position = 1) END AS fabricante, CASE WHEN q.product IS NOT NULL THEN max('K' || k) FILTER (position = 1) END AS codigo, count(h.id) FILTER (kind = 0) > 0 AS told
FROM q LEFT JOIN h USING (qid) GROUP BY q.qid, q.product""")
def answered_products(spark, folder):
    """Questions of every supplier about products, answered from chunks of every part: retrieval, product filter, metrics and the facts of the product."""
    kind = F.element_at(F.array(*[F.lit(k) for k in fixed.KINDS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    own = {"producto": F.expr(_PRODUCT), "fabricante": F.col("p_brand"), "codigo_producto": F.concat(F.lit("K"), "p_partkey"), "chunk_id": F.col("id"), "seccion": F.lit("s"), "tipo_contenido": kind}
    parts = table(spark, folder, "part").withColumn("id", F.concat(F.lit("c"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).withColumn("content", F.concat_ws(" ", "p_name", "p_type"))
    fields = StructType.fromDDL(f"m {CHUNK_METADATA}")["m"].dataType
    m = F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields.fields])
    chunks = settled(parts.select("id", "content", vectors.embed("content", Letters()).alias("embedding"), m.alias("metadata")), "chunks")
    asked = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("query_id"), F.concat(F.lit("s"), "s_suppkey").alias("session_id"), F.lit(1).cast("long").alias("turn"), F.expr(_ASKED).alias("text"), F.lit(True).alias("use_context"))
    out = answer.answer(asked, chunks, Letters(), fuzzy=False)
    first = F.get("sources", F.lit(0))
    told = F.col("answer") != fixed.NO_TEXT_ANSWER
    return out.select("query_id", "product", F.size("sources").cast("long").alias("n"), F.round(F.col("metrics")["top_similarity"], 6).alias("top"), first["chunk_id"].alias("best"), first["producto"].alias("producto"), F.col("fds_reference.fabricante").alias("fabricante"), F.col("fds_reference.codigo").alias("codigo"), told.alias("told"))
