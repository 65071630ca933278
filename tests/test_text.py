from pyspark.sql import functions as F

from fichero import fixed
from fichero.functions import codes
from fichero.functions import text as T
from fichero.operators import chunking, sections

SHEET = "\n".join(
    ["FICHA DE DATOS ", "Fecha de emisión: 05.03.2021 ", "SECCIÓN 1: Identificación ", "Nombre del producto ", "Barniz Prueba  Comp. A ", "Código: 0042 ", "Fabricante ", "Fábrica Ejemplo S.A. "]
    + ["Uso del producto: Barniz para madera. ", "Relleno de la primera sección, con palabras de sobra. "]
    + ["SECCIÓN 2: Peligros ", "H226 Líquidos y vapores inflamables. ", "H411 Tóxico. ", "P210 Mantener lejos del calor. ", "P301 + P310 En caso de ingestión: llamar. "]
    + ["SECCIÓN 3: Composición ", "Xileno ficticio CAS: 1330-20-7 10% - 20% ", "Otro CAS: 64-17-5 ", "Estado físico: líquido ", "Color: Blanco ", "pH: 7,9 ± 1 ", "Punto de inflamación: 23 °C ", "Densidad: 1.2 g/cm3 "]
    + ["SECCIÓN 2: Repetida, que ya no cuenta porque el número se repite en el texto. ", "SECCIÓN 4: corta "]
)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_clean(spark):
    assert one(spark, T.clean("t"), "  a \t b\n\n\n\n  c \n d ") == "a b\nc \nd"
    assert one(spark, T.clean("t"), "") == "" and one(spark, T.clean("t"), None) is None


def test_extract(spark):
    row = sections.extract(spark.createDataFrame([("d", SHEET)], "doc_key string, text string")).first()
    m = row["metadata"]
    assert (m["nombre_producto"], m["proveedor"], m["codigo"], m["fecha_emision"]) == ("Barniz Prueba Comp. A", "Fábrica Ejemplo S.A.", "0042", "05.03.2021")
    assert m["uso_producto"] == "Barniz para madera."
    assert m["indicaciones_peligro"] == ["H226", "H411"] and m["frases_precaucion"] == ["P210", "P301 + P310"]
    assert [tuple(d) for d in m["frases_precaucion_detalle"]] == [("P210", "Mantener lejos del calor."), ("P301 + P310", "En caso de ingestión: llamar.")]
    assert [tuple(c) for c in m["componentes_quimicos"]] == [("Xileno ficticio", "1330-20-7", "10% - 20%"), ("Otro", "64-17-5", None)]
    p = m["propiedades_fisicoquimicas"]
    assert (p["estado_fisico"], p["color"], p["ph"], p["punto_inflamacion"], p["densidad"]) == ("líquido", "Blanco", "7,9 ± 1", "23 °C", "1.2 g/cm3")
    assert [s["name"] for s in m["secciones"]] == [fixed.SECTIONS[n] for n in (1, 2, 3)]


def test_combined_codes_can_be_lost(spark):
    described = one(spark, T.described("t", T.precaution_codes("t"), "P", combined=False), SHEET)
    assert [d["codigo"] for d in described] == ["P210"]


def test_keywords(spark):
    text = "Primeros auxilios\n" + "agua " * 60 + "\nTransporte\n" + "camión " * 30
    found = one(spark, sections.sections("t"), text)
    assert [(s["name"], s["text"].split()[0]) for s in found] == [("primeros_auxilios", "Primeros"), ("informacion_transporte", "Transporte")]
    assert found[0]["text"].endswith("agua")


def test_parsers(spark):
    h = lambda t: [tuple(c) for c in one(spark, codes.parse_hazards("t"), t)]
    known = ("H315", fixed.HAZARDS["H315"])
    assert h("H315,H319") == [known, ("H319", fixed.HAZARDS["H319"])]
    assert h("{'codigo': 'H226', 'descripcion': 'x'},{'codigo': 'P1'}") == [("H226", fixed.HAZARDS["H226"])]
    assert h("[{'codigo': 'H226'}, {'codigo': 'H304'}]") == [("H226", fixed.HAZARDS["H226"]), ("H304", fixed.HAZARDS["H304"])]
    assert h("{broken H315 and H315 H999") == [known, ("H999", fixed.NO_DESCRIPTION)]
    assert h("") == [] and h(None) == []
    assert [c["codigo"] for c in one(spark, codes.parse_precautions("t"), "P370 + P378,P305 + P351")] == ["P370", "P378", "P305", "P351"]
    c = lambda t: [tuple(x) for x in one(spark, codes.parse_components("t"), t)]
    assert c("{'nombre': 'Xileno', 'cas': '1-2-3'},{'nombre': 'x'}") == [("Xileno", "1-2-3", fixed.NO_CONCENTRATION)]
    assert c("nothing") == [] and c(None) == []


def packed(parts, size, overlap, sep):
    """Plain version of the packing."""
    done, current, n = [], [], 0
    for p in parts:
        t = len(p) // 4
        if n + t > size and current:
            done.append(sep.join(current))
            kept, m = [], 0
            for q in reversed(current):
                if m + len(q) // 4 > overlap:
                    break
                kept.insert(0, q)
                m += len(q) // 4
            current, n = kept, m
        current.append(p)
        n += t
    return [*done, sep.join(current)] if current else done


def test_pack(spark):
    from conftest import DATA

    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text", chunking.pack("text", 200, 60, "\n").alias("x")).collect()
    for r in rows:
        parts = [p.strip() for p in r["text"].split("\n") if p.strip()]
        assert r["x"] == packed(parts, 200, 60, "\n")
    assert one(spark, chunking.pack("t"), "") == []


def test_small_functions(spark):
    assert one(spark, T.plain_answer("t"), "# **Uno** y *dos*\n- tres\n1. cuatro " + "x" * 50) == "Uno y dos\ntres\ncuatro " + "x" * 50
    assert one(spark, T.plain_answer("t"), "corto") == fixed.SHORT_ANSWER
    assert one(spark, T.pictogram_class("t"), "una LLAMA círculo") == "inflamable"
    assert one(spark, T.pictogram_class("t"), "nada") == "otro"
    assert one(spark, T.image_description(F.lit("ghs_02.PNG"), "t"), "hola") == "Pictograma de seguridad. Texto visible: hola"
    assert one(spark, T.with_context(F.lit("c"), "t", F.lit("s")), None) == "Documento: None\nSección: s\n\nc"
    assert one(spark, T.parsed_date("t"), "05.03.2021").isoformat() == "2021-03-05" and one(spark, T.parsed_date("t"), "x") is None


def test_components_are_found_line_by_line(spark):
    """As a scan that begins anywhere finds them; long lines without a component cost no more than their length."""
    import time

    amount = r"([0-9,.-]+%\s*-?\s*[0-9,.-]*%?)"
    texts = ["Xileno CAS: 1330-20-7 10% - 20% Agua CAS: 7732-18-5\n CAS: 1-2-3 5%", "a\r\nb  \n CAS:\n1-1-1\n2% c CAS: 9-9-9", " CAS: 1-1-1", "x y CAS: 1-1-1 CAS: 2-2-2", "", None, "no CAS: 1-1\nR CAS: 3-3-3 -"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.arrays_zip(*[F.regexp_extract_all("t", F.lit(rf"(?U)(.*?)\s+CAS:\s*([0-9]+-[0-9]+-[0-9]+)(?:\s+{amount})?"), F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))])
    want = F.transform(plain, lambda x: F.struct(T.strip(x["a"]).alias("nombre"), x["b"].alias("cas"), T.blank_to_null(T.strip(F.coalesce(x["c"], F.lit("")))).alias("concentracion")))
    rows = df.select(want.alias("want"), T.components("t").alias("own")).collect()
    assert sum(len(r["own"] or []) for r in rows) == 9 and all(r["own"] == r["want"] for r in rows)
    long = spark.range(1).select(F.repeat(F.lit("palabras "), 40_000).alias("t"))
    began = time.monotonic()
    assert long.select(T.components("t").alias("c")).first()["c"] == []
    assert time.monotonic() - began < 20


def test_fields_that_nobody_reads_are_pruned(spark):
    from fichero.operators import sections

    docs = sections.fields(spark.createDataFrame([("a", "Código: C1\nH225 Arde")], "doc_key string, text string"))
    plan = docs.select("doc_key", F.upper("codigo"), F.lower("codigo"), F.size("indicaciones_peligro"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "CAS:" not in plan
