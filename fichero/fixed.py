"""Fixed values of the domain: safety data sheets in Spanish, with some English headings.

These values decide results, so they are stated as they are: names, phrases, key words and patterns.
"""

from __future__ import annotations

#: Section names by number.
SECTIONS = {
    1: "identificacion_producto",
    2: "identificacion_peligros",
    3: "composicion_componentes",
    4: "primeros_auxilios",
    5: "medidas_contra_incendios",
    6: "medidas_vertido_accidental",
    7: "manipulacion_almacenamiento",
    8: "controles_exposicion_proteccion",
    9: "propiedades_fisicas_quimicas",
    10: "estabilidad_reactividad",
    11: "informacion_toxicologica",
    12: "informacion_ecologica",
    13: "consideraciones_eliminacion",
    14: "informacion_transporte",
    15: "informacion_reglamentaria",
    16: "otra_informacion",
}

#: Patterns that open a section where sections are not numbered, in order of preference.
SECTION_PATTERNS = {
    1: [r"identificaci[oó]n(?:\s+del?\s+producto)?", r"product\s+identifier", r"manufacturer", r"supplier", r"fabricante", r"proveedor"],
    2: [r"identificaci[oó]n.*peligros", r"hazard.*identification", r"clasificaci[oó]n.*peligro", r"pictogramas?", r"signal.*word"],
    3: [r"composici[oó]n", r"ingredientes", r"componentes", r"composition", r"ingredients", r"components"],
    4: [r"primeros\s+auxilios", r"first\s+aid", r"first.*aid.*measures"],
    5: [r"medidas.*incendio", r"lucha.*incendio", r"fire.*fighting", r"firefighting"],
    6: [r"medidas.*derrame", r"liberación.*accidental", r"vertido", r"accidental.*release", r"spill"],
    7: [r"manejo.*almacenamiento", r"manipulaci[oó]n.*almacenamiento", r"handling.*storage"],
    8: [r"controles.*exposici[oó]n", r"protecci[oó]n.*personal", r"exposure.*controls", r"personal.*protection"],
    9: [r"propiedades.*f[ií]sicas.*qu[ií]micas", r"physical.*chemical.*properties"],
    10: [r"estabilidad.*reactividad", r"stability.*reactivity"],
    11: [r"informaci[oó]n.*toxicol[oó]gica", r"toxicological.*information"],
    12: [r"informaci[oó]n.*ecol[oó]gica", r"ecological.*information"],
    13: [r"eliminaci[oó]n", r"disposal", r"consideraciones.*eliminaci[oó]n"],
    14: [r"transporte", r"informaci[oó]n.*transporte", r"transportation"],
    15: [r"informaci[oó]n.*reglamentaria", r"regulatory.*information"],
    16: [r"otra.*informaci[oó]n", r"other.*information"],
}

#: Fixed value: the header of a numbered section.
SECTION_HEADER = r"\s*(?:SECCI[ÓO]N|SECTION)\s+([0-9]{1,2})\s*:"

#: Labels whose next line names the product and its supplier.
PRODUCT_LABEL = r"nombre\s+del\s+producto|product\s+name"
SUPPLIER_LABEL = r"fabricante|distribuidor|manufacturer|supplier"
#: Patterns of fields of a sheet, and the length of the head that is searched (None: all).
PRODUCT_CODE = r"c[óo]digo[:\s]+(\S+)"
ISSUE_DATE = r"(?:fecha\s+de\s+emisi[óo]n|revision\s+date)[:\s]+([0-9./-]+)"
PRODUCT_USE = r"uso\s+del\s+producto[:\s]+(.*?)(?:\n\n|\n[A-Z]|$)"
CODE_HEAD, DATE_HEAD, USE_HEAD = 2000, 2000, 3000
#: Hazard codes; precaution codes and combinations; the end of a code's description.
HAZARD_CODE = r"H\d{3}\b"
PRECAUTION_CODE = r"P\d{3}(?:\s*\+\s*P\d{3})*"
#: A component with its CAS number; its concentration, with and without need of a percent sign.
COMPONENT = r"(.*?)\s+CAS:\s*([0-9]+-[0-9]+-[0-9]+)"
CONCENTRATION = r"([0-9,.-]+%\s*-?\s*[0-9,.-]*%?)"
LOOSE_CONCENTRATION = r"([0-9,.-]+%?\s*-?\s*[0-9,.-]*%?)"
#: Physical properties.
PROPERTIES = {
    "estado_fisico": r"Estado\s+f[íi]sico[:\s]+(.*?)(?:\n|$)",
    "color": r"Color[:\s]+(.*?)(?:\n|$)",
    "ph": r"pH[:\s]+([\d.,\s±]+)",
    "punto_inflamacion": r"Punto\s+de\s+inflamaci[óo]n[:\s]+(.*?)(?:\n|$)",
    "densidad": r"Densidad(?:\s+aparente)?[:\s]+([\d.,\s±]+\s*g/cm3)",
}

#: Sections that a complete product has.
EXPECTED_SECTIONS = ["identificacion_producto", "identificacion_peligros", "composicion_componentes", "primeros_auxilios", "controles_exposicion_proteccion"]

#: Hazard statements.
HAZARDS = {
    "H225": "Líquido y vapores muy inflamables",
    "H226": "Líquidos y vapores inflamables",
    "H304": "Puede ser mortal en caso de ingestión",
    "H315": "Provoca irritación cutánea",
    "H316": "Provoca una leve irritación cutánea",
    "H317": "Puede provocar una reacción alérgica en la piel",
    "H319": "Provoca irritación ocular grave",
    "H335": "Puede irritar las vías respiratorias",
    "H336": "Puede provocar somnolencia o vértigo",
    "H373": "Puede provocar daños en los órganos",
    "H412": "Nocivo para los organismos acuáticos",
}

#: Precautionary statements.
PRECAUTIONS = {
    "P210": "Mantener alejado de fuentes de ignición",
    "P233": "Mantener el recipiente cerrado herméticamente",
    "P240": "Conectar a tierra el recipiente",
    "P241": "Utilizar material eléctrico/equipos a prueba de explosión",
    "P242": "Utilizar herramientas que no produzcan chispas",
    "P260": "No respirar vapores",
    "P261": "Evitar respirar el polvo/humo/gas",
    "P264": "Lavarse las manos después de manipular",
    "P270": "No comer, beber ni fumar durante su utilización",
    "P272": "La ropa contaminada no debe salir del lugar de trabajo",
    "P273": "Evitar su liberación al medio ambiente",
    "P280": "Llevar guantes/ropa/gafas de protección",
    "P303": "EN CASO DE CONTACTO CON LA PIEL (o el pelo)",
    "P305": "EN CASO DE CONTACTO CON LOS OJOS",
    "P333": "En caso de irritación o erupción cutánea",
    "P337": "Si persiste la irritación ocular",
    "P351": "Enjuagar con agua",
    "P353": "Aclararse la piel con agua",
    "P361": "Quitarse inmediatamente la ropa contaminada",
    "P362": "Quitarse la ropa contaminada",
    "P364": "Lavar la ropa contaminada antes de usarla",
    "P370": "En caso de incendio",
    "P378": "Utilizar arena seca, polvo químico o espuma resistente",
    "P403": "Almacenar en un lugar bien ventilado",
    "P405": "Guardar bajo llave",
    "P501": "Eliminar el contenido/recipiente según normativa",
}

#: Fixed value: the description of a code that is in neither list.
NO_DESCRIPTION = "Descripción no disponible"
#: Fixed value: the concentration of a component that states none.
NO_CONCENTRATION = "No especificada"

#: Pictogram of a hazard code.
PICTOGRAMS = {"H225": "flame", "H226": "flame", "H304": "health_hazard", "H315": "exclamation", "H317": "exclamation", "H319": "exclamation", "H335": "exclamation", "H336": "health_hazard", "H373": "health_hazard", "H412": "environment"}

#: Query types in order of priority, with their key words.
QUERY_TYPES = {
    "peligros": [
        "peligro", "peligros", "riesgo", "riesgos", "codigo h", "codigos h", "h315", "h319", "h317", "h225", "h226",
        "h304", "h336", "h412", "clasificacion", "categoria", "pictograma", "simbolo", "inflamable", "toxico",
        "irritante", "corrosivo", "nocivo", "toxicidad",
    ],
    "proteccion": [
        "proteccion", "precaucion", "precauciones", "codigo p", "codigos p", "p280", "p210", "p233", "p260", "p264",
        "p270", "p273", "p303", "p305", "p333", "p337", "p370", "p378", "p403", "p405", "p501", "epp", "equipo",
        "guantes", "gafas", "mascara", "respirador", "ropa", "traje", "botas", "ventilacion", "medidas", "seguridad",
    ],
    "emergencias": [
        "primeros auxilios", "emergencia", "emergencias", "accidente", "contacto piel", "contacto ojos",
        "contacto con la piel", "contacto con los ojos", "inhalacion", "ingestion", "tragar", "respirar", "incendio",
        "fuego", "llama", "combustion", "extincion", "derrame", "vertido", "fuga", "escape", "liberacion", "que hacer",
        "tratamiento", "sintomas", "efectos",
    ],
    "componentes": [
        "componente", "componentes", "composicion", "ingrediente", "ingredientes", "cas", "numero cas", "sustancia",
        "sustancias", "concentracion", "porcentaje", "xileno", "acetato", "solvente", "resina", "pigmento", "formula",
        "quimico",
    ],
    "manipulacion": [
        "manipulacion", "manejo", "usar", "uso", "aplicacion", "almacenamiento", "almacenar", "guardar", "conservar",
        "temperatura", "temperatura almacenamiento", "conservacion", "ventilacion", "lugar seco", "lugar fresco",
        "incompatibilidad", "incompatible", "reacciones", "estabilidad", "eliminacion", "disposicion", "desecho",
        "residuo", "caducidad", "vida util", "vencimiento",
    ],
    "propiedades": [
        "propiedad", "propiedades", "fisico", "quimico", "densidad", "viscosidad", "ph", "color", "olor", "aspecto",
        "estado", "punto inflamacion", "punto ebullicion", "punto de inflamacion", "solubilidad", "soluble", "miscible",
        "liquido", "solido", "pastoso", "viscoso", "caracteristicas",
    ],
    "identificacion": [
        "identificacion", "producto", "nombre", "codigo", "codigo producto", "fabricante", "proveedor", "distribuidor",
        "sika", "uso", "aplicacion", "para que sirve", "fecha", "fecha emision", "version",
    ],
}

#: Sections of a query type, by number.
QUERY_SECTIONS = {"peligros": [2, 11], "proteccion": [2, 8], "emergencias": [4, 5, 6], "componentes": [3], "manipulacion": [7, 13, 10], "propiedades": [9], "identificacion": [1]}
#: The metadata that answers a query type ("precauciones" is accepted, never detected).
QUERY_FIELD = {"peligros": "codigos_h", "proteccion": "codigos_p", "precauciones": "codigos_p", "componentes": "componentes_cas"}
#: Fixed value: search level of every known query type, and of any other.
SEARCH_LEVEL, OTHER_LEVEL = "hybrid", "semantic_only"

#: Product terms and the product that each one filters by.
PRODUCT_TERMS = {
    "esmalte epoxico aluminio": "Epóxico Aluminio",
    "esmalte epóxico aluminio": "Epóxico Aluminio",
    "epoxico aluminio": "Epóxico Aluminio",
    "epóxico aluminio": "Epóxico Aluminio",
    "pintura texturizada": "Texturizada",
    "texturizada": "Texturizada",
    "esmalte uretano": "Uretano",
    "esmalte alquidico": "Alquídico",
    "esmalte alquídico": "Alquídico",
    "epoxico": "Epóxico",
    "epóxico": "Epóxico",
    "epoxi": "Epóxico",
    "uretano": "Uretano",
    "alquidico": "Alquídico",
    "alquídico": "Alquídico",
    "sikawall": "SikaWall",
}

#: Words that name a product, so that a question is not enriched; first words of follow-up questions.
PRODUCT_WORDS = ["epoxi", "uretano", "alquid", "textur", "sika"]
FOLLOW_UP = ["y", "sus", "su", "ese", "este", "dame", "tambien", "cuales", "que", "es"]

#: Pictogram classes in order, with words of a description.
PICTOGRAM_CLASSES = {
    "inflamable": ["llama", "fuego", "inflamable"],
    "corrosivo": ["corrosión", "tubo", "ácido"],
    "toxico": ["calavera", "cráneo", "tóxico"],
    "irritante": ["signo exclamación", "irritante"],
    "peligro_salud": ["silueta", "cuerpo humano", "salud"],
    "explosivo": ["explosión", "bomba"],
    "comburente": ["llama círculo", "oxígeno"],
    "gas_presion": ["cilindro", "gas", "presión"],
    "medio_ambiente": ["árbol", "pez", "ambiental"],
}
OTHER_PICTOGRAM = "otro"

#: Kinds of chunks in order, and the answer where no text was found, or too little.
KINDS = ["texto", "tabla", "imagen"]
NO_TEXT_ANSWER = "No encontré información de texto en la FDS para responder esta pregunta con precisión."
SHORT_ANSWER = "Error: La base de datos no tiene información suficiente."

#: Sizes and factors.
CHUNK_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 800, 150, 4
CANDIDATES, FINAL, IMAGE_BOOST = 30, 10, 1.2
TYPE_RATIO, PRODUCT_RATIO, TYPE_WORD, PRODUCT_WORD = 0.75, 0.80, 4, 5
FRAGMENTS, FRAGMENT_CHARS, PREVIEW_CHARS, RESPONSE_CHARS, LOGGED_CHARS, MIN_ANSWER = 5, 800, 200, 1000, 100, 50
