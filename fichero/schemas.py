"""Declared schemas of the zones, as DDL: extracted documents, chunks, manifest, requests and responses."""

from __future__ import annotations

CODE = "struct<codigo:string,descripcion:string>"
COMPONENT = "struct<nombre:string,cas:string,concentracion:string>"
SECTION = "struct<pos:int,name:string,text:string>"

DOC_FIELDS = f"""contenido_texto string, metadata struct<nombre_producto:string,proveedor:string,codigo:string,fecha_emision:string,uso_producto:string,indicaciones_peligro:array<string>,frases_precaucion:array<string>,indicaciones_peligro_detalle:array<{CODE}>,frases_precaucion_detalle:array<{CODE}>,componentes_quimicos:array<{COMPONENT}>,propiedades_fisicoquimicas:struct<estado_fisico:string,color:string,ph:string,punto_inflamacion:string,densidad:string>,secciones:array<{SECTION}>>"""
DOC_METADATA = f"doc_key string, {DOC_FIELDS}"
CHUNK_METADATA = (
    f"struct<producto:string,fabricante:string,codigo_producto:string,fecha_fds:string,chunk_id:string,chunk_index:int,total_chunks:int,tipo_contenido:string,char_count:int,token_count:int,seccion:string"
    f",componentes_cas:array<{COMPONENT}>,codigos_h:array<{CODE}>,codigos_p:array<{CODE}>,pictograma_tipo:string,imagen_path:string,imagen_nombre:string>"
)
CHUNK_COLUMNS = ["id", "content", "embedding", "metadata"]
CHUNK = f"id string, content string, embedding array<float>, metadata {CHUNK_METADATA}"
#: What the index keeps of a chunk besides: its document, the hash of its content, and the version of its id (the latest counts).
INDEX_COLUMNS = [*CHUNK_COLUMNS, "doc_key", "content_hash", "version"]
INDEXED = f"{CHUNK}, doc_key string, content_hash string, version long"
CHUNK_FILE = f"total_chunks int, chunks array<struct<id:string,content:string,embedding:array<float>,metadata:{CHUNK_METADATA}>>"
TABLE_CELL = "doc_key string, table_no int, row_no int, col_no int, col_name string, value string"
MANIFEST = "name string, hash string, size long"
REQUEST = "query_id string, session_id string, turn long, text string, use_context boolean"
QUERY_METRICS = "query string, session_id string, latency_ms double, avg_similarity double, top_similarity double, total_chunks long, codigos_h_count int, codigos_p_count int"
