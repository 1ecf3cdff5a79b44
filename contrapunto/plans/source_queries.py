"""Queries of the scans, sinks and filters (S*, K*, F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapunto import schemas as S
from contrapunto.functions.identifiers import notice_id
from contrapunto.operators import blocks as B
from contrapunto.operators import documents as D
from contrapunto.operators import filters as FL
from contrapunto.operators import pages as P
from contrapunto.plans.analogs import AS_OF, NEW_STAMP, OLD_STAMP, portal_pages
from contrapunto.plans.registry import query
from contrapunto.sources import scans as SC
from contrapunto.sources import sinks as SK
from contrapunto.streaming.streams import run_folder


@query("S1_filtered_scan", """
SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) valor FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000""")
def s1(t):
    return SC.scan(t.orders, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000),
                   ["o_orderkey", "o_custkey", F.col("o_totalprice").cast(S.MONEY).alias("valor")])


@query("S1_W12_listing_page", """
SELECT id_contrato, fecha_firma, estado FROM {contratos} ORDER BY fecha_firma DESC, seq LIMIT 50 OFFSET 100""")
def s1_page(t):
    return SC.scan(t.contratos, None, ["id_contrato", "fecha_firma", "estado"], [F.desc("fecha_firma"), "seq"], 50, 100)


@query("S2_entity_scan", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def s2(t):
    return SC.scan_entity(t.orders, "o_orderpriority", "1-URGENT").select("o_orderkey", "o_orderpriority")


@query("S2_landed_pages", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def s2_pages(t):
    """The entity's rows landed in pages of 500, with a page of another entity left behind them."""
    from contrapunto.operators import ordering as O
    folder, columns = run_folder(t.spark), ["o_orderkey", "o_orderpriority", "o_totalprice"]
    rows = O.numbered(t.orders.where("o_orderpriority = '1-URGENT'").select(*columns), ["o_orderpriority"], ["o_orderkey"], "i").withColumn("page", F.expr("(i - 1) div 500"))
    last = rows.agg(F.max("page")).scalar()
    stale = t.orders.where("o_orderpriority = '2-HIGH'").select(*columns).withColumn("page", last + 2)
    rows.drop("i").unionByName(stale).repartition("page").write.partitionBy("page").json(f"{folder}/orders")
    return SC.scan_pages(t.spark, f"{folder}/orders", t.orders.select(*columns).schema, 500)


@query("S3_U4_union_archives", """
SELECT process_id, clave, doc_id, dataset fuente FROM (SELECT *, coalesce(nullif(trim(url), ''), nombre) clave,
  row_number() OVER (PARTITION BY process_id, coalesce(nullif(trim(url), ''), nombre) ORDER BY prio, doc_id) rn FROM {archivos}) WHERE rn = 1""")
def s3(t):
    a = t.archivos
    frames = [(n, a.where(F.col("dataset") == n)) for n in ("archivo_2022", "archivo_2023", "archivo_2025")]
    return SC.union_archives(frames).select("process_id", "clave", "doc_id", "fuente")


@query("S4_flatten_url", "SELECT page_id, url FROM pages")
def s4(t):
    mixed = F.when(F.col("url").startswith("https:"), F.to_json(F.struct("url"))).otherwise(F.col("url"))
    return SC.flatten_urls(t.pages.select("page_id", mixed.alias("url")), ["url"])


_CELLS = ["numero", "url", "vigencia", "estado"]


@query("S5_link_column", """
c AS (SELECT sheet, 1 col_no, 'numero' header, numero val FROM {ledger} UNION ALL SELECT sheet, 2, 'COL_B', url FROM {ledger}
  UNION ALL SELECT sheet, 3, 'vigencia', vigencia FROM {ledger} UNION ALL SELECT sheet, 4, 'estado', estado FROM {ledger})
SELECT sheet, col_no, header, hits, 'conteo' via FROM (SELECT sheet, col_no, header, count(*) FILTER (contains(lower(val), 'portal.example.org')) hits,
  row_number() OVER (PARTITION BY sheet ORDER BY count(*) FILTER (contains(lower(val), 'portal.example.org')) DESC, col_no) rn FROM c GROUP BY sheet, col_no, header) WHERE rn = 1""")
def s5(t):
    cells = SC.ledger_cells(t.ledger, ["sheet", "row_no"], _CELLS)
    cells = cells.withColumn("header", F.when(F.col("header") == "url", "COL_B").otherwise(F.col("header")))
    return SC.detect_link_column(cells, "portal.example.org")


@query("S6_resolve_headers", """
h AS (SELECT DISTINCT sheet, x.col_no, x.header FROM {ledger}, (SELECT unnest([
   {'col_no': 1, 'header': '2. NÚMERO DE CONTRATO'}, {'col_no': 2, 'header': 'LINK'}, {'col_no': 3, 'header': '28.VALOR INICIAL DEL CONTRATO (TOTAL)'},
   {'col_no': 4, 'header': '36. VALOR TOTAL'}, {'col_no': 5, 'header': 'Estado del Contrato'}, {'col_no': 6, 'header': '5. fecha suscripción'}]) x)),
a AS (SELECT * FROM (VALUES ('estado', 1, 'ESTADO DEL CONTRATO'), ('fecha_firma', 0, '5. FECHA SUSCRIPCION'), ('fecha_firma', 1, 'FECHA SUSCRIPCION'),
   ('valor_total', 0, '36. VALOR TOTAL'), ('valor_total', 2, 'VALOR TOTAL'), ('valor_inicial', 0, '28.VALOR INICIAL DEL CONTRATO'), ('numero_contrato', 0, '2. NUMERO DE CONTRATO')) v(campo, r, alias))
SELECT sheet, campo, col_no, header FROM (SELECT *, row_number() OVER (PARTITION BY sheet, campo ORDER BY r, col_no) rn
  FROM h JOIN a ON contains(upper(strip_accents(header)), alias)) WHERE rn = 1""".replace("{'", "{{'").replace("'}", "'}}"))
def s6(t):
    names = ["2. NÚMERO DE CONTRATO", "LINK", "28.VALOR INICIAL DEL CONTRATO (TOTAL)", "36. VALOR TOTAL", "Estado del Contrato", "5. fecha suscripción"]
    heads = F.explode(F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(h).alias("header")) for i, h in enumerate(names, 1)]))
    return SC.resolve_headers(t.ledger.select("sheet").distinct().select("sheet", heads.alias("x")).select("sheet", "x.*"))


def _parsed_portal(t):
    """Pages as landed snapshot documents: JSON text keyed by notice."""
    p = t.portal
    entry = F.struct(
        F.create_map(F.lit("titulo"), F.col("titulo"), F.lit("tipo_proceso"), F.col("tipo_proceso"), F.lit("numero_proceso"), F.col("numero_proceso")).alias("fields"),
        F.create_map(F.lit("Titulo"), F.col("titulo"), F.lit("Estado"), F.col("status")).alias("all_labels"),
        F.array(F.struct(F.concat(F.lit("doc-"), "seq").alias("name"), F.col("url").alias("url"))).alias("documents"),
        F.col("status").alias("status"), F.array_compact(F.array(F.when(F.col("numero_proceso").isNull(), F.lit("numero_proceso")))).alias("missing_fields"),
        F.col("scraped_at").cast("string").alias("scraped_at"))
    return SC.explode_snapshots(p.select(F.to_json(F.create_map("notice_id", entry)).alias("value")))


@query("S7_snapshot_documents", "SELECT notice_id, titulo, status, CAST(scraped_at AS VARCHAR) scraped_at, concat('doc-', seq) primer_doc FROM {portal}")
def s7(t):
    return _parsed_portal(t).select("notice_id", F.col("fields")["titulo"].alias("titulo"), "status", "scraped_at", F.get("documents", F.lit(0))["name"].alias("primer_doc"))


@query("S7_snapshot_files", """
SELECT notice_id, CASE WHEN status IS NOT NULL THEN titulo END titulo, status, CASE WHEN status IS NOT NULL THEN CAST(scraped_at AS VARCHAR) END scraped_at,
  CASE WHEN status = 'ok_completo' THEN concat('doc-', seq) END primer_doc FROM {portal}""")
def s7_files(t):
    """Documents of up to 64 notices in files of their own; notices without a status are null, failed ones lack their documents."""
    folder = run_folder(t.spark)
    parts = [F.struct(F.create_map(F.lit("titulo"), F.col("titulo")).alias("fields")), F.struct(F.array(F.struct(F.concat(F.lit("doc-"), "seq").alias("name"))).alias("documents"))]
    entry = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(
        F.regexp_extract(F.to_json(parts[0]), r"^\{(.*)\}$", 1), F.when(F.col("status") == "ok_completo", F.regexp_extract(F.to_json(parts[1]), r"^\{(.*)\}$", 1)),
        F.regexp_extract(F.to_json(F.struct("status", F.col("scraped_at").cast("string").alias("scraped_at"))), r"^\{(.*)\}$", 1))), ",\n  "), F.lit("}"))
    one = F.concat(F.lit('"'), "notice_id", F.lit('": '), F.when(F.col("status").isNull(), "null").otherwise(entry))
    docs = t.portal.groupBy(F.expr("seq div 64").alias("archivo")).agg(F.concat(F.lit("{\n"), F.array_join(F.collect_list(one), ",\n"), F.lit("\n}")).alias("value"))
    docs.write.partitionBy("archivo").text(f"{folder}/fotos")
    d = SC.scan_snapshots(t.spark, f"{folder}/fotos")
    return d.select("notice_id", F.try_element_at("fields", F.lit("titulo")).alias("titulo"), "status", "scraped_at", F.get("documents", F.lit(0))["name"].alias("primer_doc"))


@query("S8_event_log", "SELECT pos, op, chain_id, nuevo FROM {bitacora}")
def s8(t):
    folder = run_folder(t.spark)
    log = t.bitacora.select("pos", "ts", "op", F.col("chain_id").cast("string").alias("process_id"), F.col("nuevo").alias("new"))
    log.write.json(f"{folder}/log")
    d = SC.scan_log(t.spark, f"{folder}/log")
    return d.select("pos", "op", F.col("process_id").cast("bigint").alias("chain_id"), F.col("new").alias("nuevo"))


@query("S9_snapshot_index", """
SELECT notice_id, status, CAST(scraped_at AS VARCHAR) scraped_at, 2 campos, 1 documentos, CASE WHEN numero_proceso IS NULL THEN 'numero_proceso' ELSE '' END faltantes FROM {portal}""")
def s9(t):
    return SC.snapshot_index(_parsed_portal(t))


_BLOBS = ["'%PDF-1.7 '", "'GIF89a'", "'BMxx'", "'<div>displayAlert error</div>'", "'window.location.href=1 '", "''", "'plain text '"]


@query("S10_file_sniff", f"""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'gif' WHEN 2 THEN 'bmp' WHEN 3 THEN 'error_page'
  WHEN 4 THEN CASE WHEN regexp_matches(left(html, 170), '(?i)<html|<!doctype') THEN 'html' ELSE 'html_redirect' END
  WHEN 5 THEN 'html' ELSE CASE WHEN regexp_matches(left(html, 180), '(?i)<html|<!doctype') THEN 'html' ELSE 'unknown' END END tipo FROM pages""")
def s10(t):
    head = F.lit("plain text ")
    for i, b in enumerate(_BLOBS[:6]):
        head = F.when(F.col("page_id") % 7 == i, F.lit(b.strip("'"))).otherwise(head)
    return t.pages.select("page_id", D.sniff(F.encode(F.concat(head, "html"), "UTF-8")).alias("tipo"))


#: First bytes of the written files, as text in ISO-8859-1, and the type they must be given.
_FILES = {"informe": ("%PDF-1.7 ", "pdf"), "anexos": ("PK\x03\x04", "zip"), "foto": ("\xff\xd8\xff\xe0", "jpg"), "plano": ("\x89PNG", "png"), "logo": ("GIF89a", "gif"), "mapa": ("BMxx", "bmp"),
          "fallo": ("<div>displayAlert Error</div>", "error_page"), "portal": ("<!DOCTYPE html>", "html"), "salto": ("<script>window.location.href=1</script>", "html_redirect"), "texto": ("plain text ", "unknown")}


@query("S10_sniff_files", "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, '{v[1]}')" for i, (k, v) in enumerate(_FILES.items())) + """) v(clase, i, tipo))
SELECT clase, tipo, sum(CAST(length(url) AS BIGINT)) > 0 con_datos FROM pages JOIN k ON page_id % 10 = i GROUP BY 1, 2""")
def s10_files(t):
    """Files of every kind, written from the pages' links with the first bytes of their kind."""
    folder = run_folder(t.spark)
    for i, (kind, (magic, _)) in enumerate(_FILES.items()):
        rows = t.pages.where(F.col("page_id") % 10 == i).select(F.concat(F.lit(magic), "url"))
        rows.coalesce(1).write.option("encoding", "ISO-8859-1").option("quote", "\u0000").option("escapeQuotes", "false").csv(f"{folder}/{kind}")
    found = SC.sniff_files(t.spark, f"{folder}/*")
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("clase"), "tipo", (F.col("length") > 0).alias("con_datos"))


# ---- Sinks ------------------------------------------------------------------


def _ledger_by_process(t):
    """Newest ledger row of each process, as the table fills are applied to."""
    from contrapunto.operators import ordering as O
    d = t.ledger.withColumn("process_id", F.concat(F.lit("CO1.NTC."), "custkey"))
    return O.latest(d, ["process_id"], [F.desc("sheet_ord"), F.desc("row_no")])


def _main_fills(t):
    from contrapunto.operators import ordering as O
    m = O.latest(t.contratos, ["process_id"], [F.desc_nulls_last("fecha_firma"), "seq"])
    return m.select("process_id", F.when(F.col("estado") != "Cerrado", F.col("estado")).alias("estado"), F.col("valor").cast("string").alias("valor_total"), F.col("objeto"))


_LP = """
l AS (SELECT * FROM (SELECT concat('CO1.NTC.', custkey) process_id, *, row_number() OVER (PARTITION BY custkey ORDER BY sheet_ord DESC, row_no DESC) rn FROM {ledger}) WHERE rn = 1),
m AS (SELECT process_id, CASE WHEN estado <> 'Cerrado' THEN estado END estado, CAST(valor AS VARCHAR) valor_total, objeto FROM
  (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY fecha_firma DESC NULLS LAST, seq) rn FROM {contratos}) WHERE rn = 1)
"""


@query("K1_apply_fills", _LP + """
SELECT l.process_id, sheet, numero, coalesce(m.estado, l.estado) estado, coalesce(m.valor_total, l.valor_total) valor_total, m.objeto FROM l LEFT JOIN m USING (process_id)""")
def k1(t):
    ledger = _ledger_by_process(t).select("process_id", "sheet", "numero", "estado", "valor_total")
    return SK.apply_fills(ledger, _main_fills(t), ["process_id"])


@query("K6_rebuild", _LP + "SELECT l.process_id, sheet, numero, m.estado, m.valor_total, m.objeto FROM l LEFT JOIN m USING (process_id)")
def k6(t):
    return SK.rebuild(_ledger_by_process(t), _main_fills(t), ["process_id"], ["sheet", "numero"])


def _stored(t):
    folder = run_folder(t.spark) + "/fotos"
    SK.save_snapshot(t.foto_vieja, folder, OLD_STAMP)
    SK.save_snapshot(t.foto_vieja, folder, NEW_STAMP)
    SK.save_snapshot(t.foto_nueva, folder, NEW_STAMP)
    return SK.read_snapshots(t.spark, folder)


@query("K2_daily_snapshot", f"""
SELECT '{OLD_STAMP}' stamp, count(*) filas FROM {{foto_vieja}} UNION ALL SELECT '{NEW_STAMP}', count(*) FROM {{foto_nueva}}""")
def k2(t):
    return _stored(t).groupBy(F.col("stamp").cast("string").alias("stamp")).agg(F.count("*").alias("filas"))


@query("W7_previous_snapshot", "SELECT id_contrato, estado FROM {foto_vieja}")
def w7(t):
    return SK.previous_snapshot(_stored(t), NEW_STAMP).select("id_contrato", "estado")


_SUMMARY = "concat_ws('; ', 'estado=' || estado, 'fecha_firma=' || CAST(fecha_firma AS VARCHAR), 'proveedor=' || proveedor, 'valor=' || CAST(valor AS VARCHAR))"


@query("K3_publish_index", f"""
k AS (SELECT 'notice' clase, nullif(regexp_extract(url_contrato, 'CO1\\.NTC\\.\\d+'), '') clave, seq, {_SUMMARY} resumen FROM {{integrado}}
  UNION ALL SELECT 'contrato', numero_del_contrato, seq, {_SUMMARY} FROM {{integrado}})
SELECT clase, clave, resumen FROM (SELECT *, row_number() OVER (PARTITION BY clase, clave ORDER BY seq DESC) rn FROM k WHERE clave IS NOT NULL) WHERE rn = 1""")
def k3(t):
    return SK.publish_index(t.integrado, "url_contrato", "numero_del_contrato", "seq", ["valor", "fecha_firma", "proveedor", "estado"])


@query("K4_export_view", """
SELECT CAST(year(fecha_firma) AS VARCHAR) "Vigencia", concat('Hoja ', year(fecha_firma)) "Hoja", referencia "Numero Contrato", process_id "Process ID",
  coalesce(nullif(regexp_extract(url, 'CO1\\.NTC\\.\\d+'), ''), '') "Notice UID", objeto "Objeto", proveedor "Proveedor", valor "Valor (COP)", CAST(fecha_firma AS VARCHAR) "Fecha de firma",
  estado "Estado", modalidad "Modalidad", dias_adicionados "Dias adicionados", CASE WHEN liquidacion = 'Si' THEN 'Si' ELSE 'No' END "Liquidado",
  concat_ws(' · ', CASE WHEN estado = 'Modificado' THEN 'Modificado' END, CASE WHEN dias_adicionados > 0 THEN '+' || dias_adicionados || ' días' END, CASE WHEN liquidacion = 'Si' THEN 'Liquidado' END) "Notas",
  CASE estado WHEN 'Cerrado' THEN 'Datos abiertos' WHEN 'Modificado' THEN 'Portal (copia)' ELSE 'Sin datos publicos' END "Origen del dato", url "URL del proceso" FROM {contratos}""")
def k4(t):
    src = F.when(F.col("estado") == "Cerrado", "api").when(F.col("estado") == "Modificado", "portal").otherwise("none")
    d = t.contratos.withColumns({"vigencia": F.year("fecha_firma"), "sheet": F.concat(F.lit("Hoja "), F.year("fecha_firma")), "notice_id": notice_id("url"),
                                 "data_source": src, "notas": B.contract_note(legal=False)})
    return SK.export_view(d)


_RAW = "CASE WHEN cerrada THEN {} END"


@query("K4_U6_export_raw", "SELECT page_id, " + ", ".join(f'{_RAW.format(v)} "{k}"' for k, v in {
    "field.titulo": "nullif(titulo, '')", "field.fase": "fase", "field.numero_proceso": "'NP-' || page_id",
    "field.valor_total": "CASE WHEN con_valor THEN '$ ' || page_id || '.000.000' END",
    "label.Titulo": "titulo", "label.Fase": "fase", "label.Numero del proceso": "'NP-' || page_id",
    "label.Valor total": "CASE WHEN con_valor THEN '$ ' || page_id || '.000.000' ELSE '' END"}.items()) + " FROM {paginas}")
def k4_raw(t):
    """All columns, as found in the pages."""
    return SK.export_raw(P.parse_pages(portal_pages(t), "page_id", "html"), ["page_id"], {"fields": "field", "all_labels": "label"})


@query("U6_raw_columns", """
SELECT DISTINCT unnest(list_filter([CASE WHEN cerrada AND titulo <> '' THEN 'field.titulo' END, CASE WHEN cerrada AND fase IS NOT NULL THEN 'field.fase' END, CASE WHEN cerrada THEN 'field.numero_proceso' END,
  CASE WHEN cerrada AND con_valor THEN 'field.valor_total' END, CASE WHEN cerrada THEN 'label.Titulo' END, CASE WHEN cerrada THEN 'label.Fase' END, CASE WHEN cerrada THEN 'label.Numero del proceso' END,
  CASE WHEN cerrada THEN 'label.Valor total' END], lambda x: x IS NOT NULL)) columna FROM {paginas}""")
def u6_columns(t):
    return SK.raw_columns(P.parse_pages(portal_pages(t), "page_id", "html"), {"fields": "field", "all_labels": "label"})


# ---- Filters ----------------------------------------------------------------


@query("F1_facets", """
SELECT id_contrato FROM {contratos} WHERE estado IN ('Cerrado', 'Modificado') AND modalidad IN ('1-URGENT', '2-HIGH')
  AND (year(fecha_firma) IN (1996, 1998) OR year(fecha_fin) IN (1996, 1998))""")
def f1(t):
    d = t.contratos.withColumn("vigencias", F.array(F.year("fecha_fin").cast("string")))
    return FL.facet_filter(d, {"estado": ["Cerrado", "Modificado"], "modalidad": ["1-URGENT", "2-HIGH"], "objeto": []}, ["1996", "1998"]).select("id_contrato")


@query("F2_search", """
SELECT id_contrato FROM {contratos} WHERE contains(lower(concat_ws(' ', id_contrato, process_id, referencia, objeto, proveedor)), 'temporal norte 1')""")
def f2(t):
    return FL.search(t.contratos, "Temporal Norte 1", ["id_contrato", "process_id", "referencia", "objeto", "proveedor"]).select("id_contrato")


@query("F3_search_all", "SELECT * FROM customer WHERE regexp_matches(c_name, '(?i)r#0+12') OR regexp_matches(c_mktsegment, '(?i)r#0+12')")
def f3(t):
    return FL.search_all(t.customer, "r#0+12")


@query("F3_lookup_answer", """
SELECT count(*) coincidencias, CASE WHEN count(*) = 0 THEN 'ninguna' WHEN count(*) > 5 THEN 'demasiadas' ELSE 'ok' END estado
FROM customer WHERE contains(lower(c_name), 'customer#00000001') OR contains(lower(c_mktsegment), 'customer#00000001')""")
def f3_answer(t):
    return FL.lookup_answer(t.customer.select("c_name", "c_mktsegment"), "Customer#00000001")


@query("F4_column_filter", "SELECT id_contrato FROM {contratos} WHERE estado IN ('Cerrado') AND contains(lower(proveedor), 'vial 7')")
def f4(t):
    return FL.column_filter(t.contratos, {"estado": ["Cerrado"]}, {"proveedor": "Vial 7"}).select("id_contrato")


@query("F5_expiring", f"SELECT id_contrato, fecha_fin FROM {{contratos}} WHERE datediff('day', DATE '{AS_OF}', fecha_fin) BETWEEN 0 AND 30")
def f5(t):
    return FL.expiring(t.contratos, AS_OF).select("id_contrato", "fecha_fin")


@query("F6_attention", f"""
SELECT id_contrato, estado = 'Modificado' OR dias_adicionados > 0 modificado, datediff('day', DATE '{AS_OF}', fecha_fin) BETWEEN 0 AND 30 vence FROM {{contratos}}
WHERE estado = 'Modificado' OR dias_adicionados > 0 OR datediff('day', DATE '{AS_OF}', fecha_fin) BETWEEN 0 AND 30""")
def f6(t):
    return FL.attention(t.contratos, AS_OF).select("id_contrato", "modificado", "vence")


def _appearances(t):
    return t.ledger.select(F.col("custkey").alias("item"), "sheet", "row_no")


@query("F7_sheet_process", "SELECT c_custkey item FROM customer WHERE c_custkey IN (SELECT custkey FROM {ledger} WHERE sheet IN ('Hoja 1996', 'Hoja 1999'))")
def f7(t):
    return FL.by_sheet(t.customer.select(F.col("c_custkey").alias("item")), _appearances(t), ["Hoja 1996", "Hoja 1999"])


@query("F7_sheet_appearance", "SELECT custkey item, sheet, row_no FROM {ledger} WHERE sheet IN ('Hoja 1996')")
def f7_app(t):
    return FL.by_sheet(t.customer.select(F.col("c_custkey").alias("item")), _appearances(t), ["Hoja 1996"], "appearance")


@query("F8_amended", "SELECT id_contrato FROM {contratos} WHERE estado = 'Modificado' OR dias_adicionados > 0")
def f8(t):
    return FL.amended(t.contratos).select("id_contrato")


@query("F9_pending", """
w AS (SELECT DISTINCT coalesce(notice_id, CASE WHEN process_id LIKE 'CO1.NTC.%' THEN process_id END) n FROM {watch})
SELECT n notice_id FROM w WHERE n IS NOT NULL AND n NOT IN (SELECT notice_id FROM {portal} WHERE status IS NULL OR status = 'ok_completo')""")
def f9(t):
    return FL.pending(t.watch, t.portal)


@query("F11_list_watched", "SELECT url, process_id, vigencia FROM {watch} WHERE sheet = 'Hoja 1997' AND vigencia = '1997'")
def f11(t):
    return FL.list_watched(t.watch, "Hoja 1997", "1997").select("url", "process_id", "vigencia")


@query("F12_log_tail", "SELECT pos, op FROM {bitacora} WHERE op = 'replace' ORDER BY pos DESC LIMIT 200")
def f12(t):
    return FL.log_tail(t.bitacora, "replace", 200).select("pos", "op")


@query("A15_watch_summary", """
SELECT 'total' grupo, '' clave, count(*) n FROM {watch} UNION ALL SELECT 'sin_aviso', '', count(*) FROM {watch} WHERE notice_id IS NULL
UNION ALL SELECT 'hoja', sheet, count(*) FROM {watch} GROUP BY 2 UNION ALL SELECT 'vigencia', vigencia, count(*) FROM {watch} GROUP BY 2""")
def a15(t):
    from contrapunto.operators.views import watch_summary
    return watch_summary(t.watch)


@query("A14_sheet_counts", """
SELECT hoja, count(*) n FROM (SELECT sheet hoja FROM {ledger} UNION ALL
  SELECT coalesce(CASE WHEN c_acctbal > 5000 THEN NULL ELSE sheet END, '(sin hoja)') FROM {watch} JOIN customer ON c_custkey = seq WHERE seq NOT IN (SELECT custkey FROM {ledger})) GROUP BY 1""")
def a14(t):
    from contrapunto.operators.views import sheet_counts
    w = t.watch.join(t.customer, F.col("c_custkey") == F.col("seq")).select(F.col("seq").alias("item"), F.when(F.col("c_acctbal") <= 5000, F.col("sheet")).alias("sheet"))
    return sheet_counts(w, _appearances(t))


@query("A26_facet_options", """
SELECT 'anio' faceta, a opcion FROM (SELECT DISTINCT CAST(year(fecha_firma) AS VARCHAR) a FROM {contratos} UNION SELECT DISTINCT CAST(year(fecha_fin) AS VARCHAR) FROM {contratos})
UNION ALL SELECT DISTINCT 'estado', estado FROM {contratos} UNION ALL SELECT DISTINCT 'modalidad', modalidad FROM {contratos} UNION ALL SELECT DISTINCT 'hoja', concat('Hoja ', year(fecha_firma)) FROM {contratos}""")
def a26(t):
    from contrapunto.operators.views import facet_options
    d = t.contratos.withColumns({"vigencias": F.array(F.year("fecha_fin").cast("string")), "hojas": F.array(F.concat(F.lit("Hoja "), F.year("fecha_firma")))})
    return facet_options(d)
