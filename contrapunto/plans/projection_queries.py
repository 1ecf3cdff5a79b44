"""Queries of the identifier, money, date, text and block projections (P*, E1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapunto import schemas as S
from contrapunto.functions import dates as DT
from contrapunto.functions import identifiers as I
from contrapunto.functions import money as M
from contrapunto.functions import text as TX
from contrapunto.operators import blocks as B
from contrapunto.operators import fill as FI
from contrapunto.operators import pages as P
from contrapunto.operators import resolve as R
from contrapunto.operators import rollups as RU
from contrapunto.plans.analogs import AS_OF, portal_pages
from contrapunto.plans.registry import pct_sql, query

_ID = "CO1\\.[A-Z]+\\.[0-9A-Za-z]+"


def _by_key(key: str) -> str:
    return f"nullif(regexp_extract(url, '(?i:[?&]{key}=)({_ID})(?:&|#|$)', 1), '')"


@query("P1_parse_links", f"""
i AS (SELECT page_id, coalesce({_by_key('noticeuid')}, {_by_key('noticeid')}, {_by_key('ppi')}, {_by_key('processid')}, {_by_key('pccntr')}, nullif(regexp_extract(url, '{_ID}'), '')) id FROM {{enlaces}})
SELECT page_id, id, split_part(id, '.', 2) kind, CASE WHEN id IS NULL THEN 'sin_identificador' END error FROM i""")
def p1(t):
    d = t.enlaces.withColumn("id", I.link_id("url"))
    return d.select("page_id", "id", I.id_kind("id").alias("kind"), F.when(F.col("id").isNull(), "sin_identificador").alias("error"))


@query("P2_canonical_url", """
u AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+)://', 1) sch, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) host,
   regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) path, string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') q FROM {enlaces}),
f AS (SELECT *, list_filter(q, lambda x: regexp_matches(x, '^[^=]+=.+') AND lower(split_part(x, '=', 1)) NOT IN ('ismodal', 'isfrompublicarea', 'currentlanguage', 'skinname', 'country', 'page')) p FROM u),
g AS (SELECT *, list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: split_part(y, '=', 1)), split_part(x, '=', 1)) = i) k FROM f),
h AS (SELECT *, array_to_string(list_sort(list_transform(k, lambda x: split_part(x, '=', 1) || '=' || replace(url_encode(url_decode(regexp_extract(x, '=(.*)$', 1))), '%20', '+'))), '&') e FROM g)
SELECT page_id, lower(sch) || '://' || lower(host) || path || CASE WHEN e <> '' THEN '?' || e ELSE '' END url FROM h""")
def p2(t):
    return t.enlaces.select("page_id", I.canonical_url("url").alias("url"))


@query("P3_infer_process_id", """
SELECT page_id, upper(coalesce(nullif(regexp_extract(url, '(?i)CO1\\.NTC\\.\\d+'), ''), nullif(regexp_extract(url, '(?i)CO1\\.PCCNTR\\.\\d+'), ''),
  nullif(regexp_extract(url, '(?i)CO1\\.PPI\\.\\d+'), ''), nullif(regexp_extract(url, '(?i)CO1\\.REQ\\.\\d+'), ''))) process_id FROM {enlaces}""")
def p3(t):
    return t.enlaces.select("page_id", I.infer_process_id("url").alias("process_id"))


@query("P4_extract_keys", """
SELECT seq, nullif(regexp_extract(url_contrato, 'CO1\\.NTC\\.\\d+'), '') notice, nullif(upper(regexp_extract(url_contrato, '(?i)CO1\\.PCCNTR\\.\\d+')), '') contrato FROM {integrado}""")
def p4(t):
    return t.integrado.select("seq", I.notice_id("url_contrato").alias("notice"), I.contract_id("url_contrato").alias("contrato"))


@query("P5_resolve_pivot", """
m AS (SELECT 'CO1.PPI.' || page_id piv, CASE WHEN url LIKE 'https:%' THEN 'CO1.NTC.' || page_id END n FROM pages)
SELECT w.process_id, CASE WHEN w.process_id LIKE 'CO1.PPI.%' THEN n END notice, CASE WHEN w.process_id NOT LIKE 'CO1.PPI.%' THEN 'no_pivote'
  WHEN n IS NOT NULL THEN 'resuelto' WHEN piv IS NOT NULL THEN 'sin_aviso' ELSE 'sin_captura' END via
FROM {watch} w LEFT JOIN m ON w.process_id = m.piv WHERE w.process_id IS NOT NULL""")
def p5(t):
    html = F.when(F.col("url").startswith("https:"), F.concat("html", F.lit(" CO1.NTC."), "page_id")).otherwise(F.col("html"))
    m = R.pivot_mapping(t.pages.select(F.concat(F.lit("CO1.PPI."), "page_id").alias("ppi"), html.alias("html")), "ppi", "html")
    return R.resolve_pivot(t.watch.where("process_id is not null"), m).select("process_id", "notice", "via")


def _money_sql() -> str:
    d = "length(s) - length(replace(s, '.', ''))"
    c = "length(s) - length(replace(s, ',', ''))"
    nodot, nocom = "replace(s, '.', '')", "replace(s, ',', '')"
    num = lambda x: f"try_cast({x} AS DECIMAL(38,2))"
    auto = f"""CASE WHEN {d} > 1 AND {c} = 0 THEN {num(nodot)} WHEN {d} > 1 AND {c} = 1 THEN {num(f"replace({nodot}, ',', '.')")}
      WHEN {c} > 1 AND {d} <= 1 THEN {num(nocom)} WHEN {c} = 1 AND {d} = 0 AND regexp_matches(s, ',\\d{{3}}$') THEN {num(nocom)}
      WHEN {c} = 1 AND {d} = 0 THEN {num("replace(s, ',', '.')")} ELSE {num('s')} END"""
    cross = f"""CASE WHEN {d} > 0 AND {c} > 0 THEN {num(f"replace({nodot}, ',', '.')")} WHEN {c} = 1 AND regexp_matches(s, ',[^,]{{0,2}}$') THEN {num("replace(s, ',', '.')")}
      WHEN {c} > 0 THEN {num(nocom)} WHEN {d} > 1 OR ({d} = 1 AND regexp_matches(s, '\\.[^.]{{3}}$')) THEN {num(nodot)} ELSE {num('s')} END"""
    q = lambda x: x.replace("{", "{{").replace("}", "}}")
    sub = lambda e, src: f"(SELECT {e} FROM (SELECT {src} s) z)"
    pesos = num("regexp_replace(texto, '\\D', '', 'g')")
    return "SELECT seq, " + ", ".join([
        q(sub(auto, "regexp_replace(texto, '[$\\s]|(?i:COP)', '', 'g')")) + " auto", q(sub(cross, "regexp_replace(texto, '[$ ]', '', 'g')")) + " cruce",
        num("replace(replace(regexp_replace(texto, '[^\\d.,-]', '', 'g'), '.', ''), ',', '.')") + " co",
        num("trim(regexp_replace(texto, '[,$]', '', 'g'))") + " plano",
        f"CASE WHEN {pesos} BETWEEN 100000 AND 10000000000000 THEN {pesos} END pesos"]) + " FROM {montos}"


@query("P6_money_modes", _money_sql())
def p6(t):
    names = {"auto": "auto", "cross": "cruce", "co": "co", "plain": "plano", "pesos": "pesos"}
    return t.montos.select("seq", *[M.parse_money("texto", m).alias(n) for m, n in names.items()])


@query("P7_tolerant_numbers", """
SELECT seq, try_cast(replace(texto, ',', '') AS DOUBLE) numero, CAST(coalesce(trunc(try_cast(replace(texto, ',', '') AS DOUBLE)), 0) AS BIGINT) entero FROM {montos}""")
def p7(t):
    return t.montos.select("seq", M.to_num("texto").alias("numero"), M.to_int0("texto").alias("entero"))


@query("P8_norm_date", """
SELECT seq, CAST(strptime(regexp_extract(fecha_texto, '^\\d+/\\d+/\\d+'), '%d/%m/%Y') AS DATE) fecha,
  CASE status WHEN 'ok_completo' THEN scraped_at WHEN 'ok_parcial' THEN NULL END fecha_iso FROM {portal_contratos}""")
def p8(t):
    iso = F.when(F.col("status") == "ok_completo", F.concat(F.col("scraped_at").cast("string"), F.lit("T00:00:00.000 | 1999-01-01"))).otherwise("sin fecha")
    return t.portal_contratos.select("seq", DT.norm_date("fecha_texto").alias("fecha"), DT.norm_date(iso).alias("fecha_iso"))


@query("P9_spanish_dates", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END fecha FROM orders""")
def p9(t):
    names = list(S.MONTHS_ES)
    names.remove("setiembre")
    month = F.try_element_at(F.array(*[F.lit(m) for m in names]), F.month("o_orderdate"))
    text = F.concat(F.lit("Bogotá, "), F.dayofmonth("o_orderdate"), F.lit(" de "), F.initcap(month), F.lit(" de "), F.year("o_orderdate"), F.lit(" ante notario"))
    text = F.when(F.col("o_orderpriority") == "5-LOW", "sin fecha 31 de brumario de 1999").otherwise(text)
    return t.orders.select("o_orderkey", DT.norm_date_es(text).alias("fecha"))


@query("P10_years", """
SELECT row_no, CAST(year(fecha_suscripcion) AS VARCHAR) anio, CAST(sheet_ord AS VARCHAR) anio_hoja FROM {ledger}""")
def p10(t):
    return t.ledger.select("row_no", DT.year_of("fecha_suscripcion").alias("anio"), DT.sheet_year("sheet").alias("anio_hoja"))


@query("P11_fold", "SELECT doc_id, upper(strip_accents(nombre)) plegado FROM {archivos}")
def p11(t):
    return t.archivos.select("doc_id", TX.fold("nombre").alias("plegado"))


@query("P12_norm_for_compare", """
SELECT row_no, coalesce(CAST(CAST(round(try_cast(replace(valor_total, ',', '') AS DECIMAL(38,2)), 2) AS DECIMAL(38,2)) AS VARCHAR), '') valor,
  left(CAST(fecha_suscripcion AS VARCHAR) || ' 00:00:00', 10) fecha, CASE WHEN estado = 'n/a' THEN '' ELSE upper(estado) END texto FROM {ledger}""")
def p12(t):
    n = FI.norm_for_compare
    date = F.concat(F.col("fecha_suscripcion").cast("string"), F.lit(" 00:00:00"))
    return t.ledger.select("row_no", n("valor_total", F.lit("valor_total")).alias("valor"), n(date, F.lit("fecha_suscripcion")).alias("fecha"), n("estado", F.lit("estado")).alias("texto"))


@query("P13_placeholders", """
SELECT id_contrato, CASE WHEN lower(tipodoc) = 'no definido' THEN NULL ELSE tipodoc END tipodoc, g.tipo FROM {contratos}
LEFT JOIN (SELECT id_contrato, max(nullif(tipo, 'No definido')) tipo FROM {garantias} GROUP BY 1) g USING (id_contrato)""")
def p13(t):
    g = t.garantias.groupBy("id_contrato").agg(F.max(TX.null_placeholder("tipo")).alias("tipo"))
    return t.contratos.select("id_contrato", TX.null_placeholder("tipodoc").alias("tipodoc")).join(g, "id_contrato", "left")


@query("P14_clean_links", "SELECT row_no, url FROM {ledger} WHERE contains(lower(url), 'portal.example.org')")
def p14(t):
    dirty = F.concat(F.left("url", F.lit(9)), F.lit("\n\t"), F.substr("url", F.lit(10)), F.lit(" "))
    d = t.ledger.select("row_no", I.strip_controls(dirty).alias("url"))
    return d.where(I.contains_link_of("url", "Portal.example.org"))


@query("P15_sequence_labels", """
SELECT row_no, CASE WHEN numero LIKE 'contrato%' AND row_no <= 99999 THEN 'CONTRATO-ENT-' || lpad(CAST(row_no AS VARCHAR), CAST(greatest(4, length(CAST(row_no AS VARCHAR))) AS INT), '0') || '-' || sheet_ord
  WHEN numero NOT LIKE 'contrato%' AND vigencia IS NOT NULL AND row_no BETWEEN 1 AND 99999 THEN 'CONTRATO-ENT-' || lpad(CAST(row_no AS VARCHAR), CAST(greatest(4, length(CAST(row_no AS VARCHAR))) AS INT), '0') || '-' || vigencia END etiqueta FROM {ledger}""")
def p15(t):
    return t.ledger.select("row_no", I.norm_sequence("numero", "vigencia", "CONTRATO-ENT").alias("etiqueta"))


_DV = """substr('01987654321', CAST((SELECT sum(CAST(substr(reverse(x), i::INT, 1) AS INT) * list_extract([3,7,13,17,19,23,29,37,41,43,47,53,59,67,71], i::INT))
  FROM unnest(range(1, length(x) + 1)) u(i)) % 11 AS INT) + 1, 1)"""


@query("P16_check_digit", f"SELECT c_custkey, {_DV.replace('x', 'CAST(800000000 + c_custkey * 7919 AS VARCHAR)')} dv FROM customer".replace("eCAST(800000000 + c_custkey * 7919 AS VARCHAR)tract", "extract"))
def p16(t):
    n = (F.col("c_custkey") * 7919 + 800000000).cast("string")
    dotted = F.concat(F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 3), F.lit("."), F.substring(n, 7, 20))
    return t.customer.select("c_custkey", I.check_digit(dotted).alias("dv"))


@query("P17_clean_taxid", """
SELECT s_suppkey, CAST(900000000 + s_suppkey * 31 AS VARCHAR) limpio, s_nationkey <> 3 coincide FROM supplier""")
def p17(t):
    n = (F.col("s_suppkey") * 31 + 900000000).cast("string")
    a = F.concat(F.lit("NIT: 00"), F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 20))
    b = F.when(F.col("s_nationkey") == 3, F.lit("12")).when(F.col("s_nationkey") == 4, F.concat(n, F.lit("-7"))).otherwise(n)
    return t.supplier.select("s_suppkey", I.clean_taxid(a).alias("limpio"), I.taxid_match(a, b).alias("coincide"))


@query("P18_derive_party", """
SELECT id_contrato, CASE tipodoc WHEN 'NIT' THEN 'Jurídica' WHEN 'CC' THEN 'Natural' END naturaleza,
  CASE modalidad WHEN '1-URGENT' THEN 'Consorcio' WHEN '2-HIGH' THEN 'Unión Temporal' ELSE 'No' END agrupacion, CASE liquidacion WHEN 'Si' THEN 'Sí' ELSE 'No' END liquida FROM {contratos}""")
def p18(t):
    return t.contratos.select("id_contrato", I.party_nature("tipodoc").alias("naturaleza"), I.party_group("proveedor").alias("agrupacion"), I.yes_no("liquidacion").alias("liquida"))


@query("P19_extras", """
SELECT id_contrato, concat_ws(' | ', 'anticipo=' || anticipo, 'documento=' || documento, 'modalidad=' || modalidad, 'objeto=' || objeto, CASE WHEN tipodoc <> 'No Definido' THEN 'tipodoc=' || tipodoc END) otros FROM {contratos}""")
def p19(t):
    d = t.contratos.select("id_contrato", "tipodoc", "documento", "objeto", "modalidad", "anticipo", "estado")
    return d.select("id_contrato", B.extras(d, ["id_contrato", "estado"]).alias("otros"))


@query("P20_P21_contract_notes", """
SELECT id_contrato, concat_ws(' · ', CASE WHEN contains(estado, 'Modificad') THEN 'Modificado' END, CASE WHEN dias_adicionados > 0 THEN '+' || dias_adicionados || ' días' END,
   CASE WHEN liquidacion <> 'Si' AND estado <> 'Cerrado' THEN 'Sin legalización' END, CASE WHEN liquidacion = 'Si' THEN 'Liquidado' END) nota,
  contains(estado, 'Modificad') OR dias_adicionados > 0 es_modificado, liquidacion <> 'Si' AND estado <> 'Cerrado' es_no_leg FROM {contratos}""")
def p20(t):
    return B.contract_flags(t.contratos).select("id_contrato", B.contract_note().alias("nota"), "es_modificado", "es_no_leg")


@query("P22_amendment_sentence", """
s AS (SELECT id_contrato, count(*) cantidad, string_agg(DISTINCT tipo, ', ' ORDER BY tipo) tipos, sum(valor) valor, sum(dias) dias, max(fecha) f FROM {adiciones} GROUP BY 1)
SELECT id_contrato, concat_ws('. ', cantidad || ' ' || CASE WHEN cantidad = 1 THEN 'modificatorio' ELSE 'modificatorios' END || ' en la fuente (' || tipos || ')',
   CASE WHEN valor <> 0 THEN 'valor acumulado $' || format('{{:,.0f}}', valor::DOUBLE) END, CASE WHEN dias <> 0 THEN '+' || dias || ' día(s)' END, 'último ' || CAST(f AS VARCHAR)) nota FROM s""")
def p22(t):
    from contrapunto.operators import ordering as O
    s = t.adiciones.groupBy("id_contrato").agg(F.count("*").alias("cantidad"), F.sum("valor").cast(S.TOTAL).alias("valor"), F.sum("dias").alias("dias"), F.max("fecha").alias("fecha_ultima"))
    d = s.join(O.joined(t.adiciones, ["id_contrato"], "tipo", "tipos", "; "), "id_contrato").withColumn("hubo", F.lit("Sí"))
    return d.select("id_contrato", RU.amendment_note(d).alias("nota"))


@query("P23_verify_status", """
SELECT url, process_id, CASE WHEN contains(url, 'CO1ContractsManagement') THEN 'contrato_interno' WHEN coalesce(notice_id, process_id) IN (SELECT notice_id FROM {portal}) THEN 'verificado'
  WHEN process_id LIKE 'CO1.REQ.%' OR process_id LIKE 'CO1.BDOS.%' THEN 'borrador' ELSE 'no_en_api' END estado_verificacion FROM {watch}""")
def p23(t):
    return B.verify_status(t.watch, t.portal).select("url", "process_id", "estado_verificacion")


@query("P24_reconcile", """
w AS (SELECT *, coalesce(notice_id, nullif(regexp_extract(url, 'CO1\\.NTC\\.\\d+'), '')) ntc FROM {watch})
SELECT w.url, w.process_id pid, ntc notice, CASE WHEN w.process_id IS NULL THEN 'parse_error' WHEN w.process_id LIKE 'CO1.REQ.%' THEN 'draft_request'
  WHEN ntc IS NOT NULL AND p.nombre IS NOT NULL THEN 'ok_with_notice' WHEN ntc IS NOT NULL THEN 'ok_no_notice' WHEN c.id_contrato IS NOT NULL THEN 'found_in_contracts' ELSE 'not_found' END estado,
  p.nombre objeto_proceso, CASE WHEN ntc IS NULL THEN c.id_contrato END id_contrato
FROM w LEFT JOIN {procesos} p ON w.ntc = p.process_id LEFT JOIN {contratos} c ON w.process_id = c.id_contrato""")
def p24(t):
    return B.reconcile(t.watch, t.procesos, t.contratos)


@query("P27_age_days", f"SELECT seq, datediff('day', scraped_at, DATE '{AS_OF}') dias FROM {{portal_contratos}}")
def p27(t):
    return t.portal_contratos.select("seq", DT.age_days("scraped_at", AS_OF).alias("dias"))


@query("P28_process_block", """
SELECT process_id, fase modalidad, nombre nombre_procedimiento, CAST(precio_base AS VARCHAR) precio_base, concat_ws(' | ', 'adjudicado=' || adjudicado, 'custkey=' || custkey, 'portfolio=' || portfolio) otros_campos FROM {procesos}""")
def p28(t):
    names = {"fase": "modalidad", "nombre": "nombre_procedimiento", "precio_base": "precio_base"}
    return B.process_block(t.procesos, names, ["process_id", "fase", "nombre", "precio_base", "url", "entidad", "nit_entidad", "id_del_proceso"])


def _process_cell(source: str, how: str) -> str:
    number = f"regexp_replace(CAST(try_cast(replace({source}, ',', '') AS DECIMAL(34,6)) AS VARCHAR), '\\.?0+$', '')"
    return {"numero": f"coalesce({number}, {source})", "fecha": f"left({source}, 10)", "duracion": f"CASE WHEN {source} <> '' THEN trim(concat_ws(' ', {source}, unidad_de_duracion)) END"}.get(how, source)


@query("P28_process_mirror", "SELECT process_id, " + ", ".join(f"nullif({_process_cell(f, how)}, '') \"{label}\"" for label, f, how in S.PROCESS_BLOCK)
       + f", 'categoria=linea ' || substr(categoria, 7) \"{S.PROCESS_EXTRAS}\" FROM {{procesos_fuente}}")
def p28_mirror(t):
    return B.process_mirror(t.procesos_fuente)


@query("P28_W11_identity_block", """
a AS (SELECT process_id, direccion d, min((c.seq, u.seq)) o FROM {ubicaciones} u JOIN {contratos} c USING (id_contrato) WHERE lower(direccion) <> 'no definido' GROUP BY 1, 2),
l AS (SELECT process_id, string_agg(d, ' | ' ORDER BY o, d) direcciones FROM a GROUP BY 1)
SELECT process_id, fase, entidad, nit_entidad, nombre objeto, '$' || format('{{:,.0f}}', precio_base::DOUBLE) valor, direcciones, CASE WHEN direcciones IS NOT NULL THEN 0 END part
FROM {procesos} LEFT JOIN l USING (process_id)""")
def p28_identity(t):
    return B.identity_block(t.procesos, t.contratos, t.ubicaciones)


_MORE = "cerrada AND lang NOT IN ('es', 'fr')"


@query("P29_portal_block", f"""
SELECT 'CO1.NTC.' || page_id notice_id, CASE WHEN cerrada THEN nullif(titulo, '') END portal_titulo, CASE WHEN cerrada THEN 'NP-' || page_id END portal_numero_proceso, CASE WHEN cerrada THEN fase END portal_fase,
  CASE WHEN cerrada AND con_valor THEN '$ ' || page_id || '.000.000' END portal_valor_total,
  CASE WHEN NOT cerrada THEN '' WHEN con_valor THEN 'Adenda publicada 22/07/2024 03:15 PM' ELSE 'Cierre 23/07/2024 09:00 AM' END || CASE WHEN cerrada AND lang = 'de' THEN ' | Apertura' ELSE '' END notificaciones_texto,
  CASE WHEN NOT cerrada THEN 0 WHEN lang = 'de' THEN 2 ELSE 1 END notificaciones_n, CASE WHEN cerrada THEN 'Pliego_' || page_id || '.pdf' ELSE '' END || CASE WHEN {_MORE} THEN ' | Anexo.pdf' ELSE '' END documentos_texto,
  CASE WHEN {_MORE} THEN 2 WHEN cerrada THEN 1 ELSE 0 END documentos_n,
  CASE WHEN NOT cerrada THEN 'titulo, tipo_proceso, numero_proceso' WHEN titulo = '' THEN 'titulo, tipo_proceso' ELSE 'tipo_proceso' END faltantes FROM {{paginas}}""")
def p29(t):
    parsed = P.parse_pages(portal_pages(t), "page_id", "html")
    missing = F.array_compact(F.array(*[F.when(F.try_element_at("fields", F.lit(k)).isNull(), F.lit(k)) for k in S.CRITICAL_FIELDS]))
    d = parsed.withColumns({"notice_id": F.concat(F.lit("CO1.NTC."), "page_id"), "missing_fields": missing, "status": F.lit("ok_completo"), "scraped_at": F.lit(None).cast("string")})
    keep = ["notice_id", "portal_titulo", "portal_numero_proceso", "portal_fase", "portal_valor_total", "notificaciones_texto", "notificaciones_n", "documentos_texto", "documentos_n", "faltantes"]
    return B.portal_block(d).select(*keep)


# ---- Fill (P25, P26) --------------------------------------------------------

_C = "m.seq IS NOT NULL"
# Contract columns that the shared view lacks, the same in both engines.
_MORE_CONTRACT = {
    "duracion": "CASE WHEN dias_adicionados > 0 THEN dias_adicionados || ' dia(s)' END", "lugar": "'Zona ' || modalidad",
    "tipo_contrato": "CASE estado WHEN 'Cerrado' THEN 'Obra' ELSE 'Servicios' END", "orden": "CASE WHEN tipodoc = 'NIT' THEN 'Nacional' END",
    "origen_recursos": "CASE liquidacion WHEN 'Si' THEN 'Propios' ELSE 'Territoriales' END", "supervisor_id": "'S-' || id_contrato", "supervisor": "'Sup. ' || referencia",
    "valor_anticipo": "CASE WHEN anticipo = 'Si' THEN valor_pagado END", "direccion": "CASE estado WHEN 'Cerrado' THEN 'Sin Descripcion' ELSE 'Carrera ' || documento END"}
_FILL_SQL = [
    ("vigencia", "CAST(year(m.fecha_firma) AS VARCHAR)", "HIGH"), ("objeto", "coalesce(m.objeto, p.nombre)", "HIGH"),
    ("fecha_suscripcion", "CAST(m.fecha_firma AS VARCHAR)", "HIGH"), ("fecha_inicio", "CAST(m.fecha_inicio AS VARCHAR)", "HIGH"),
    ("fecha_terminacion", "CAST(m.fecha_fin AS VARCHAR)", "HIGH"), ("estado", "s.estados", "HIGH"), ("modalidad", "coalesce(m.modalidad, p.fase)", "HIGH"),
    ("entidad_nit", f"CASE WHEN {_C} THEN p.nit_entidad END", "MEDIUM"), ("entidad_dv", f"CASE WHEN {_C} THEN p.dv END", "HIGH"), ("entidad_nombre", f"CASE WHEN {_C} THEN p.entidad END", "MEDIUM"),
    ("valor_inicial", "CAST(s.inicial AS VARCHAR)", "HIGH"), ("valor_inicial_vigencia", "CAST(s.inicial AS VARCHAR)", "MEDIUM"),
    ("tipo_anticipos", "CASE m.anticipo WHEN 'Si' THEN 'Pago anticipado' WHEN 'No' THEN 'Sin anticipo' END", "MEDIUM"), ("tipo_adiciones", "k.tipos", "MEDIUM"),
    ("valor_anticipos", "CASE m.anticipo WHEN 'Si' THEN CAST(s.anticipos AS VARCHAR) END", "HIGH"), ("direccion", "nullif(m.direccion, 'Sin Descripcion')", "MEDIUM"),
    ("reducciones", "CASE WHEN s.red > 0 THEN CAST(s.red AS VARCHAR) END", "HIGH"), ("adiciones", "CASE WHEN s.adi > 0 THEN CAST(s.adi AS VARCHAR) END", "HIGH"),
    ("valor_total", "CAST(s.inicial + s.adi - s.red AS VARCHAR)", "HIGH"), ("prorrogas_dias", "CASE WHEN s.dias > 0 THEN CAST(s.dias AS VARCHAR) END", "HIGH"),
    ("naturaleza", "CASE m.tipodoc WHEN 'NIT' THEN 'Jurídica' WHEN 'CC' THEN 'Natural' END", "MEDIUM"),
    ("consorcio", f"CASE WHEN {_C} THEN CASE m.modalidad WHEN '1-URGENT' THEN 'Consorcio' WHEN '2-HIGH' THEN 'Unión Temporal' ELSE 'No' END END", "LOW"),
    ("tipo_id", "nullif(m.tipodoc, 'No Definido')", "HIGH"), ("num_id", "m.documento", "HIGH"), ("dv", "CASE WHEN m.tipodoc = 'NIT' THEN m.dv END", "HIGH"), ("contratista", "m.proveedor", "HIGH"),
    ("garantia_tipo", "g.tipos", "HIGH"), ("garantia_riesgos", "g.riesgos", "HIGH"), ("garantia_fecha", "CAST(g.f AS VARCHAR)", "HIGH"), ("avance_fisico", "CAST(e.r AS VARCHAR)", "HIGH"),
    ("avance_presup", f"CASE WHEN s.inicial > 0 AND s.inicial + s.adi - s.red > 0 THEN CAST({pct_sql('s.pagado', 's.inicial + s.adi - s.red')} AS VARCHAR) END", "HIGH"),
    ("requiere_liquidacion", "CASE m.liquidacion WHEN 'Si' THEN 'Sí' WHEN 'No' THEN 'No' END", "HIGH"), ("fecha_liquidacion", "CAST(m.fecha_liquidacion AS VARCHAR)", "HIGH"),
    ("proceso", "p.process_id", "HIGH"), ("link", "p.url", "HIGH"), ("plazo", "m.duracion", "HIGH"), ("lugar", "m.lugar", "HIGH"), ("clase", "m.tipo_contrato", "HIGH"),
    ("tipo_orden", "m.orden", "HIGH"), ("fuente_recursos", "m.origen_recursos", "HIGH"), ("supervisor_id", "m.supervisor_id", "HIGH"), ("supervisor", "m.supervisor", "HIGH"),
    ("ingreso", "CASE WHEN m.modalidad IN ('1-URGENT', '2-HIGH') THEN CAST(s.inicial + s.adi - s.red AS VARCHAR) END", "LOW"),
]


def _dv_of(x: str) -> str:
    return _DV.replace("reverse(x)", f"reverse({x})").replace("length(x)", f"length({x})")


FILL_STEPS = f"""
p AS (SELECT *, {_dv_of('nit_entidad')} dv FROM {{procesos}}),
m AS (SELECT *, {_dv_of('documento')} dv FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _MORE_CONTRACT.items())}, row_number() OVER (PARTITION BY process_id ORDER BY fecha_firma DESC NULLS LAST, seq) rn FROM {{contratos}}) WHERE rn = 1),
ad AS (SELECT id_contrato, sum(CASE WHEN valor > 0 THEN valor END) a, sum(CASE WHEN valor <= 0 THEN -valor END) r FROM {{adiciones}} GROUP BY 1),
s AS (SELECT process_id, sum(valor) inicial, sum(valor_pagado) pagado, coalesce(sum(a), 0)::DECIMAL(38,2) adi, coalesce(sum(r), 0)::DECIMAL(38,2) red, sum(dias_adicionados) dias, sum(CASE anticipo WHEN 'Si' THEN valor_pagado END) anticipos,
   string_agg(DISTINCT estado, ' | ' ORDER BY estado) estados FROM {{contratos}} LEFT JOIN ad USING (id_contrato) GROUP BY 1),
k AS (SELECT process_id, string_agg(DISTINCT tipo, ' | ' ORDER BY tipo) tipos FROM {{adiciones}} JOIN {{contratos}} USING (id_contrato) GROUP BY 1),
g AS (SELECT process_id, string_agg(DISTINCT nullif(tipo, 'No definido'), ' | ' ORDER BY nullif(tipo, 'No definido')) tipos, string_agg(DISTINCT riesgo, ' | ' ORDER BY riesgo) riesgos, min(fecha_exp) f
   FROM {{garantias}} JOIN {{contratos}} USING (id_contrato) GROUP BY 1),
e AS (SELECT process_id, max(avance_real) r FROM {{ejecucion}} JOIN {{contratos}} USING (id_contrato) GROUP BY 1),
j AS (SELECT p.process_id, {', '.join(f'{v} AS "{k}"' for k, v, _ in _FILL_SQL)}
   FROM p LEFT JOIN m USING (process_id) LEFT JOIN s USING (process_id) LEFT JOIN k USING (process_id) LEFT JOIN g USING (process_id) LEFT JOIN e USING (process_id)),
fills AS ({' UNION ALL '.join(f"""SELECT process_id, '{k}' clave, '{S.LEDGER_COLUMNS[k]}' columna, "{k}" valor, '{c}' confianza FROM j WHERE "{k}" IS NOT NULL AND "{k}" <> ''""" for k, _, c in _FILL_SQL)}
   UNION ALL SELECT process_id, 'numero', '{S.LEDGER_COLUMNS['numero']}', string_agg(referencia, ' | ' ORDER BY fecha_firma DESC, seq), 'HIGH' FROM {{contratos}} GROUP BY 1)"""


def fills_of(t):
    contracts = t.contratos.withColumns({k: F.expr(v) for k, v in _MORE_CONTRACT.items()})
    return FI.compute_fill(t.procesos, contracts, t.adiciones, t.garantias, t.ejecucion)


@query("P25_P26_ledger_fill", FILL_STEPS + " SELECT process_id, clave, columna, valor, confianza, clave <> 'avance_fisico' escribible, 0 part FROM fills")
def p25(t):
    return fills_of(t).select("process_id", "clave", "columna", "valor", "confianza", "escribible", "part")


@query("E1_column_groups", """
SELECT p.process_id, c.contratos, c.valor, a.adiciones, CAST(NULL AS VARCHAR) rotas, 'AnalysisException' roto_error FROM {procesos} p
LEFT JOIN (SELECT process_id, count(*) contratos, sum(valor) valor FROM {contratos} GROUP BY 1) c USING (process_id)
LEFT JOIN (SELECT process_id, count(*) adiciones FROM {adiciones} JOIN {contratos} USING (id_contrato) GROUP BY 1) a USING (process_id)""")
def e1(t):
    groups = B.ColumnGroups()
    groups.register("contratos", ["contratos", "valor"], lambda contratos, adiciones: contratos.groupBy("process_id").agg(F.count("*").alias("contratos"), RU.total("valor").alias("valor")))
    groups.register("roto", ["rotas"], lambda contratos, adiciones: contratos.select("process_id", F.col("no_existe").alias("rotas")))
    groups.register("adiciones", ["adiciones"], lambda contratos, adiciones: RU.with_process(adiciones.groupBy("id_contrato").agg(F.count("*").alias("n")), contratos)
                    .groupBy("process_id").agg(F.sum("n").alias("adiciones")))
    return groups.enrich(t.procesos.select("process_id"), contratos=t.contratos, adiciones=t.adiciones)
