"""Queries of the joins and source cascade (J*, A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapunto.functions.identifiers import contract_id, notice_id

from contrapunto.operators import resolve as R
from contrapunto.operators import rollups as RU
from contrapunto.operators.matching import match_notes
from contrapunto.plans.registry import query

_NTC = "nullif(regexp_extract({}, 'CO1\\.NTC\\.\\d+'), '')"


@query("J1_process_contracts", """
SELECT p.process_id, c.id_contrato, CASE WHEN c.portfolio = p.portfolio THEN 'portafolio' ELSE 'aviso' END via FROM {procesos} p JOIN {contratos} c
ON c.custkey = p.custkey AND (c.portfolio = p.portfolio OR """ + _NTC.format("c.url") + " = p.process_id)")
def j1(t):
    return R.process_contracts(t.procesos, t.contratos)


@query("J2_lookup_process", """
l AS (SELECT row_no, CASE WHEN estado = 'Cerrado' THEN 'CO1.REQ.' || custkey WHEN estado = 'modificado' THEN 'CO1.PPI.' || custkey ELSE 'CO1.NTC.' || custkey END pid,
   CASE WHEN estado = 'modificado' AND url LIKE 'https%' THEN 'CO1.NTC.' || custkey END notice, custkey FROM {ledger})
SELECT row_no, pid, CASE WHEN pid LIKE 'CO1.PPI.%' AND notice IS NULL THEN NULL ELSE 'CO1.REQ.' || custkey END encontrado,
  CASE WHEN pid LIKE 'CO1.REQ.%' THEN 1 WHEN notice IS NOT NULL THEN 2 WHEN pid LIKE 'CO1.NTC.%' THEN 3 END nivel FROM l""")
def j2(t):
    e = F.col("estado")
    pid = F.concat(F.when(e == "Cerrado", "CO1.REQ.").when(e == "modificado", "CO1.PPI.").otherwise("CO1.NTC."), "custkey")
    notice = F.when((e == "modificado") & F.col("url").startswith("https"), F.concat(F.lit("CO1.NTC."), "custkey"))
    return R.lookup_process(t.ledger.select("row_no", pid.alias("pid"), notice.alias("notice")), t.procesos).select("row_no", "pid", "encontrado", "nivel")


@query("J3_contract_children", """
SELECT c.id_contrato, c.process_id, """ + ", ".join(f"coalesce({a}.n, 0) n_{a}" for a in ("adiciones", "garantias", "facturas", "ejecucion", "suspensiones", "ubicaciones", "modificaciones")) + """ FROM {contratos} c """
       + " ".join(f"LEFT JOIN (SELECT id_contrato, count(*) n FROM {{{v}}} GROUP BY 1) {a} USING (id_contrato)" for a, v in
                  (("adiciones", "adiciones"), ("garantias", "garantias"), ("facturas", "facturas"), ("ejecucion", "ejecucion"), ("suspensiones", "suspensiones"), ("ubicaciones", "ubicaciones"), ("modificaciones", "mod_contratos"))))
def j3(t):
    return R.contract_children(t.contratos, {
        "adiciones": t.adiciones, "garantias": t.garantias, "facturas": t.facturas, "ejecucion": t.ejecucion,
        "suspensiones": t.suspensiones, "ubicaciones": t.ubicaciones, "modificaciones": t.mod_contratos})


@query("J3_child_rows", """
r AS (SELECT id_contrato, 'adicion' hijo, CAST(json_object('fecha', CAST(fecha AS VARCHAR), 'tipo', tipo, 'valor', CAST(valor AS VARCHAR)) AS VARCHAR) datos, NULL error FROM {adiciones}
UNION ALL SELECT id_contrato, 'garantia', CASE WHEN estado = 'Vencida' AND tipo = 'Calidad' THEN NULL ELSE CAST(json_object('numero', numero, 'tipo', tipo, 'valor', CAST(valor AS VARCHAR)) AS VARCHAR) END,
  CASE WHEN estado = 'Vencida' AND tipo = 'Calidad' THEN 'ilegible' END FROM {garantias}
UNION ALL SELECT id_contrato, 'factura', CAST(json_object('fecha', CASE WHEN pagada THEN CAST(fecha AS VARCHAR) ELSE 'pronto' END, 'valor_total', CASE WHEN estado = 'Radicada' THEN 'n/d' ELSE CAST(valor_total AS VARCHAR) END) AS VARCHAR),
  CASE WHEN estado = 'Radicada' THEN 'campos: ' || CASE WHEN pagada THEN '' ELSE 'fecha, ' END || 'valor_total' END FROM {facturas})
SELECT r.id_contrato, c.process_id, hijo, datos, error FROM r LEFT JOIN {contratos} c USING (id_contrato) UNION ALL SELECT NULL, NULL, 'ejecucion', NULL, 'sin fuente: PATH_NOT_FOUND'""")
def j3_rows(t):
    """Three children as landed, one of them with torn texts and one with bad cells, and a fourth that is not there."""
    text = lambda c: F.col(c).cast("string").alias(c)
    torn = F.when((F.col("estado") == "Vencida") & (F.col("tipo") == "Calidad"), F.lit('{"numero": ')).otherwise(F.to_json(F.struct("numero", "tipo", text("valor"))))
    bad = t.facturas.select("id_contrato", F.when(F.col("pagada"), F.col("fecha").cast("string")).otherwise("pronto").alias("fecha"),
                            F.when(F.col("estado") == "Radicada", "n/d").otherwise(F.col("valor_total").cast("string")).alias("valor_total"))
    return R.child_rows(t.contratos, {
        "adicion": lambda: t.adiciones.select("id_contrato", "tipo", text("valor"), text("fecha")),
        "garantia": lambda: t.garantias.select("id_contrato", torn.alias("raw")),
        "factura": lambda: bad, "ejecucion": lambda: t.spark.read.parquet(f"{t.folder}/ejecucion_que_no_existe.parquet")},
        {"adicion": {"valor": "decimal(18,2)"}, "garantia": {"valor": "decimal(18,2)"}, "factura": {"fecha": "date", "valor_total": "decimal(18,2)"}}, as_text=True)


# The watch item, its keys, and one row per lookup key of every source.
CASCADE_STEPS = f"""
w AS (SELECT seq item, process_id, notice_id, url, vigencia, sheet FROM {{watch}}),
api AS (SELECT clave, id_contrato ref, valor, fecha_firma FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY seq DESC) rn FROM
   (SELECT id_contrato clave, * FROM {{contratos}} UNION ALL SELECT process_id clave, * FROM {{contratos}})) WHERE rn = 1),
integ AS (SELECT clave, url_contrato ref, valor, fecha_firma FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY seq DESC) rn FROM
   (SELECT {_NTC.format('url_contrato')} clave, * FROM {{integrado}} UNION ALL SELECT nullif(regexp_extract(url_contrato, 'CO1\\.PCCNTR\\.\\d+'), ''), * FROM {{integrado}}) WHERE clave IS NOT NULL) WHERE rn = 1),
por AS (SELECT notice_id clave, titulo ref, NULL::DECIMAL(18,2) valor, scraped_at fecha_firma FROM {{portal}}),
st AS (SELECT @0 pr, 'api' src, * FROM api UNION ALL SELECT @1, 'portal', * FROM por UNION ALL SELECT @2, 'integrado', * FROM integ),
ks AS (SELECT item, 0 r, process_id clave FROM w WHERE process_id IS NOT NULL UNION ALL SELECT item, 1, notice_id FROM w WHERE notice_id IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pr, r) rn FROM ks JOIN st USING (clave)) WHERE rn = 1),
cas AS (SELECT w.item, process_id, notice_id, url, vigencia, sheet, coalesce(src, 'none') data_source, ref, valor, fecha_firma FROM w LEFT JOIN best USING (item))"""


def cascade_sql(order: tuple[int, int, int]) -> str:
    out = CASCADE_STEPS
    for i, rank in enumerate(order):
        out = out.replace(f"@{i}", str(rank))
    return out


def watch_items(t):
    return t.watch.withColumnRenamed("seq", "item")


def sources(t):
    return R.source_keys(t.contratos, t.integrado, t.portal)


def cascaded(t, priority=("api", "portal", "integrado")):
    return R.cascade(watch_items(t), sources(t), list(priority))


@query("J4_J6_cascade", cascade_sql((0, 1, 2)) + " SELECT item, data_source, ref, valor, fecha_firma FROM cas")
def j4(t):
    return cascaded(t).select("item", "data_source", "ref", "valor", "fecha_firma")


@query("J4_cascade_integrated_first", cascade_sql((1, 2, 0)) + " SELECT item, data_source, ref FROM cas")
def j4_other(t):
    return cascaded(t, ("integrado", "api", "portal")).select("item", "data_source", "ref")


@query("A16_coverage", cascade_sql((0, 1, 2)) + """, n AS (SELECT count(*) total, count(*) FILTER (data_source = 'api') api, count(*) FILTER (data_source = 'integrado') integrado,
  count(*) FILTER (data_source = 'portal') portal, count(*) FILTER (data_source = 'none') sin_fuente FROM cas)
SELECT *, api + portal confiable, api + portal + integrado detectado, CAST(floor((api + portal) * 100.0 / total + 0.5) AS BIGINT) pct_confiable,
  CAST(floor((api + portal + integrado) * 100.0 / total + 0.5) AS BIGINT) pct_detectado FROM n""")
def a16(t):
    return RU.coverage(cascaded(t))


@query("J5_multi_key_lookup", cascade_sql((0, 1, 2)) + """, k3 AS (SELECT item, 0 r, notice_id clave FROM w UNION ALL SELECT item, 1, CASE WHEN process_id LIKE 'CO1.PCCNTR.%' THEN process_id END FROM w UNION ALL SELECT item, 2, process_id FROM w)
SELECT item, r "rank", clave, ref, valor FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY r) rn FROM k3 JOIN integ USING (clave)) WHERE rn = 1""")
def j5(t):
    keys = [F.col("notice_id"), contract_id("process_id"), F.col("process_id")]
    return R.multi_key_lookup(watch_items(t), sources(t)["integrado"], keys).select("item", "rank", "clave", F.col("m.ref").alias("ref"), F.col("m.valor").alias("valor"))


@query("J7_process_detail", """
SELECT process_id, seccion, clave, CAST(contenido AS VARCHAR) contenido FROM (SELECT process_id, 'proceso' seccion, process_id clave, json_object('entidad', entidad, 'fase', fase, 'nombre', nombre) contenido FROM {procesos}
UNION ALL SELECT process_id, 'contrato', id_contrato, json_object('estado', estado, 'proveedor', proveedor, 'valor', CAST(valor AS VARCHAR)) FROM {contratos}
UNION ALL SELECT process_id, 'adicion', a.id_contrato, json_object('dias', CAST(a.dias AS VARCHAR), 'fecha', CAST(a.fecha AS VARCHAR), 'tipo', a.tipo, 'valor', CAST(a.valor AS VARCHAR)) FROM {adiciones} a JOIN {contratos} c USING (id_contrato)
UNION ALL SELECT process_id, 'garantia', g.id_contrato, json_object('estado', g.estado, 'tipo', g.tipo, 'valor', CAST(g.valor AS VARCHAR)) FROM {garantias} g JOIN {contratos} c USING (id_contrato)
UNION ALL SELECT process_id, 'factura', f.id_contrato, json_object('estado', f.estado, 'numero', f.numero, 'valor_total', CAST(f.valor_total AS VARCHAR)) FROM {facturas} f JOIN {contratos} c USING (id_contrato)
UNION ALL SELECT process_id, 'nota', sheet || ':' || row_no, json_object('text', text) FROM {notas} SEMI JOIN {procesos} USING (process_id)) z""")
def j7(t):
    from contrapunto.operators.detail import process_detail
    notes = t.notas.withColumn("clave", F.concat_ws(":", "sheet", F.col("row_no").cast("string")))
    return process_detail(
        t.procesos, t.contratos, {"adicion": (t.adiciones, ["tipo", "valor", "dias", "fecha"]), "garantia": (t.garantias, ["tipo", "estado", "valor"]),
                                  "factura": (t.facturas, ["numero", "estado", "valor_total"])},
        ["fase", "entidad", "nombre"], ["estado", "proveedor", "valor"], notes)


@query("J8_notes_for", """
k AS (SELECT seq item, process_id clave FROM {watch} WHERE process_id IS NOT NULL UNION SELECT seq, notice_id FROM {watch} WHERE notice_id IS NOT NULL)
SELECT item, sheet, row_no, min(text) text FROM k JOIN {notas} n ON n.process_id = k.clave GROUP BY 1, 2, 3""")
def j8(t):
    notes = t.notas.select(F.col("process_id").alias("clave"), "sheet", "row_no", "text")
    keys = [F.col("process_id"), F.col("notice_id"), F.col("notice_id"), F.col("url"), F.lower("url")]
    return R.notes_for(watch_items(t), keys, notes)


_LEDGER_KEYS = """
lk AS (SELECT *, u.k clave FROM (SELECT *, [url, lower(url), nullif(regexp_extract(url, 'CO1\\.[A-Z]+\\.[0-9A-Za-z]+'), '')] ks FROM {ledger} WHERE contains(lower(url), 'portal.example.org')) x, unnest(x.ks) u(k) WHERE u.k IS NOT NULL),
ll AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY sheet_ord DESC, row_no DESC) rn FROM lk) WHERE rn = 1),
wk AS (SELECT seq item, 0 r, process_id clave FROM {watch} UNION ALL SELECT seq, 1, notice_id FROM {watch} UNION ALL SELECT seq, 2, url FROM {watch} UNION ALL SELECT seq, 3, lower(url) FROM {watch}),
h AS (SELECT item, r, clave, sheet, row_no, vigencia, numero FROM (SELECT wk.item, wk.r, ll.*, row_number() OVER (PARTITION BY wk.item ORDER BY wk.r) rr FROM wk JOIN ll ON wk.clave = ll.clave) WHERE rr = 1)"""


def _watch_keys():
    return [F.col("process_id"), F.col("notice_id"), F.col("url"), F.lower("url")]


def _ledger_index(t):
    return R.ledger_keys(t.ledger, "portal.example.org").select("clave", "sheet", "sheet_ord", "row_no", "vigencia", "numero")


@query("J9_ledger_for", _LEDGER_KEYS + " SELECT item, clave, sheet, row_no, numero FROM h")
def j9(t):
    return R.ledger_for(watch_items(t), _watch_keys(), _ledger_index(t)).select("item", "clave", "m.sheet", "m.row_no", "m.numero")


@query("J10_enrich_year", _LEDGER_KEYS + """
SELECT w.seq item, CASE WHEN h.item IS NOT NULL THEN h.vigencia ELSE nullif(regexp_extract(note, 'hoja\\s+(\\d{{4}})', 1), '') END vigencia_resuelta,
  coalesce(h.sheet, 'Hoja ' || nullif(regexp_extract(note, 'hoja\\s+(\\d{{4}})', 1), '')) hoja_resuelta, CASE WHEN h.item IS NOT NULL THEN 'ledger' WHEN regexp_matches(note, 'hoja\\s+\\d{{4}}') THEN 'nota' ELSE 'sin_dato' END via
FROM {watch} w LEFT JOIN h ON h.item = w.seq""")
def j10(t):
    return R.enrich_year(watch_items(t), _watch_keys(), _ledger_index(t))


@query("J11_multi_source", """
SELECT clave, count(*) fuentes FROM (SELECT DISTINCT id_contrato clave, 1 s FROM {contratos} UNION ALL SELECT DISTINCT numero_del_contrato, 2 FROM {integrado} UNION ALL SELECT DISTINCT id_contrato, 3 FROM {portal_contratos}) GROUP BY 1 HAVING count(*) >= 2""")
def j11(t):
    frames = [t.contratos.select(F.col("id_contrato").alias("clave")), t.integrado.select(F.col("numero_del_contrato").alias("clave")), t.portal_contratos.select(F.col("id_contrato").alias("clave"))]
    return R.multi_source(frames[0].distinct(), frames)


@query("J12_still_missing", f"""
s AS (SELECT id_contrato clave FROM {{contratos}} UNION SELECT {_NTC.format('url_contrato')} FROM {{integrado}})
SELECT process_id clave, CASE WHEN process_id IN (SELECT clave FROM s WHERE clave IS NOT NULL) THEN 'cubierto' ELSE 'sigue_sin_fuente' END estado FROM {{watch}} WHERE process_id IS NOT NULL""")
def j12(t):
    listed = t.watch.where("process_id is not null").select(F.col("process_id").alias("clave"))
    return R.still_missing(listed, [t.contratos.select(F.col("id_contrato").alias("clave")), t.integrado.select(notice_id("url_contrato").alias("clave"))])


@query("J13_orphans", f"""
k AS (SELECT process_id clave FROM {{watch}} WHERE process_id IS NOT NULL UNION SELECT notice_id FROM {{watch}} WHERE notice_id IS NOT NULL),
i AS (SELECT seq, {_NTC.format('url_contrato')} n, nullif(regexp_extract(url_contrato, 'CO1\\.PCCNTR\\.\\d+'), '') c FROM {{integrado}})
SELECT seq, CASE WHEN n IS NULL AND c IS NULL THEN 'sin_clave' ELSE 'sin_seguimiento' END motivo FROM i
WHERE NOT coalesce(n IN (SELECT clave FROM k), false) AND NOT coalesce(c IN (SELECT clave FROM k), false)""")
def j13(t):
    keys = t.watch.select(F.explode(F.array("process_id", "notice_id")).alias("clave"))
    return R.orphans(t.integrado, [notice_id("url_contrato"), contract_id("url_contrato")], keys).select("seq", "motivo")


@query("J14_siblings", "SELECT process_id, id_contrato, count(*) OVER (PARTITION BY process_id) - 1 hermanos FROM {contratos}")
def j14(t):
    return R.siblings(t.contratos)


@query("J14_siblings_of_pick", """
m AS (SELECT process_id, min(id_contrato) elegido FROM {contratos} WHERE estado = 'Modificado' GROUP BY 1)
SELECT elegido, process_id, id_contrato hermano FROM {contratos} JOIN m USING (process_id) WHERE id_contrato <> elegido""")
def j14_pick(t):
    return R.siblings_of(t.contratos.where("estado = 'Modificado'"), t.contratos)


_PICKS = "m AS (SELECT process_id, id_contrato, row_number() OVER (PARTITION BY process_id ORDER BY id_contrato) - 1 i, count(*) OVER (PARTITION BY process_id) - 1 n, estado FROM {contratos})"


@query("J14_every_pick", _PICKS + " SELECT id_contrato elegido, process_id, n hermanos, i // 4 part, i % 4 lugar FROM m WHERE estado = 'Modificado'")
def j14_picks(t):
    return R.siblings_of_all(t.contratos.where("estado = 'Modificado'"), t.contratos, 4)[0]


@query("J14_members", _PICKS + " SELECT process_id, i // 4 part, string_agg(id_contrato, ' | ' ORDER BY id_contrato) miembros FROM m GROUP BY 1, 2")
def j14_members(t):
    return R.siblings_of_all(t.contratos.where("estado = 'Modificado'"), t.contratos, 4)[1]


@query("J16_attach_doc_meta", """
SELECT process_id, doc_id, nombre, CASE WHEN dataset = 'archivo_2025' THEN NULL ELSE url END url FROM (SELECT process_id, doc_id, CASE WHEN dataset <> 'archivo_2025' THEN nombre END nombre, url, dataset FROM {archivos})""")
def j16(t):
    meta = t.archivos.where("dataset <> 'archivo_2025'")
    return R.attach_doc_meta(t.archivos.select("process_id", "doc_id"), meta)


_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda x: x <> '')"
_WINDOWS = "list_distinct(list_filter(list_transform(range(1, greatest(len(ws), 2)), lambda i: ws[i] || coalesce(' ' || ws[i + 1], '')), lambda x: x IS NOT NULL))"


@query("J17_note_match", f"""
n AS (SELECT note_id, process_id, {_WINDOWS} w FROM (SELECT *, {_WORDS.format('text')} ws FROM {{observaciones}})),
b AS (SELECT doc_id, process_id, campo, {_WINDOWS} w FROM (SELECT doc_id, process_id, 'nombre' campo, {_WORDS.format('nombre')} ws FROM {{archivos}}
   UNION ALL SELECT doc_id, process_id, 'texto', {_WORDS.format('texto')} FROM {{archivos}})),
s AS (SELECT note_id, doc_id, campo, len(list_intersect(n.w, b.w)) comunes, least(len(n.w), len(b.w)) menor FROM n JOIN b USING (process_id) WHERE len(n.w) > 0 AND len(b.w) > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY comunes / menor DESC, doc_id, campo) rn FROM s WHERE comunes >= 0.5 * menor)
SELECT o.note_id, o.process_id, t.doc_id, t.campo, t.comunes, t.menor, round(comunes / menor * 100, 1) coincidencia FROM {{observaciones}} o LEFT JOIN t ON t.note_id = o.note_id AND t.rn = 1""")
def j17(t):
    return match_notes(t.observaciones, t.archivos)


@query("E2_jaro_winkler", """
SELECT s_suppkey, round(jaro_winkler_similarity(lower(s_name), lower(n_name || ' ' || s_name)), 6) jw, round(jaro_winkler_similarity(s_name, 'Supplier ' || s_nationkey), 6) jw2 FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def e2(t):
    from contrapunto.functions.similarity import jaro_winkler
    d = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return d.select("s_suppkey", F.round(jaro_winkler(F.lower("s_name"), F.lower(F.concat_ws(" ", "n_name", "s_name"))), 6).alias("jw"),
                    F.round(jaro_winkler(F.col("s_name"), F.concat(F.lit("Supplier "), "s_nationkey")), 6).alias("jw2"))
