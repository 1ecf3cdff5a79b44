"""Queries of the aggregate and ordering operators (A*, W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapunto import schemas as S
from contrapunto.functions.identifiers import notice_id
from contrapunto.operators import blocks as B
from contrapunto.operators import documents as D
from contrapunto.operators import filters as FL
from contrapunto.operators import ordering as O
from contrapunto.operators import rollups as R
from contrapunto.plans.analogs import AS_OF
from contrapunto.plans.registry import pct_sql, query

_A1 = """
t AS (SELECT process_id, coalesce(sum(na), 0) n_add, coalesce(sum(nr), 0) n_rich, coalesce(sum(vr), 0) valor,
        coalesce(nullif(sum(dr), 0), sum(dias_adicionados), 0) dias, max(greatest(fa, fr)) fecha_ultima
      FROM (SELECT process_id, id_contrato, dias_adicionados FROM {contratos}) c
      LEFT JOIN (SELECT id_contrato, count(*) na, max(fecha) fa FROM {adiciones} GROUP BY 1) a USING (id_contrato)
      LEFT JOIN (SELECT id_contrato, count(*) nr, sum(valor) vr, sum(dias) dr, max(fecha_aprob) fr FROM {mod_contratos} GROUP BY 1) r USING (id_contrato)
      GROUP BY process_id),
k AS (SELECT process_id, string_agg(DISTINCT tipo, '; ' ORDER BY tipo) tipos FROM {adiciones} JOIN {contratos} USING (id_contrato) GROUP BY 1),
ra AS (SELECT process_id, row_number() OVER (PARTITION BY process_id ORDER BY c.seq, a.seq) rn,
         concat_ws(' — ', tipo, descripcion) t FROM {adiciones} a JOIN {contratos} c USING (id_contrato)),
rr AS (SELECT process_id, row_number() OVER (PARTITION BY process_id ORDER BY c.seq, m.seq) rn,
         concat_ws(' / ', CASE WHEN m.valor <> 0 THEN '$' || format('{:,.0f}', m.valor::DOUBLE) END,
                   CASE WHEN m.dias <> 0 THEN '+' || m.dias || 'd' END, proposito) t
       FROM {mod_contratos} m JOIN {contratos} c USING (id_contrato)),
la AS (SELECT process_id, string_agg(t, ' | ' ORDER BY rn) d FROM ra WHERE rn <= 10 GROUP BY 1),
lr AS (SELECT process_id, string_agg(t, ' | ' ORDER BY rn) d FROM rr WHERE rn <= 10 GROUP BY 1),
b AS (SELECT p.process_id, coalesce(n_add, 0) n_add, coalesce(n_rich, 0) n_rich, coalesce(valor, 0) valor, coalesce(dias, 0) dias,
        fecha_ultima, coalesce(tipos, '') tipos, coalesce(lr.d, la.d) lista
      FROM {procesos} p LEFT JOIN t USING (process_id) LEFT JOIN k USING (process_id) LEFT JOIN la USING (process_id) LEFT JOIN lr USING (process_id)),
s AS (SELECT process_id, CASE WHEN greatest(n_add, n_rich) > 0 OR dias > 0 OR valor > 0 THEN 'Sí' ELSE 'No' END hubo,
        CAST(greatest(n_add, n_rich) AS BIGINT) cantidad, tipos, fecha_ultima, CAST(valor AS DECIMAL(38,2)) valor, CAST(dias AS BIGINT) dias,
        CASE WHEN n_add = 0 AND n_rich = 0 AND dias <> 0 THEN '+' || dias || 'd'
             ELSE concat_ws('+', CASE WHEN n_add > 0 THEN 'cb9c(' || n_add || ')' END, CASE WHEN n_rich > 0 THEN 'u8cx(' || n_rich || ')' END) END fuente,
        concat_ws(' | ', CASE WHEN n_add = 0 AND n_rich = 0 AND dias <> 0 THEN dias || ' día(s) adicionados al contrato' END, lista,
             CASE WHEN greatest(n_add, n_rich) > 10 THEN '… y ' || (greatest(n_add, n_rich) - 10) || ' más' END) detalle
      FROM b)
SELECT *, CASE WHEN hubo = 'No' THEN 'Sin modificatorios registrados en la fuente.' ELSE
    concat_ws('. ', cantidad || ' ' || CASE WHEN cantidad = 1 THEN 'modificatorio' ELSE 'modificatorios' END || ' en la fuente (' ||
       coalesce(nullif(replace(tipos, '; ', ', '), ''), 'MODIFICACION') || ')',
       CASE WHEN valor <> 0 THEN 'valor acumulado $' || format('{:,.0f}', valor::DOUBLE) END,
       CASE WHEN dias <> 0 THEN '+' || dias || ' día(s)' END, 'último ' || CAST(fecha_ultima AS VARCHAR)) END nota
FROM s"""


@query("A1_amendment_summary", _A1)
def a1(t):
    return R.amendment_summary(t.procesos, t.contratos, t.adiciones, t.mod_contratos)


@query("A2_contract_rollup", """
SELECT process_id, count(*) contratos, sum(valor) valor, sum(valor_pagado) valor_pagado, sum(valor - valor_pagado) valor_pendiente,
  CAST(sum(dias_adicionados) AS BIGINT) dias_adicionados, min(fecha_firma) primera_firma, max(fecha_fin) ultimo_fin,
  string_agg(DISTINCT estado, ' | ' ORDER BY estado) estados,
  string_agg(DISTINCT CASE WHEN tipodoc <> 'No Definido' THEN tipodoc END, ' | ' ORDER BY CASE WHEN tipodoc <> 'No Definido' THEN tipodoc END) tipos_doc
FROM {contratos} GROUP BY process_id""")
def a2(t):
    return R.contract_rollup(t.contratos)


@query("A2_W11_contract_lists", """
u AS (SELECT process_id, seq, 'ids' campo, id_contrato v FROM {contratos} UNION ALL SELECT process_id, seq, 'referencias', referencia FROM {contratos}
  UNION ALL SELECT process_id, seq, 'proveedores', proveedor FROM {contratos}
  UNION ALL SELECT process_id, seq, 'documentos', CASE WHEN tipodoc = 'No Definido' THEN documento ELSE tipodoc || ':' || documento END FROM {contratos}
  UNION ALL SELECT process_id, seq, 'fechas_firma', CAST(fecha_firma AS VARCHAR) FROM {contratos}),
d AS (SELECT process_id, campo, v, min(seq) o FROM u GROUP BY ALL)
SELECT process_id, campo, string_agg(v, ' | ' ORDER BY o, v) texto, 0 part FROM d GROUP BY process_id, campo""")
def a2_lists(t):
    return R.contract_lists(t.contratos)


def _contract_cell(source: str, how: str) -> str:
    known = "CASE WHEN {0} NOT IN ('', 'No definido', 'No Definido') THEN trim({0}) END"
    return {"documento": "CASE WHEN documento_proveedor <> '' THEN concat_ws(':', nullif(tipodocproveedor, ''), documento_proveedor) END", "valores": known.format(source),
            "fechas": known.format(f"left({source}, 10)")}.get(how, source)


_BLOCK_LISTS = [(label, _contract_cell(f, how), how) for label, f, how in S.CONTRACT_BLOCK if how != "suma"]
_BLOCK_LISTS.append((S.CONTRACT_EXTRAS, "concat_ws(' | ', 'orden=' || replace(orden, '|', ' '), CASE WHEN saldo_cdp <> '0' THEN 'saldo_cdp=' || saldo_cdp END)", "lista"))


@query("A2_contract_block", "u AS (" + " UNION ALL ".join(
    f"SELECT process_id, '{label}' campo, {v} v, {'0' if how in ('conjunto', 'documento') else 'seq'} o, {'seq' if how == 'lista' else '0'} vez FROM {{contratos_fuente}}" for label, v, how in _BLOCK_LISTS) + """),
l AS (SELECT process_id, campo, string_agg(v, ' | ' ORDER BY o, v) t FROM (SELECT process_id, campo, v, vez, min(o) o FROM u WHERE v <> '' GROUP BY ALL) GROUP BY 1, 2),
w AS (SELECT process_id, """ + ", ".join(f"max(CASE WHEN campo = '{label}' THEN t END) \"{label}\"" for label, _, _ in _BLOCK_LISTS) + """ FROM l GROUP BY 1),
m AS (SELECT process_id, """ + ", ".join(f"sum(try_cast(replace({f}, ',', '') AS DECIMAL(28,4))) \"{label}\"" for label, f, how in S.CONTRACT_BLOCK if how == "suma") + """ FROM {contratos_fuente} GROUP BY 1)
SELECT *, 0 part FROM w JOIN m USING (process_id)""")
def a2_block(t):
    return B.contract_block(t.contratos_fuente)


@query("A3_A9_policies", """
g AS (SELECT process_id, g.*, tipo || ' ' || aseguradora || ' #' || numero || ' (' || g.estado || ', vence ' || CAST(g.fecha_fin AS VARCHAR) || ')' t
      FROM {garantias} g JOIN (SELECT id_contrato, process_id FROM {contratos}) USING (id_contrato)),
r AS (SELECT process_id, t, row_number() OVER (PARTITION BY process_id ORDER BY fecha_fin, numero, t) rn FROM g),
l AS (SELECT process_id, string_agg(t, ' | ' ORDER BY rn) detalle FROM r WHERE rn <= 10 GROUP BY 1)
SELECT process_id, count(*) polizas, count(*) FILTER (lower(estado) = 'vigente') vigentes, max(fecha_fin) fin_max, min(fecha_exp) primera_expedicion,
  sum(valor) valor_total, string_agg(DISTINCT aseguradora, ' | ' ORDER BY aseguradora) aseguradoras,
  string_agg(DISTINCT nullif(tipo, 'No definido'), ' | ' ORDER BY nullif(tipo, 'No definido')) tipos,
  string_agg(DISTINCT riesgo, ' | ' ORDER BY riesgo) riesgos, any_value(detalle) detalle
FROM g JOIN l USING (process_id) GROUP BY process_id""")
def a3(t):
    return R.policies(t.contratos, t.garantias)


@query("A4_W2_payments", """
f AS (SELECT process_id, f.*, concat_ws(' ', CAST(fecha AS VARCHAR), '#' || numero, f.estado, '$' || CAST(valor_a_pagar AS VARCHAR)) t
      FROM {facturas} f JOIN (SELECT id_contrato, process_id FROM {contratos}) USING (id_contrato)),
r AS (SELECT process_id, t, row_number() OVER (PARTITION BY process_id ORDER BY fecha DESC, numero, t) rn FROM f),
l AS (SELECT process_id, max(CASE WHEN rn = 1 THEN t END) ultima, string_agg(t, ' | ' ORDER BY rn) detalle FROM r WHERE rn <= 8 GROUP BY 1)
SELECT process_id, count(*) facturas, count(*) FILTER (pagada) pagadas, sum(valor_total) facturado, sum(valor_a_pagar) a_pagar, sum(valor_neto) neto,
  any_value(ultima) ultima, any_value(detalle) detalle FROM f JOIN l USING (process_id) GROUP BY process_id""")
def a4(t):
    return R.payments(t.contratos, t.facturas)


@query("A5_W2_progress", """
e AS (SELECT process_id, max(avance_real) r, max(avance_esperado) x, max(entrega_real) er, max(entrega_esperada) ee
      FROM {ejecucion} JOIN {contratos} USING (id_contrato) GROUP BY 1),
s0 AS (SELECT process_id, s.*, row_number() OVER (PARTITION BY process_id ORDER BY fecha_creacion DESC, tipo DESC, proposito DESC) rn, count(*) OVER (PARTITION BY process_id) n
      FROM {suspensiones} s JOIN (SELECT id_contrato, process_id FROM {contratos}) USING (id_contrato)),
s AS (SELECT * FROM s0 WHERE rn = 1)
SELECT coalesce(e.process_id, s.process_id) process_id, r avance_real, x avance_esperado, x - r brecha, er entrega_real, ee entrega_esperada,
  coalesce(n, 0) suspensiones, tipo tipo_suspension, proposito, concat_ws(' - ', CAST(fecha_creacion AS VARCHAR), tipo) ultima_suspension
FROM e FULL JOIN s USING (process_id)""")
def a5(t):
    return R.progress(t.contratos, t.ejecucion, t.suspensiones)


@query("A6_process_edits", """
r AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY ultima DESC, seq DESC) rn FROM {mod_procesos}),
l AS (SELECT process_id, string_agg(strftime(ultima, '%Y-%m-%dT%H:%M:%S') || ' ' || descripcion, ' | ' ORDER BY rn) detalle FROM r WHERE rn <= 5 GROUP BY 1)
SELECT process_id, count(*) ediciones, max(ultima) ultima, any_value(detalle) detalle FROM r JOIN l USING (process_id) GROUP BY 1""")
def a6(t):
    return R.process_edits(t.mod_procesos)


_CAT = """CASE WHEN upper(strip_accents(nombre)) SIMILAR TO '.*(LEGALIZAC|LEGALIZADO).*' THEN 'legalizaciones'
 WHEN upper(strip_accents(nombre)) SIMILAR TO '.*(MODIFICATORIO|MODIFICACION|OTROSI|OTRO SI|PRORROGA|ADICION|ADICLON|CESION|SUSPENSION).*' THEN 'modificatorios'
 WHEN contains(upper(strip_accents(nombre)), 'ACTA') THEN 'actas' WHEN contains(upper(strip_accents(nombre)), 'INFORME') THEN 'informes'
 WHEN upper(strip_accents(nombre)) SIMILAR TO '.*(PLIEGO|ANEXO|ESTUDIO PREVIO|MATRIZ DE RIESGO|MANIFESTAC|ESTUDIO DEL SECTOR|INVITACION).*' THEN 'pliegos' ELSE 'otros' END"""


@query("T1_file_categories", f"SELECT doc_id, nombre, {_CAT} categoria FROM {{archivos}}")
def t1(t):
    return t.archivos.select("doc_id", "nombre", D.file_category("nombre").alias("categoria"))


@query("A7_document_counts", f"""
d AS (SELECT *, {_CAT} cat, row_number() OVER (PARTITION BY process_id, {_CAT} ORDER BY fecha DESC, nombre DESC) rn FROM {{archivos}})
SELECT process_id, count(*) total, count(*) FILTER (cat = 'modificatorios') modificatorios, count(*) FILTER (cat = 'legalizaciones') legalizaciones,
  count(*) FILTER (cat = 'actas') actas, count(*) FILTER (cat = 'informes') informes, count(*) FILTER (cat = 'pliegos') pliegos, count(*) FILTER (cat = 'otros') otros,
  string_agg(nombre || ' (' || CAST(fecha AS VARCHAR) || ')', ' | ' ORDER BY rn) FILTER (cat = 'modificatorios' AND rn <= 8) lista_modificatorios,
  string_agg(nombre || ' (' || CAST(fecha AS VARCHAR) || ')', ' | ' ORDER BY rn) FILTER (cat = 'legalizaciones' AND rn <= 8) lista_legalizaciones
FROM d GROUP BY process_id""")
def a7(t):
    return R.document_counts(t.archivos, D.file_category("nombre"))


@query("A3_A4_A6_A7_whole_lists", f"""
u AS (SELECT process_id, 'polizas' lista, g.fecha_fin::TIMESTAMP cuando, 1 dir, tipo || ' ' || aseguradora || ' #' || numero || ' (' || g.estado || ', vence ' || CAST(g.fecha_fin AS VARCHAR) || ')' t FROM {{garantias}} g JOIN (SELECT id_contrato, process_id FROM {{contratos}}) USING (id_contrato)
UNION ALL SELECT process_id, 'facturas', fecha::TIMESTAMP, -1, concat_ws(' ', CAST(fecha AS VARCHAR), '#' || numero, f.estado, '$' || CAST(valor_a_pagar AS VARCHAR)) FROM {{facturas}} f JOIN (SELECT id_contrato, process_id FROM {{contratos}}) USING (id_contrato)
UNION ALL SELECT process_id, 'ediciones', ultima::TIMESTAMP, -1, strftime(ultima, '%Y-%m-%dT%H:%M:%S') || ' ' || descripcion FROM {{mod_procesos}}
UNION ALL SELECT process_id, {_CAT}, fecha::TIMESTAMP, -1, nombre || ' (' || CAST(fecha AS VARCHAR) || ')' FROM {{archivos}} WHERE {_CAT} IN ('modificatorios', 'legalizaciones')),
n AS (SELECT *, row_number() OVER (PARTITION BY process_id, lista ORDER BY dir * epoch_us(cuando), t) - 1 i FROM u)
SELECT process_id, lista, i // 32 part, string_agg(t, ' | ' ORDER BY i) texto FROM n GROUP BY 1, 2, 3""")
def whole_lists(t):
    return R.whole_lists(t.contratos, t.garantias, t.facturas, t.mod_procesos, t.archivos, D.file_category("nombre"), 32)


@query("A8_budget", """
a AS (SELECT id_contrato, sum(CASE WHEN valor > 0 THEN valor END) a, sum(CASE WHEN valor <= 0 THEN -valor END) r FROM {adiciones} GROUP BY 1),
s AS (SELECT process_id, sum(valor) inicial, coalesce(sum(a), 0)::DECIMAL(38,2) adiciones, coalesce(sum(r), 0)::DECIMAL(38,2) reducciones, sum(valor_pagado) pagado
      FROM {contratos} LEFT JOIN a USING (id_contrato) GROUP BY 1)
SELECT *, inicial + adiciones - reducciones total,
  CASE WHEN inicial > 0 AND inicial + adiciones - reducciones > 0
       THEN """ + pct_sql("pagado", "inicial + adiciones - reducciones") + """ END avance_pct FROM s""")
def a8(t):
    return R.budget(t.contratos, t.adiciones)


@query("A19_entity_counts", """
SELECT (SELECT count(*) FROM {procesos}) procesos, (SELECT count(*) FROM {procesos} WHERE adjudicado = 'Si') adjudicados,
  (SELECT count(*) FROM {contratos}) contratos, (SELECT count(*) FROM {contratos} WHERE estado = 'En ejecución') en_ejecucion,
  (SELECT count(DISTINCT n) FROM (SELECT nullif(regexp_extract(url, 'CO1\\.NTC\\.\\d+'), '') n FROM {contratos} UNION ALL
     SELECT nullif(regexp_extract(url_contrato, 'CO1\\.NTC\\.\\d+'), '') FROM {integrado})) avisos""")
def a19(t):
    c = t.contratos.withColumn("notice_id", notice_id("url"))
    return R.entity_counts(t.procesos, c, t.integrado.withColumn("notice_id", notice_id("url_contrato")))


def _with_recency(t):
    c = t.contratos
    return c.withColumn("fecha_notificacion", F.when(F.col("modalidad") == "1-URGENT", F.col("fecha_inicio"))).withColumn(
        "fecha_actualizacion", F.when(F.col("modalidad") == "2-HIGH", F.col("fecha_liquidacion")))


@query("A20_W5_recent_amendments", """
m AS (SELECT *, coalesce(CASE WHEN modalidad = '1-URGENT' THEN fecha_inicio END, CASE WHEN modalidad = '2-HIGH' THEN fecha_liquidacion END, fecha_fin) recencia
      FROM {contratos} WHERE estado = 'Modificado' OR dias_adicionados > 0)
SELECT id_contrato, estado, dias_adicionados, fecha_firma, recencia, (SELECT count(*) FROM m) total_modificados,
  (SELECT CAST(sum(dias_adicionados) AS BIGINT) FROM m) total_dias, (SELECT max(recencia) FROM m) ultimo
FROM m ORDER BY recencia DESC NULLS LAST, seq LIMIT 20""")
def a20(t):
    return R.recent_amendments(_with_recency(t))


@query("A20_recent_amendments_signed", """
m AS (SELECT *, fecha_firma recencia FROM {contratos} WHERE regexp_matches(estado, '(?i)modific') OR dias_adicionados > 0)
SELECT id_contrato, estado, dias_adicionados, fecha_firma, recencia, (SELECT count(*) FROM m) total_modificados,
  (SELECT CAST(sum(dias_adicionados) AS BIGINT) FROM m) total_dias, (SELECT max(recencia) FROM m) ultimo
FROM m ORDER BY recencia DESC NULLS LAST, seq LIMIT 20""")
def a20_signed(t):
    return R.recent_amendments(t.contratos, mode="signed")


@query("A17_freshness", f"SELECT max(fecha_firma) ultima_firma, datediff('day', max(fecha_firma), DATE '{AS_OF}') dias_desde FROM {{contratos}}")
def a17(t):
    return R.freshness(t.contratos, AS_OF)


@query("A18_attention_stats", f"""
d AS (SELECT process_id, bool_or(estado = 'Modificado') m, bool_or(datediff('day', DATE '{AS_OF}', fecha_fin) BETWEEN 0 AND 30) v FROM {{contratos}}
      WHERE estado = 'Modificado' OR datediff('day', DATE '{AS_OF}', fecha_fin) BETWEEN 0 AND 30 GROUP BY 1)
SELECT count(*) total, count(*) FILTER (m) modificados, count(*) FILTER (v) por_vencer FROM d""")
def a18(t):
    return R.attention_stats(FL.attention_flags(t.contratos, AS_OF))


@query("A21_last_activity", """
SELECT max(ts) FILTER (op = 'fill') ultimo_fill, max(ts) FILTER (op = 'replace') ultimo_replace, max(ts) FILTER (op = 'verify_drift') ultima_verificacion,
  count(*) total_operaciones, max(ts) FILTER (op IN ('fill', 'replace', 'verify_drift')) ultima_consulta FROM {bitacora}""")
def a21(t):
    return R.last_activity(t.bitacora)


@query("A29_run_report", """
c AS (SELECT process_id, bool_or(dias_adicionados > 0) d FROM {contratos} GROUP BY 1),
a AS (SELECT DISTINCT process_id FROM {adiciones} JOIN {contratos} USING (id_contrato)),
r AS (SELECT w.process_id, p.process_id IS NOT NULL encontrado, CASE WHEN p.process_id IS NULL THEN '' WHEN a.process_id IS NOT NULL OR c.d THEN 'Sí' ELSE 'No' END hubo
      FROM (SELECT coalesce(notice_id, process_id, url) process_id FROM {watch}) w LEFT JOIN {procesos} p USING (process_id) LEFT JOIN c USING (process_id) LEFT JOIN a USING (process_id))
SELECT count(*) total, count(*) FILTER (encontrado) ok, count(*) FILTER (hubo = 'Sí') con_modificatorio,
  count(*) FILTER (encontrado AND hubo = 'No') sin_modificatorio, count(*) FILTER (NOT encontrado) errores FROM r""")
def a29(t):
    s = R.amendment_totals_by_process(t.contratos, t.adiciones, t.mod_contratos)
    s = s.select("process_id", ((F.col("n_add") + F.col("n_rich") > 0) | (F.col("dias") > 0)).alias("si"))
    w = t.watch.select(F.coalesce("notice_id", "process_id", "url").alias("process_id"))
    found = t.procesos.select("process_id", F.lit(True).alias("f"))
    rows = w.join(found, "process_id", "left").join(s, "process_id", "left")
    rows = rows.select("process_id", F.coalesce("f", F.lit(False)).alias("encontrado"),
                       F.when(F.col("f").isNull(), "").when(F.coalesce("si", F.lit(False)), "Sí").otherwise("No").alias("hubo"))
    return R.run_report(rows)


@query("W1_main_contract", """
SELECT process_id, id_contrato, fecha_firma FROM
 (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY fecha_firma DESC NULLS LAST, seq) rn FROM {contratos}) WHERE rn = 1""")
def w1(t):
    return O.latest(t.contratos, ["process_id"], [F.desc_nulls_last("fecha_firma"), "seq"]).select("process_id", "id_contrato", "fecha_firma")


@query("W3_newest_policies_list", """
r AS (SELECT id_contrato, numero || ' ' || CAST(fecha_fin AS VARCHAR) t, row_number() OVER (PARTITION BY id_contrato ORDER BY fecha_fin DESC, numero, valor) rn,
      count(*) OVER (PARTITION BY id_contrato) n FROM {garantias})
SELECT id_contrato, concat_ws(' | ', string_agg(t, ' | ' ORDER BY rn), CASE WHEN any_value(n) > 3 THEN '… y ' || (any_value(n) - 3) || ' más' END) lista
FROM r WHERE rn <= 3 GROUP BY 1""")
def w3(t):
    text = F.concat_ws(" ", "numero", F.col("fecha_fin").cast("string"))
    return O.top_list(t.garantias, ["id_contrato"], [F.desc("fecha_fin"), "numero", "valor"], 3, text, "lista", more=True)


@query("W4_top_recent", """
SELECT id_contrato, fecha_firma, dias_adicionados FROM {contratos} WHERE dias_adicionados > 0 ORDER BY fecha_firma DESC, seq LIMIT 8""")
def w4(t):
    return O.first_rows(FL.amended(t.contratos), [F.desc("fecha_firma"), "seq"], 8).select("id_contrato", "fecha_firma", "dias_adicionados")


@query("W6_date_order_breaks", """
u AS (SELECT seq, 'fecha_firma' c, 1 i, fecha_firma v FROM {contratos} UNION ALL SELECT seq, 'fecha_inicio', 2, fecha_inicio FROM {contratos}
  UNION ALL SELECT seq, 'fecha_liquidacion', 3, fecha_liquidacion FROM {contratos} UNION ALL SELECT seq, 'fecha_fin', 4, fecha_fin FROM {contratos}),
n AS (SELECT *, lag(v) OVER w pv, lag(c) OVER w pc FROM u WHERE v IS NOT NULL WINDOW w AS (PARTITION BY seq ORDER BY i))
SELECT seq, pc || '=' || CAST(pv AS VARCHAR) || ' > ' || c || '=' || CAST(v AS VARCHAR) detalle FROM n WHERE v < pv""")
def w6(t):
    cols = ["fecha_firma", "fecha_inicio", "fecha_liquidacion", "fecha_fin"]
    return t.contratos.select("seq", F.explode(O.date_order_breaks(cols)).alias("detalle"))


@query("W9_natural_order", """
l AS (SELECT DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN 'sin número' WHEN o_orderstatus = 'F' THEN concat(o_custkey % 97, 'A')
     WHEN o_orderstatus = 'P' THEN concat(o_custkey % 97, 'B') ELSE CAST(o_custkey % 97 AS VARCHAR) END label FROM orders)
SELECT label, row_number() OVER (ORDER BY coalesce(try_cast(regexp_extract(label, '^(\\d+)([A-Z]?)$', 1) AS INT), 10000), regexp_extract(label, '^(\\d+)([A-Z]?)$', 2)) orden FROM l""")
def w9(t):
    from contrapunto.functions.text import natural_key
    n = (F.col("o_custkey") % 97).cast("string")
    label = F.when(F.col("o_orderpriority") == "5-LOW", "sin número").when(F.col("o_orderstatus") == "F", F.concat(n, F.lit("A"))).when(
        F.col("o_orderstatus") == "P", F.concat(n, F.lit("B"))).otherwise(n)
    d = t.orders.select(label.alias("label")).distinct().withColumn("k", natural_key("label"))
    return O.positions(d, [], ["k"], "k.n", "orden").select("label", "orden")


@query("W13_latest_by_key", """
SELECT notice, seq, valor FROM (SELECT nullif(regexp_extract(url_contrato, 'CO1\\.NTC\\.\\d+'), '') notice, seq, valor,
  row_number() OVER (PARTITION BY nullif(regexp_extract(url_contrato, 'CO1\\.NTC\\.\\d+'), '') ORDER BY seq DESC) rn FROM {integrado}) WHERE rn = 1 AND notice IS NOT NULL""")
def w13(t):
    d = t.integrado.select(notice_id("url_contrato").alias("notice"), "seq", "valor").where("notice is not null")
    return O.latest(d, ["notice"], [F.desc("seq")])
