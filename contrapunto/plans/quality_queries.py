"""Queries of the checks and confidence rollups (Q*, A10-A12, A23, A27, A28, K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapunto.functions.identifiers import contract_id, notice_id
from contrapunto.functions.money import money_close
from contrapunto.operators import fill as FI
from contrapunto.operators import quality as Q
from contrapunto.operators import rollups as RU
from contrapunto.plans.projection_queries import FILL_STEPS, fills_of
from contrapunto.plans.registry import query
from contrapunto.plans.resolve_queries import cascade_sql, cascaded
from contrapunto.sources.sinks import audit_report

_ISSUE = "regla, columna, 'warn' severidad, detalle"


def _order_sql(pairs):
    return " UNION ALL ".join(f"SELECT id_contrato, 'orden_fechas' regla, '{b}' columna, 'warn' severidad, CAST({b} AS VARCHAR) || ' < ' || CAST({a} AS VARCHAR) detalle FROM {{contratos}} WHERE {b} < {a}" for a, b in pairs)


@query("Q1_check_dates", _order_sql([("fecha_firma", "fecha_inicio"), ("fecha_inicio", "fecha_fin"), ("fecha_fin", "fecha_liquidacion")])
       + " UNION ALL SELECT id_contrato, 'anio_antiguo', 'fecha_firma', 'warn', CAST(year(fecha_firma) AS VARCHAR) FROM {contratos} WHERE year(fecha_firma) < 1990")
def q1(t):
    return Q.check_dates(t.contratos, ["id_contrato"], ["fecha_firma", "fecha_inicio", "fecha_fin", "fecha_liquidacion"])


@query("Q2_check_arithmetic", """
a AS (SELECT id_contrato, sum(CASE WHEN valor > 0 THEN valor END) a, sum(CASE WHEN valor <= 0 THEN -valor END) r FROM {adiciones} GROUP BY 1),
s AS (SELECT id_contrato, valor inicial, a, r, CASE WHEN modalidad = '2-HIGH' THEN valor ELSE valor + coalesce(a, 0) - coalesce(r, 0) END total FROM {contratos} LEFT JOIN a USING (id_contrato))
SELECT id_contrato, 'monto_negativo' regla, 'inicial' columna, 'warn' severidad, CAST(inicial AS VARCHAR) detalle FROM s WHERE inicial < 0
UNION ALL SELECT id_contrato, 'monto_negativo', 'total', 'warn', CAST(total AS VARCHAR) FROM s WHERE total < 0
UNION ALL SELECT id_contrato, 'aritmetica', 'total', 'warn', CAST(inicial + coalesce(a, 0) - coalesce(r, 0) AS VARCHAR) FROM s WHERE abs(inicial + coalesce(a, 0) - coalesce(r, 0) - total) > 1""")
def q2(t):
    a = t.adiciones.groupBy("id_contrato").agg(RU.total(F.when(F.col("valor") > 0, F.col("valor"))).alias("adiciones"), RU.total(F.when(F.col("valor") <= 0, -F.col("valor"))).alias("reducciones"))
    d = t.contratos.select("id_contrato", "modalidad", F.col("valor").alias("inicial")).join(a, "id_contrato", "left")
    zero = F.lit(0).cast("decimal(38,2)")
    full = (F.col("inicial") + F.coalesce("adiciones", zero) - F.coalesce("reducciones", zero)).cast("decimal(38,2)")
    return Q.check_arithmetic(d.withColumn("total", F.when(F.col("modalidad") == "2-HIGH", F.col("inicial").cast("decimal(38,2)")).otherwise(full)), ["id_contrato"])


@query("Q3_check_taxid", """
d AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN concat('CC-', c_custkey) WHEN c_mktsegment = 'FURNITURE' THEN concat('800.255.', '024') ELSE '860007738' END num,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '5' WHEN c_mktsegment = 'FURNITURE' THEN '3' WHEN c_mktsegment = 'MACHINERY' THEN '9' END dv, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'CC' ELSE 'NIT' END kind FROM customer)
SELECT c_custkey, 'formato' regla, 'num' columna, 'warn' severidad, replace(num, '-', '') detalle FROM d WHERE num LIKE 'CC%'
UNION ALL SELECT c_custkey, 'digito_sobrante', 'dv', 'warn', dv FROM d WHERE kind = 'CC' AND dv IS NOT NULL
UNION ALL SELECT c_custkey, 'digito', 'dv', 'warn', dv || ' != 9' FROM d WHERE dv = '5'""")
def q3(t):
    s = F.col("c_mktsegment")
    num = F.when(s == "HOUSEHOLD", F.concat(F.lit("CC-"), "c_custkey")).when(s == "FURNITURE", "800.255.024").otherwise("860007738")
    dv = F.when(s == "BUILDING", "5").when(s == "FURNITURE", "3").when(s == "MACHINERY", "9")
    d = t.customer.select("c_custkey", num.alias("num"), dv.alias("dv"), F.when(s == "MACHINERY", "CC").otherwise("NIT").alias("kind"))
    return Q.check_taxid(d, ["c_custkey"], "num", "dv", "kind")


@query("Q4_check_percent", """
d AS (SELECT id_contrato, 1.5 * avance_real p, avance_real - 10 m FROM {ejecucion})
SELECT id_contrato, 'porcentaje' regla, 'p' columna, 'warn' severidad, CAST(CAST(p AS DECIMAL(12,3)) AS VARCHAR) detalle FROM d WHERE p > 100 OR p < 0
UNION ALL SELECT id_contrato, 'porcentaje', 'm', 'warn', CAST(CAST(m AS DECIMAL(12,3)) AS VARCHAR) FROM d WHERE m > 100 OR m < 0""")
def q4(t):
    d = t.ejecucion.select("id_contrato", (F.col("avance_real") * F.lit(1.5).cast("decimal(2,1)")).cast("decimal(12,3)").alias("p"), (F.col("avance_real") - 10).cast("decimal(12,3)").alias("m"))
    return Q.check_percent(d, ["id_contrato"], ["p", "m"])


@query("Q5_review_list", """
i AS (SELECT DISTINCT process_id, '9' l, 9 n FROM {contratos} WHERE fecha_fin < fecha_inicio UNION SELECT DISTINCT process_id, '8', 8 FROM {contratos} WHERE fecha_inicio < fecha_firma
  UNION SELECT DISTINCT process_id, '68', 68 FROM {contratos} WHERE fecha_liquidacion < fecha_fin)
SELECT process_id, string_agg(l, ', ' ORDER BY n) revisar FROM i GROUP BY 1""")
def q5(t):
    names = F.create_map(*[F.lit(x) for kv in {"fecha_inicio": "8. FECHA INICIO", "fecha_fin": "9. FECHA TERMINACIÓN", "fecha_liquidacion": "68. FECHA LIQUIDACIÓN"}.items() for x in kv])
    issues = Q.check_dates(t.contratos, ["process_id"], ["fecha_firma", "fecha_inicio", "fecha_fin", "fecha_liquidacion"])
    return FI.review_list(issues.withColumn("columna", F.try_element_at(names, F.col("columna"))))


@query("Q6_source_rules", """
d AS (SELECT c.id_contrato, c.estado a_estado, CASE WHEN c.modalidad = '1-URGENT' THEN upper(c.estado) ELSE i.estado END b_estado, c.valor a, i.valor b, c.dias_adicionados m, 2 n
      FROM {contratos} c JOIN {integrado} i ON i.numero_del_contrato = c.id_contrato)
SELECT id_contrato, 'exact_ci' regla, 'a_estado' columna, 'warn' severidad, a_estado || ' vs ' || b_estado detalle FROM d WHERE lower(a_estado) <> lower(b_estado)
UNION ALL SELECT id_contrato, 'money', 'a_valor', 'warn', CAST(a AS VARCHAR) || ' vs ' || CAST(b AS VARCHAR) FROM d WHERE b <> 0 AND abs(a - b) * 100 > b
UNION ALL SELECT id_contrato, 'money_soft', 'a_valor', 'warn', CAST(a AS VARCHAR) || ' vs ' || CAST(b AS VARCHAR) FROM d WHERE b <> 0 AND abs(a - b) * 100 > 20 * b
UNION ALL SELECT id_contrato, 'mods_count', 'm', 'warn', m || ' vs 2' FROM d WHERE m = 0""")
def q6(t):
    i = t.integrado.select(F.col("numero_del_contrato").alias("id_contrato"), F.col("valor").alias("b_valor"), F.col("estado").alias("i_estado"))
    d = t.contratos.join(i, "id_contrato").select(
        "id_contrato", F.col("estado").alias("a_estado"), F.when(F.col("modalidad") == "1-URGENT", F.upper("estado")).otherwise(F.col("i_estado")).alias("b_estado"),
        F.col("valor").alias("a_valor"), "b_valor", F.col("dias_adicionados").alias("m"), F.lit(2).alias("n"))
    return Q.check_pairs(d, ["id_contrato"], [("a_estado", "b_estado", "exact_ci"), ("a_valor", "b_valor", "money"), ("a_valor", "b_valor", "money_soft"), ("m", "n", "mods_count")])


@query("Q7_internal_rules", """
d AS (SELECT c.id_contrato, c.proveedor a, coalesce(i.proveedor, '') b, c.documento da, CASE WHEN c.modalidad = '2-HIGH' THEN '999' ELSE 'NIT ' || c.documento END db, c.fecha_firma, c.fecha_inicio, c.fecha_fin
      FROM {contratos} c LEFT JOIN {integrado} i ON i.numero_del_contrato = c.id_contrato),
n AS (SELECT *, lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) na, lower(trim(regexp_replace(b, '\\s+', ' ', 'g'))) nb FROM d)
SELECT id_contrato, 'fuzzy_name' regla, 'a' columna, 'warn' severidad, a || ' vs ' || b detalle FROM n WHERE nb <> '' AND jaro_winkler_similarity(na, nb) < 0.85
UNION ALL SELECT id_contrato, 'taxid', 'da', 'warn', da || ' vs ' || db FROM n WHERE db = '999' AND NOT contains(da, '999')
UNION ALL SELECT id_contrato, 'orden_fechas', 'fechas', 'warn', 'fecha_firma=' || CAST(fecha_firma AS VARCHAR) || ' > fecha_inicio=' || CAST(fecha_inicio AS VARCHAR) FROM n WHERE fecha_inicio < fecha_firma""")
def q7(t):
    i = t.integrado.select(F.col("numero_del_contrato").alias("id_contrato"), F.col("proveedor").alias("b"))
    d = t.contratos.join(i, "id_contrato", "left").withColumns({
        "a": F.col("proveedor"), "da": F.col("documento"),
        "db": F.when(F.col("modalidad") == "2-HIGH", "999").otherwise(F.concat(F.lit("NIT "), "documento"))})
    return Q.check_internal(d, ["id_contrato"], [("a", "b", "fuzzy_name"), ("da", "db", "taxid")], ["fecha_firma", "fecha_inicio", "fecha_fin"])


def _values(t):
    return Q.source_values({
        "api": Q.source_row(t.contratos, "valor", "fecha_firma", "proveedor"),
        "integrado": Q.source_row(t.integrado.withColumnRenamed("numero_del_contrato", "id_contrato"), "valor", "fecha_firma", "proveedor"),
        "portal": Q.source_row(t.portal_contratos, "valor_texto", "fecha_texto", "proveedor", money_mode="plain")})


_NW = "trim(regexp_replace(lower(strip_accents({})), '\\s+', ' ', 'g'))"


def _pair_sql(a: str, b: str) -> str:
    wa, wb = _NW.format(f"p_{a}"), _NW.format(f"p_{b}")
    la, lb = f"list_distinct(string_split({wa}, ' '))", f"list_distinct(string_split({wb}, ' '))"
    match = f"({wa} = {wb} OR contains({wa}, {wb}) OR contains({wb}, {wa}) OR len(list_intersect({la}, {lb})) * 100 >= 85 * least(len({la}), len({lb})))"
    return f"""
SELECT id_contrato, 'valor' campo, '{a}' fuente_a, CAST(v_{a} AS VARCHAR) valor_a, '{b}' fuente_b, CAST(v_{b} AS VARCHAR) valor_b,
  CAST(round_even(abs(v_{a} - v_{b})::DOUBLE * 100 / greatest(abs(v_{a}), abs(v_{b}))::DOUBLE, 2) AS DECIMAL(9,2)) diff_pct FROM v WHERE v_{a} <> v_{b} AND abs(v_{a} - v_{b}) * 200 >= greatest(abs(v_{a}), abs(v_{b}))
UNION ALL SELECT id_contrato, 'fecha', '{a}', CAST(f_{a} AS VARCHAR), '{b}', CAST(f_{b} AS VARCHAR), NULL FROM v WHERE f_{a} <> f_{b}
UNION ALL SELECT id_contrato, 'proveedor', '{a}', p_{a}, '{b}', p_{b}, NULL FROM v WHERE NOT {match}"""


_CROSS = """
v AS (SELECT c.id_contrato, c.valor v_api, i.valor v_integrado, try_cast(replace(valor_texto, '$ ', '') AS DECIMAL(18,2)) v_portal, c.fecha_firma f_api, i.fecha_firma f_integrado,
   CAST(strptime(regexp_extract(fecha_texto, '^\\d+/\\d+/\\d+'), '%d/%m/%Y') AS DATE) f_portal, c.proveedor p_api, i.proveedor p_integrado, q.proveedor p_portal
   FROM {contratos} c LEFT JOIN {integrado} i ON i.numero_del_contrato = c.id_contrato LEFT JOIN {portal_contratos} q ON q.id_contrato = c.id_contrato),
x AS (""" + " UNION ALL ".join(_pair_sql(a, b) for a, b in (("api", "integrado"), ("api", "portal"), ("integrado", "portal"))) + ")"
_SOURCES = ["api", "integrado", "portal"]


@query("Q8_J15_cross_check", _CROSS + " SELECT * FROM x")
def q8(t):
    return Q.cross_check(_values(t), _SOURCES)


@query("A23_discrepancy_stats", _CROSS + " SELECT campo, count(*) discrepancias, count(DISTINCT id_contrato) afectados, count(*) FILTER (diff_pct > 50) criticas FROM x GROUP BY 1")
def a23(t):
    return Q.discrepancy_stats(Q.cross_check(_values(t), _SOURCES))


@query("Q9_money_close", """
SELECT c.id_contrato, c.valor = i.valor OR abs(c.valor - i.valor) * 200 < greatest(abs(c.valor), abs(i.valor)) mayor, i.valor = 0 OR abs(c.valor - i.valor) * 100 <= abs(i.valor) segundo
FROM {contratos} c JOIN {integrado} i ON i.numero_del_contrato = c.id_contrato""")
def q9(t):
    i = t.integrado.select(F.col("numero_del_contrato").alias("id_contrato"), F.col("valor").alias("b"))
    return t.contratos.join(i, "id_contrato").select("id_contrato", money_close("valor", "b", 0.005, "larger").alias("mayor"), money_close("valor", "b", 0.01, "second").alias("segundo"))


_A, _B = _NW.format("s_name"), _NW.format("CASE WHEN s_nationkey < 8 THEN '  ' || upper(s_name) || ' de  ' || n_name WHEN s_nationkey < 16 THEN n_name || ' ' || s_name || ' sas' ELSE 'Otro ' || n_name END")


@query("Q10_U5_text_match", f"""
SELECT s_suppkey, ({_A} = {_B} OR contains({_A}, {_B}) OR contains({_B}, {_A}) OR len(list_intersect(list_distinct(string_split({_A}, ' ')), list_distinct(string_split({_B}, ' ')))) * 100
  >= 85 * least(len(list_distinct(string_split({_A}, ' '))), len(list_distinct(string_split({_B}, ' '))))) coincide FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def q10(t):
    d = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    other = F.when(F.col("s_nationkey") < 8, F.concat(F.lit("  "), F.upper("s_name"), F.lit(" de  "), "n_name")).when(
        F.col("s_nationkey") < 16, F.concat("n_name", F.lit(" "), "s_name", F.lit(" sas"))).otherwise(F.concat(F.lit("Otro "), "n_name"))
    return d.select("s_suppkey", Q.text_match("s_name", other).alias("coincide"))


# ---- Coverage audit ---------------------------------------------------------


def _audit_rows(t, priority=("api", "integrado"), faults=False):
    portal = t.portal.select("notice_id").distinct()
    integ = t.integrado.select(notice_id("url_contrato").alias("k")).where("k is not null").distinct()
    linked = t.integrado.select(contract_id("numero_del_contrato").alias("k")).where(contract_id("url_contrato").isNull()).distinct()
    mark = lambda d, c, key, name: d.select(F.col(c).alias(key), F.lit(True).alias(name))
    d = cascaded(t, priority)
    if faults:  # links without an id get a malformed one, one year lost its references, another its sheets
        d = d.withColumns({"process_id": F.coalesce("process_id", F.concat(F.lit("CO1-NTC-"), "item")), "ref": F.when(F.col("vigencia") != "1995", F.col("ref")), "sheet": F.when(F.col("vigencia") != "1998", F.col("sheet"))})
    d = d.join(mark(portal, "notice_id", "notice_id", "en_portal_n"), "notice_id", "left").join(mark(portal, "notice_id", "process_id", "en_portal_p"), "process_id", "left")
    d = d.join(mark(integ, "k", "notice_id", "en_integrado"), "notice_id", "left").join(mark(linked, "k", "process_id", "en_enlace"), "process_id", "left")
    return d.withColumn("datos_manuales", F.when(F.col("edited_at") > "2000-06-01", "x"))


_AUDIT = cascade_sql((0, 9, 1)).replace("UNION ALL SELECT 9, 'portal', * FROM por ", "") + """,
d AS (SELECT cas.*, x.edited_at > DATE '2000-06-01' fuga, cas.notice_id IN (SELECT notice_id FROM {portal}) pn, cas.process_id IN (SELECT notice_id FROM {portal}) pp,
   cas.notice_id IN (SELECT nullif(regexp_extract(url_contrato, 'CO1\\.NTC\\.\\d+'), '') k FROM {integrado} WHERE k IS NOT NULL) ei,
   cas.process_id IN (SELECT numero_del_contrato FROM {integrado} WHERE regexp_extract(url_contrato, 'CO1\\.PCCNTR\\.\\d+') = '') en, cas.process_id LIKE 'CO1.REQ.%' dr FROM cas JOIN {watch} x ON x.seq = cas.item),
i AS (SELECT item, '02_fuga' regla, 'fp' severidad FROM d WHERE fuga UNION ALL SELECT item, '03_indice', 'fn' FROM d WHERE data_source = 'none' AND en
 UNION ALL SELECT item, '07_aviso_en_portal', 'fn' FROM d WHERE data_source = 'none' AND pn UNION ALL SELECT item, '08_proceso_en_portal', 'fn' FROM d WHERE data_source = 'none' AND pp
 UNION ALL SELECT item, '09_tambien_integrado', 'info' FROM d WHERE data_source = 'api' AND ei UNION ALL SELECT item, '10_vigencia', 'warn' FROM d WHERE data_source = 'api' AND CAST(year(fecha_firma) AS VARCHAR) <> vigencia
 UNION ALL SELECT item, '12_no_https', 'warn' FROM d WHERE url NOT LIKE 'https://%' UNION ALL SELECT item, '13_captura', 'scrape' FROM d WHERE data_source = 'none' AND process_id IS NOT NULL AND NOT dr)"""


@query("Q11_audit_items", _AUDIT + " SELECT item, regla, severidad FROM i")
def q11(t):
    return Q.audit_items(_audit_rows(t)).select("item", "regla", "severidad")


_AUDIT_ALL = _AUDIT.replace("UNION ALL SELECT 1, 'integrado'", "UNION ALL SELECT 1, 'portal', * FROM por UNION ALL SELECT 2, 'integrado'").replace("d AS (SELECT cas.*", """
caf AS (SELECT * REPLACE (coalesce(process_id, 'CO1-NTC-' || item) AS process_id, CASE WHEN vigencia <> '1995' THEN ref END AS ref, CASE WHEN vigencia <> '1998' THEN sheet END AS sheet) FROM cas),
d AS (SELECT caf.*""").replace("cas.notice_id IN", "caf.notice_id IN").replace("cas.process_id", "caf.process_id").replace("FROM cas JOIN {watch} x ON x.seq = cas.item", "FROM caf JOIN {watch} x ON x.seq = caf.item")


@query("Q11_audit_all_rules", _AUDIT_ALL + """
SELECT item, regla, severidad FROM i UNION ALL SELECT item, '01_formato', 'warn' FROM d WHERE NOT regexp_matches(process_id, '^CO1\\.[A-Z]+\\.\\d+$')
UNION ALL SELECT item, CASE data_source WHEN 'api' THEN '04_api_sin_id' WHEN 'integrado' THEN '05_integrado_sin_enlace' ELSE '06_portal_sin_campos' END, 'fp' FROM d WHERE data_source <> 'none' AND ref IS NULL
UNION ALL SELECT item, '11_sin_apariciones', 'warn' FROM d WHERE sheet IS NULL""")
def q11_all(t):
    """All three sources, and items with the faults that a clean list cannot have."""
    return Q.audit_items(_audit_rows(t, ("api", "portal", "integrado"), True)).select("item", "regla", "severidad")


@query("A27_severity_counts", _AUDIT + " SELECT severidad, count(*) n FROM i GROUP BY 1")
def a27(t):
    return Q.severity_counts(Q.audit_items(_audit_rows(t)))


_VERDICT = """
s AS (SELECT id_contrato, modalidad <> '5-LOW' valido, modalidad IN ('1-URGENT', '2-HIGH') nota, estado = 'Modificado' api, d.n IS NOT NULL docs FROM {contratos}
   LEFT JOIN (SELECT id_contrato, count(*) n FROM {suspensiones} GROUP BY 1) d USING (id_contrato)),
v AS (SELECT *, CASE WHEN NOT valido THEN 'no_aplicable' WHEN NOT nota AND NOT api AND NOT docs THEN 'concuerdan_sin_modif' WHEN nota AND NOT api AND docs THEN 'api_atrasado_docs_y_nota_si'
   WHEN nota AND (api OR docs) THEN 'concuerdan_con_modif' WHEN api OR docs THEN 'fuente_dice_si_nota_no' ELSE 'nota_dice_si_fuente_no' END veredicto FROM s)"""


def _verdicts(t):
    docs = t.suspensiones.groupBy("id_contrato").agg(F.count("*").alias("n"))
    d = t.contratos.join(docs, "id_contrato", "left").select(
        "id_contrato", (F.col("modalidad") != "5-LOW").alias("valido"), F.col("modalidad").isin("1-URGENT", "2-HIGH").alias("nota"),
        (F.col("estado") == "Modificado").alias("api"), F.col("n").isNotNull().alias("docs"))
    return Q.audit_verdicts(d)


@query("Q12_verdicts", _VERDICT + " SELECT id_contrato, veredicto, veredicto = 'nota_dice_si_fuente_no' revisar FROM v")
def q12(t):
    return _verdicts(t).select("id_contrato", "veredicto", "revisar")


@query("A12_K5_verdict_counts", _VERDICT + " SELECT veredicto, count(*) filas, veredicto = 'nota_dice_si_fuente_no' requiere_revision FROM v GROUP BY ALL")
def a12(t):
    return audit_report(_verdicts(t))["resumen"].orderBy(F.desc("filas"))


@query("K5_report_alerts", _VERDICT + " SELECT id_contrato, veredicto FROM v WHERE veredicto = 'nota_dice_si_fuente_no'")
def k5(t):
    return audit_report(_verdicts(t))["alertas"].select("id_contrato", "veredicto")


# ---- Portal and pinned checks -----------------------------------------------


@query("Q13_completeness", """
SELECT notice_id, concat_ws(', ', CASE WHEN coalesce(trim(titulo), '') = '' THEN 'titulo' END, CASE WHEN tipo_proceso IS NULL THEN 'tipo_proceso' END, CASE WHEN numero_proceso IS NULL THEN 'numero_proceso' END) faltantes,
  CASE WHEN coalesce(trim(titulo), '') <> '' AND tipo_proceso IS NOT NULL AND numero_proceso IS NOT NULL THEN 'ok_completo' ELSE 'ok_parcial' END estado_captura FROM {portal}""")
def q13(t):
    return Q.completeness(t.portal).select("notice_id", "faltantes", "estado_captura")


@query("Q15_stamp_missing", """
SELECT notice_id, coalesce(scraped_at, DATE '2024-02-01') scraped_at, coalesce(status, 'ok_completo') status, scraped_at IS NULL OR status IS NULL sellado FROM {portal}""")
def q15(t):
    return Q.stamp_missing(t.portal, "2024-02-01").select("notice_id", "scraped_at", "status", "sellado")


@query("A28_portal_status", """
SELECT coalesce(status, '(sin status)') status, count(*) capturas, count(*) FILTER (n_docs > 0) con_documentos, count(*) FILTER (n_docs = 0) sin_documentos, CAST(sum(n_docs) AS BIGINT) documentos FROM {portal} GROUP BY 1""")
def a28(t):
    return Q.portal_status(t.portal)


@query("Q16_gates", """
SELECT 'documentos' gate, d >= 0.7 * n passed, d || '/' || n detail FROM (SELECT count(*) n, count(*) FILTER (n_docs > 0) d FROM {portal})
UNION ALL SELECT 'capturas', n >= 470, CAST(n AS VARCHAR) FROM (SELECT count(*) n FROM {portal}) UNION ALL SELECT 'lista', n = 1500, CAST(n AS VARCHAR) FROM (SELECT count(*) n FROM {watch})""")
def q16(t):
    return Q.gates(t.portal, t.watch, 1500, 470)


@query("Q17_pinned", cascade_sql((0, 1, 2)) + """
SELECT item, CASE WHEN process_id IS NULL THEN 'none' WHEN process_id LIKE 'CO1.PPI.%' THEN 'portal' ELSE 'api' END esperado, data_source obtenido,
  data_source = CASE WHEN process_id IS NULL THEN 'none' WHEN process_id LIKE 'CO1.PPI.%' THEN 'portal' ELSE 'api' END cumple FROM cas""")
def q17(t):
    want = F.when(F.col("process_id").isNull(), "none").when(F.col("process_id").startswith("CO1.PPI."), "portal").otherwise("api")
    return Q.check_pinned(cascaded(t), t.watch.select(F.col("seq").alias("item"), want.alias("esperado")))


# ---- Confidence and fill decisions ------------------------------------------

_CONF = ", n AS (SELECT process_id, count(*) n, count(*) FILTER (confianza = 'HIGH') h, count(*) FILTER (confianza = 'LOW') l, count(*) FILTER (confianza = 'MEDIUM') m FROM fills GROUP BY 1)"


@query("A10_worst_confidence", FILL_STEPS + _CONF + " SELECT process_id, CASE WHEN l > 0 THEN 'LOW' WHEN m > 0 THEN 'MEDIUM' ELSE 'HIGH' END confianza FROM n")
def a10(t):
    return FI.worst_confidence(fills_of(t))


@query("A11_ratio_confidence", FILL_STEPS + _CONF + " SELECT process_id, CASE WHEN h >= 0.7 * n THEN 'HIGH' WHEN l > 0 THEN 'LOW' ELSE 'MEDIUM' END confianza FROM n")
def a11(t):
    return FI.ratio_confidence(fills_of(t))


_EXISTING = """, lx AS (SELECT 'CO1.NTC.' || custkey process_id, * FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY sheet_ord DESC, row_no DESC) rn FROM {ledger}) WHERE rn = 1),
ex AS (SELECT process_id, 'estado' clave, estado anterior FROM lx UNION ALL SELECT process_id, 'valor_inicial', valor_total FROM lx UNION ALL SELECT process_id, 'fecha_suscripcion', CAST(fecha_suscripcion AS VARCHAR) || ' 00:00:00' FROM lx),
dd AS (SELECT f.*, anterior,
   CASE WHEN clave IN ('valor_inicial', 'valor_inicial_vigencia', 'reducciones', 'adiciones', 'valor_total', 'prorrogas_dias', 'avance_presup', 'ingreso') THEN coalesce(CAST(try_cast(replace(trim(@), ',', '') AS DECIMAL(38,2)) AS VARCHAR), '')
        WHEN clave IN ('fecha_suscripcion', 'fecha_inicio', 'fecha_terminacion', 'garantia_fecha', 'fecha_liquidacion') THEN coalesce(left(@, 10), '') ELSE coalesce(CASE WHEN lower(trim(@)) IN ('n/a') THEN '' ELSE upper(trim(@)) END, '') END na,
   CASE WHEN clave IN ('valor_inicial', 'valor_inicial_vigencia', 'reducciones', 'adiciones', 'valor_total', 'prorrogas_dias', 'avance_presup', 'ingreso') THEN CAST(CAST(valor AS DECIMAL(38,2)) AS VARCHAR)
        WHEN clave LIKE '%fecha%' THEN left(valor, 10) ELSE upper(valor) END nn
   FROM fills f LEFT JOIN ex USING (process_id, clave) WHERE clave <> 'avance_fisico')""".replace("@", "anterior")


def existing_cells(t):
    from contrapunto.plans.source_queries import _ledger_by_process
    d = _ledger_by_process(t)
    cells = F.array(*[F.struct(F.lit(k).alias("clave"), v.alias("valor")) for k, v in (
        ("estado", F.col("estado")), ("valor_inicial", F.col("valor_total")), ("fecha_suscripcion", F.concat(F.col("fecha_suscripcion").cast("string"), F.lit(" 00:00:00"))))])
    return d.select("process_id", F.explode(cells).alias("x")).select("process_id", "x.*")


@query("H8_decide_fills", FILL_STEPS + _EXISTING + """
SELECT process_id, clave, anterior, valor nuevo, CASE WHEN coalesce(anterior, '') = '' THEN 'fill' ELSE 'replace' END op, na NOT IN ('', 'NO', 'N/A') registrar FROM dd WHERE na <> nn""")
def h8(t):
    return FI.decide_fills(fills_of(t), existing_cells(t)).select("process_id", "clave", "anterior", "nuevo", "op", "registrar")
