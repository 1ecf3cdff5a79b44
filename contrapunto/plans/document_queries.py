"""Queries of the document, note and page jobs (T*, A24, A25, A30, F10, Q14, W10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapunto import schemas as S
from contrapunto.functions.dates import last_long_date
from contrapunto.operators import documents as D
from contrapunto.operators import ordering as O
from contrapunto.operators import pages as P
from contrapunto.plans.analogs import portal_pages
from contrapunto.plans.registry import query


def _re(pattern: str) -> str:
    """A pattern in the oracle's dialect: word borders after an accent are dropped."""
    out = pattern.replace(r"\botros[ií]\b", r"\botros(?:í|i\b)").replace(r"otros[ií])\b", r"otros(?:í|i\b))")
    return out.replace("{", "{{").replace("}", "}}")


def _case(col: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '(?i){_re(p)}') THEN '{t}'" for t, p in rules) + " END"


_GUARD = f"regexp_matches(nombre, '(?i){_re('|'.join(D.NAME_GUARDS))}')"
_TYPE = f"CASE WHEN {_GUARD} THEN NULL ELSE {_case('nombre', D.NAME_RULES)} END"
_NUM = "coalesce(" + ", ".join(f"nullif(regexp_extract(nombre, '(?i){_re('|'.join(D.NAME_NUMBERS))}', {i + 1}), '')" for i in range(len(D.NAME_NUMBERS))) + ")"
NAMED = f"nm AS (SELECT *, CASE WHEN tipo IS NOT NULL THEN {_NUM} END numero FROM (SELECT *, {_TYPE} tipo FROM {{archivos}}))"


@query("T2_T3_name_types", NAMED + " SELECT doc_id, tipo, numero FROM nm")
def t2(t):
    return D.classify_names(t.archivos).select("doc_id", "tipo", "numero")


@query("F10_doc_candidates", f"SELECT doc_id FROM {{archivos}} WHERE NOT {_GUARD} AND regexp_matches(nombre, '(?i){_re('|'.join(p for _, p in D.NAME_RULES))}')")
def f10(t):
    return t.archivos.where(D.is_candidate("nombre")).select("doc_id")


_RANK = "coalesce(nullif(list_position([" + ", ".join(f"'{x}'" for x in S.TYPE_ORDER) + "], tipo), 0), 99)"


@query("W10_type_order", NAMED + f"""
SELECT process_id, doc_id, row_number() OVER (PARTITION BY process_id ORDER BY {_RANK}, coalesce(try_cast(regexp_extract(numero, '^(\\d+)', 1) AS INT), 0), doc_id) orden FROM nm WHERE tipo IS NOT NULL""")
def w10(t):
    d = D.classify_names(t.archivos).where("tipo is not null").withColumn("_r", D.type_rank("tipo")).withColumn("_n", D.number_rank("numero"))
    return O.positions(d, ["process_id"], ["_r", "_n", "doc_id"], F.struct("_r", "_n", F.expr("doc_id div 4096")), "orden").select("process_id", "doc_id", "orden")


_LABEL = "CASE tipo " + " ".join(f"WHEN '{k}' THEN CASE WHEN n = 1 THEN '{a}' ELSE '{b}' END" for k, (a, b) in S.TYPE_LABELS.items()) + " END"


@query("A30_type_summary", NAMED + f""", k AS (SELECT process_id, tipo, count(*) n, max(numero) numero FROM nm GROUP BY 1, 2),
p AS (SELECT process_id, sum(n) actos, string_agg(n || ' ' || {_LABEL}, ' · ' ORDER BY {_RANK}) t, max(concat_ws(' N° ', tipo, numero)) solo FROM k WHERE tipo IS NOT NULL GROUP BY 1)
SELECT process_id, CAST(coalesce(actos, 0) AS BIGINT) actos, CASE WHEN actos IS NULL THEN 'Sin modificatorios' WHEN actos = 1 THEN solo ELSE CAST(actos AS BIGINT) || ' actos · ' || t END resumen
FROM (SELECT DISTINCT process_id FROM nm) LEFT JOIN p USING (process_id)""")
def a30(t):
    return D.type_summary(D.classify_names(t.archivos))


@query("T19_evidence_count", """
SELECT process_id, count(*) archivos, count(*) FILTER (regexp_matches(upper(nombre), 'MODIFIC|OTROSI|PRORROGA|ADICION')) con_evidencia FROM {archivos} GROUP BY 1""")
def t19(t):
    return D.evidence_count(t.archivos)


@query("T12_type_class", NAMED + f" SELECT doc_id, coalesce(tipo IN ({', '.join(repr(x) for x in S.CORE_TYPES)}), false) nucleo, coalesce(tipo IN ({', '.join(repr(x) for x in S.SUPPORT_TYPES)}), false) soporte FROM nm")
def t12(t):
    return D.classify_names(t.archivos).select("doc_id", D.is_core("tipo").alias("nucleo"), D.is_support("tipo").alias("soporte"))


def _strip_sql(src: str) -> str:
    out = src
    for p in D.BOILERPLATE:
        out = f"regexp_replace({out}, '(?i){_re(p)}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' *\\n\\s*', chr(10), 'g'))"


CLEAN = f"cl AS (SELECT doc_id, process_id, nombre, url, {_strip_sql('texto')} c FROM {{archivos}})"


def _dirty(t):
    return t.archivos.withColumn("texto", F.concat(F.lit("Radicado No. 123 Página 2 de 9  12/05/2021 10:30 AM "), "texto"))


@query("T4_strip_boilerplate", f"SELECT doc_id, sha256({_strip_sql(chr(39) + 'Radicado No. 123 Página 2 de 9  12/05/2021 10:30 AM ' + chr(39) + ' || texto')}) huella FROM {{archivos}}")
def t4(t):
    return _dirty(t).select("doc_id", F.sha2(D.strip_boilerplate("texto"), 256).alias("huella"))


_WORDS = "|".join(list(D.CONTENT_WORDS.values()) + [D.LEGALIZATION])
_KW = _re(r"\b(?:" + _WORDS + r")\b")
TITLES = f""", ti AS (SELECT *, list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x)), lambda x: x <> '') li FROM cl),
tt AS (SELECT *, list_filter(li, lambda x: length(x) >= 15 AND (length(regexp_replace(x, '\\P{{{{Lu}}}}', '', 'g')) / length(x) > 0.5 OR regexp_matches(strip_accents(lower(x)), '{_KW}'))) cand FROM ti),
tu AS (SELECT *, CASE WHEN len(cand) > 0 THEN cand ELSE li[1:1] END titulos FROM tt)"""


@query("T5_titles", CLEAN + TITLES + " SELECT doc_id, array_to_string(titulos, ' ¦ ') titulos FROM tu")
def t5(t):
    d = t.archivos.withColumn("c", D.strip_boilerplate("texto"))
    return d.select("doc_id", F.array_join(D.title_candidates("c"), " ¦ ").alias("titulos"))


def _pos(col: str, pattern: str) -> str:
    p = _re(pattern)
    return f"CASE WHEN regexp_matches({col}, '(?i){p}') THEN length(regexp_extract({col}, '(?is)^(.*?)(?:{p})', 1)) + 1 ELSE 0 END"


def _first(col: str) -> str:
    items = ", ".join(f"{{{{'pos': {_pos(f"strip_accents(lower({col}))", rf"\b(?:{p})\b")}, 'tipo': '{k}'}}}}" for k, p in D.CONTENT_WORDS.items())
    return f"list_sort(list_filter([{items}], lambda x: x.pos > 0))[1]"


def _leads(pattern: str) -> str:
    """The phrase comes before the first amendment word, or inside the first title."""
    at = _pos("c", pattern)
    return f"({at} > 0 AND (tb_.pos IS NULL OR {at} < tb_.pos OR {at} < instr(c, titulo) + length(titulo)))"


CONTENT = CLEAN + TITLES + f""", cc AS (SELECT *, coalesce(titulos[1], '') titulo FROM tu),
ce AS (SELECT *, {_first('titulo')}.tipo tt_, {_first('c')} tb_ FROM cc),
cd AS (SELECT * REPLACE (tb_.tipo AS tb_), {_leads(D.SUPPORT_RULES[0][2])} s0, {_leads(D.SUPPORT_RULES[1][2])} s1,
   regexp_matches(strip_accents(lower(c)), '{D.LEGALIZATION}') AND {_leads(D.COVER_LETTER)} s2, regexp_matches(titulo, '(?i)^[^a-zA-Z0-9_]*aclaratori[oa]\b') s3 FROM ce),
ct AS (SELECT doc_id, process_id, nombre, url, c, titulo, CASE WHEN s0 THEN 'Compromiso (soporte)' WHEN s1 THEN 'Poliza (soporte)' WHEN s2 THEN 'Legalizacion (soporte)' WHEN s3 THEN 'Aclaratorio' ELSE coalesce(tt_, tb_) END tipo,
   CASE WHEN s0 OR s1 THEN 0.95 WHEN s2 THEN 0.92 WHEN s3 THEN 0.93 WHEN tt_ IS NOT NULL THEN 0.90 WHEN tb_ IS NOT NULL THEN 0.85 ELSE 0.3 END confianza,
   nullif(regexp_extract(lower(CASE WHEN tt_ IS NOT NULL THEN titulo ELSE c END), 'n[°ºo]\\s*(\\d{{1,5}})', 1), '') num FROM cd)"""


@query("T6_content_types", CONTENT + " SELECT doc_id, tipo, CASE WHEN tipo IS NOT NULL THEN num END numero, CAST(confianza AS DOUBLE) confianza, confianza < 0.8 OR tipo IS NULL revisar FROM ct")
def t6(t):
    return D.classify_content(t.archivos).select("doc_id", "tipo", "numero", F.col("confianza").cast("double").alias("confianza"), "revisar")


# The landed marks come from elsewhere than the content class: the core mark from the name, the review mark from a missing link.
@query("Q14_check_docs", CONTENT + f"""
SELECT count(*) docs, count(*) FILTER (coalesce(({_TYPE}) IN ({', '.join(repr(x) for x in S.CORE_TYPES)}), false) AND tipo IS NULL) nucleo_sin_tipo,
  count(*) FILTER (coalesce(trim(url), '') = '') sin_enlace, count(*) FILTER (confianza < 0.8 AND url IS NOT NULL) confianza_baja FROM ct""")
def q14(t):
    landed = D.classify_content(t.archivos).withColumns({"nucleo": D.is_core(D.name_type("nombre")), "revisar": F.col("url").isNull()})
    return D.check_docs(landed)


@query("T20_best_classification", NAMED + ", " + CONTENT + """
SELECT nm.doc_id, nm.process_id, coalesce(ct.tipo, nm.tipo) tipo, CASE WHEN ct.tipo IS NOT NULL THEN 'contenido' WHEN nm.tipo IS NOT NULL THEN 'nombre' ELSE 'ninguno' END nivel FROM nm JOIN ct USING (doc_id)""")
def t20(t):
    return D.best_classification(D.classify_content(t.archivos), D.classify_names(t.archivos))


_SUBS = "concat_ws('; ', " + ", ".join(f"CASE WHEN regexp_matches(texto, '(?i){_re(p)}') THEN '{k}' END" for k, p in D.SUBTYPE_VERBS.items()) + ")"


@query("T7_subtypes", NAMED + f" SELECT doc_id, CASE WHEN tipo IN ('Modificatorio', 'Otrosi', 'Adenda') THEN {_SUBS} ELSE '' END subtipos FROM nm")
def t7(t):
    return D.classify_names(t.archivos).select("doc_id", F.array_join(D.subtypes("texto", "tipo"), "; ").alias("subtipos"))


_PART = lambda i: f"lower(regexp_extract(texto, '(?is){_re(D.EXTENSION)}', {i}))"
_NUMWORDS = "CASE " + _PART(3) + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.NUMBER_WORDS_ES.items()) + " END"
DAYS_SQL = f"coalesce(try_cast({_PART(1)} AS INT), try_cast({_PART(2)} AS INT), {_NUMWORDS}) * CASE left({_PART(4)}, 1) WHEN 'd' THEN 1 WHEN 's' THEN 7 WHEN 'm' THEN 30 WHEN 'a' THEN 365 END"


@query("T9_extension_days", f"SELECT doc_id, {DAYS_SQL} dias FROM {{archivos}}")
def t9(t):
    return t.archivos.select("doc_id", D.extension_days("texto").alias("dias"))


_MONTHS = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre']"
_LONG = r"(?i)\b(\d{{1,2}})\s+de\s+(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)\s+de\s+(\d{{4}})"


_DATES = f"""list_transform(regexp_extract_all(strip_accents(texto), '{_LONG}'), lambda x: try_cast(regexp_extract(x, '(\\d{{{{4}}}})$', 1) || '-' ||
   lpad(CAST(list_position({_MONTHS}, replace(lower(regexp_extract(x, 'de\\s+([A-Za-z]+)', 1)), 'setiembre', 'septiembre')) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(x, '^(\\d+)', 1), 2, '0') AS DATE))"""
_LAST = "list_filter(l, lambda x: x IS NOT NULL AND year(x) BETWEEN 1990 AND 2030)[-1]"


@query("T10_document_date", f"d AS (SELECT doc_id, {_DATES} l FROM {{archivos}}) SELECT doc_id, {_LAST} fecha FROM d")
def t10(t):
    return t.archivos.select("doc_id", last_long_date("texto").alias("fecha"))


def _pesos(x: str) -> str:
    n = f"try_cast(regexp_replace({x}, '\\D', '', 'g') AS BIGINT)"
    return f"CASE WHEN {n} BETWEEN {D.LEAST} AND {D.MOST} THEN {n} END"


def _monthly(x: str) -> str:
    return f"regexp_matches({x}, '(?i){_re(D.MONTHLY)}')"


_VERB = _re(D.SUBTYPE_VERBS["Adicion"])
_PHRASE = f"(?i){_re(D.PHRASE)}"
_AT = f"length(string_split_regex(texto, '{_PHRASE}')[1])"
_AFTER = f"substr(texto, 1 + {_AT} + length(regexp_extract(texto, '{_PHRASE}')), {D.AROUND_PHRASE})"
#: Steps from ``src`` (doc_id, texto, wanted) to ``am`` (doc_id, valor, aviso).
AMOUNTS = f"""a0 AS (SELECT doc_id, texto, {_pesos(f"regexp_extract(texto, '(?is){_re(D.ADD_CLAUSE)}', 1)")} directo,
   string_split(regexp_replace(texto, '(?i)({_VERB})', chr(1) || '\\1', 'g'), chr(1)) pz FROM src WHERE wanted),
a1 AS (SELECT doc_id, directo, texto, list_transform(range(2, len(pz) + 1), lambda i: right(pz[i - 1], {D.BEFORE}) || left(pz[i], {D.AFTER})) w FROM a0),
a2 AS (SELECT doc_id, i, unnest(list_zip(regexp_extract_all(v, '{_re(D.PESOS)}', 1), range(1, 1 + len(regexp_extract_all(v, '{_re(D.PESOS)}', 1))))) z, string_split_regex(v, '{_re(D.PESOS)}') sp
   FROM (SELECT doc_id, unnest(w) v, generate_subscripts(w, 1) i FROM a1)),
a3 AS (SELECT doc_id, i, z[2] k, {_pesos('z[1]')} n, {_monthly(f'right(sp[z[2]], {D.AROUND})')} OR {_monthly(f'left(sp[z[2] + 1], {D.AROUND})')} mensual FROM a2),
a4 AS (SELECT doc_id, arg_min(n, i * 10000 + k) FILTER (NOT mensual) n1, arg_min(n, i * 10000 + k) n2 FROM a3 WHERE n IS NOT NULL GROUP BY 1),
a5 AS (SELECT a1.doc_id, directo, n1, n2, {_pesos(f"regexp_extract(texto, '{_PHRASE}', 1)")} n3, {_monthly(f"right(string_split_regex(texto, '{_PHRASE}')[1], {D.AROUND_PHRASE})")} OR {_monthly(_AFTER)} m3
   FROM a1 LEFT JOIN a4 USING (doc_id)),
am AS (SELECT doc_id, coalesce(directo, n1, n2, CASE WHEN NOT m3 THEN n3 END) valor,
   CASE WHEN directo IS NOT NULL OR n1 IS NOT NULL THEN NULL WHEN n2 IS NOT NULL THEN '{D.NOTE_MONTHLY}' WHEN n3 IS NULL THEN '{D.NOTE_NO_AMOUNT}' WHEN m3 THEN '{D.NOTE_MONTHLY_NONE}' ELSE '{D.NOTE_PHRASE}' END aviso FROM a5)"""


@query("T8_added_amount", "src AS (SELECT doc_id, texto, true wanted FROM {archivos}), " + AMOUNTS + " SELECT doc_id, valor, aviso FROM am")
def t8(t):
    return t.archivos.select("doc_id", D.added_amount("texto").alias("a")).select("doc_id", "a.valor", "a.aviso")


#: ``dt``: one row per document with its class, subtypes, amount, days, date and warnings.
DETAILED = CONTENT + f""", td AS (SELECT a.doc_id, a.texto, length(trim(a.texto)) >= 50 largo, ct.process_id, ct.tipo, ct.confianza FROM {{archivos}} a JOIN ct USING (doc_id)),
ts AS (SELECT *, CASE WHEN largo AND tipo IN ('Modificatorio', 'Otrosi', 'Adenda') THEN {_SUBS} ELSE '' END subtipos FROM td),
src AS (SELECT doc_id, texto, contains(subtipos, 'Adicion') wanted FROM ts), {AMOUNTS},
tf AS (SELECT doc_id, {_DATES} l FROM ts),
tg AS (SELECT ts.*, am.valor valor_adicionado, am.aviso, CASE WHEN contains(subtipos, 'Prorroga') THEN {DAYS_SQL} END dias_prorrogados, CASE WHEN largo THEN {_LAST} END fecha_documento FROM ts LEFT JOIN am USING (doc_id) JOIN tf USING (doc_id)),
dt AS (SELECT *, confianza < 0.8 OR tipo IS NULL revisar, CASE WHEN NOT largo OR texto IS NULL THEN '{D.NOTE_SHORT}' ELSE nullif(concat_ws('; ', aviso,
   CASE WHEN contains(subtipos, 'Prorroga') AND dias_prorrogados IS NULL THEN '{D.NOTE_NO_TERM}' END, CASE WHEN fecha_documento IS NULL THEN '{D.NOTE_NO_DATE}' END), '') END avisos FROM tg)"""


def _detailed(t):
    return D.amendment_details(D.classify_content(t.archivos))


@query("T11_amendment_details", DETAILED + " SELECT doc_id, tipo, subtipos, valor_adicionado, dias_prorrogados, fecha_documento, avisos FROM dt")
def t11(t):
    return _detailed(t).select("doc_id", "tipo", F.array_join("subtipos", "; ").alias("subtipos"), "valor_adicionado", "dias_prorrogados", "fecha_documento", "avisos")


_CORE = f"tipo IN ({', '.join(repr(x) for x in S.CORE_TYPES)})"
_SUPPORT = f"tipo IN ({', '.join(repr(x) for x in S.SUPPORT_TYPES)})"


@query("A24_amendment_rollup", DETAILED + f"""
SELECT process_id, count(*) FILTER ({_CORE}) modificatorios, CAST(nullif(sum(valor_adicionado) FILTER ({_CORE}), 0) AS BIGINT) valor_adicionado, CAST(nullif(sum(dias_prorrogados) FILTER ({_CORE}), 0) AS BIGINT) dias_prorrogados FROM dt GROUP BY 1""")
def a24(t):
    return D.amendment_rollup(_detailed(t))


@query("A25_amendment_totals", DETAILED + f""",
p AS (SELECT process_id, count(*) FILTER ({_CORE}) a, count(*) FILTER ({_SUPPORT}) s FROM dt GROUP BY 1), n AS (SELECT count(*) FILTER ({_CORE}) actos, {', '.join(f"count(*) FILTER (tipo = '{x}') total_{x.lower()}" for x in ('Modificatorio', 'Adicion', 'Prorroga', 'Cesion', 'Liquidacion'))},
   CAST(coalesce(sum(valor_adicionado) FILTER ({_CORE}), 0) AS BIGINT) v, CAST(coalesce(sum(dias_prorrogados) FILTER ({_CORE}), 0) AS BIGINT) d, count(*) FILTER (revisar) r, count(*) FILTER (avisos IS NOT NULL) w FROM dt)
SELECT (SELECT count(*) FROM p WHERE a > 0) procesos_con_modificatorios, (SELECT count(*) FROM p WHERE a = 0 AND s = 0) procesos_por_revisar, actos total_actos, total_modificatorio, total_adicion, total_prorroga, total_cesion, total_liquidacion,
  actos - total_modificatorio - total_adicion - total_prorroga - total_cesion - total_liquidacion total_otros, v valor_global, d dias_global, r docs_por_revisar, w docs_con_avisos FROM n""")
def a25(t):
    return D.amendment_totals(_detailed(t))


# ---- Notes ------------------------------------------------------------------

_FOLD = "upper(strip_accents(text))"
_HITS = "concat_ws('; ', " + ", ".join(f"CASE WHEN regexp_matches({_FOLD}, '\\b{s}') THEN '{s}' END" for s in sorted(D.NOTE_STEMS)) + ")"


@query("T13_parse_notes", f"""
SELECT conv_id, turn, CASE WHEN {_HITS} <> '' THEN 'Sí' ELSE 'No' END modificatorio, CASE WHEN regexp_matches(text, '(?i)\\bNO\\s*LEG\\b') THEN 'Sí' ELSE 'No' END no_leg, {_HITS} menciones FROM {{notas}}""")
def t13(t):
    return D.parse_notes(t.notas).select("conv_id", "turn", "modificatorio", "no_leg", "menciones")


@query("T14_note_flags", """
SELECT conv_id, turn, regexp_matches(upper(text), 'MODIFIC|PRORROG|PRÓRROG|ADICION|ADICIÓN|MOD |MOD\\n') dice_modificado,
  CASE WHEN length(trim(text)) > 120 THEN left(trim(text), 120) || '…' ELSE trim(text) END resumen FROM {notas}""")
def t14(t):
    return D.note_flags(t.notas).select("conv_id", "turn", "dice_modificado", "resumen")


def _words_sql(words):
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN contains(upper(strip_accents(texto)), '{w}') THEN '{w}' END" for w in sorted(words)) + ")"


@query("T15_document_summary", f"""
SELECT doc_id, length(texto) n_chars, {_words_sql(D.BODY_AMENDMENT)} palabras_modif, {_words_sql(D.BODY_LEGAL)} palabras_leg, length(texto) < 40 * (1 + doc_id % 9) escaneado, trim(left(texto, 800)) vista FROM {{archivos}}""")
def t15(t):
    return D.document_summary(t.archivos.withColumn("n_pages", 1 + F.col("doc_id") % 9))


# ---- Pages ------------------------------------------------------------------


@query("T16_page_fields", """
SELECT page_id, 'Titulo' etiqueta, titulo valor FROM {paginas} WHERE cerrada UNION ALL SELECT page_id, 'Numero del proceso', 'NP-' || page_id FROM {paginas} WHERE cerrada
UNION ALL SELECT page_id, 'Fase', fase FROM {paginas} WHERE cerrada
UNION ALL SELECT page_id, 'Valor total', CASE WHEN con_valor THEN '$ ' || page_id || '.000.000' ELSE '' END FROM {paginas} WHERE cerrada""")
def t16(t):
    return P.page_fields(P.parse_pages(portal_pages(t), "page_id", "html"), "page_id")


@query("T17_page_documents", """
SELECT page_id, 'Pliego_' || page_id || '.pdf' name, 'https://portal.example.org/Public/Tendering/Notice/DownloadFile?documentFileId=' || page_id url FROM {paginas} WHERE cerrada
UNION ALL SELECT page_id, 'Anexo.pdf', 'https://portal.example.org/Public/Tendering/Annex/DownloadFile?documentFileId=8' || page_id || '&mkey=' || CASE WHEN con_valor THEN 'bc' ELSE 'ab' END || '_1'
FROM {paginas} WHERE cerrada AND lang NOT IN ('es', 'fr')""")
def t17(t):
    return P.page_documents(P.parse_pages(portal_pages(t), "page_id", "html"), "page_id")


@query("T18_page_notices", """
SELECT page_id, 'NP-' || page_id proceso, CASE WHEN con_valor THEN 'Adenda publicada' ELSE 'Cierre' END evento, CASE WHEN con_valor THEN '22/07/2024 03:15 PM' ELSE '23/07/2024 09:00 AM' END fecha FROM {paginas} WHERE cerrada
UNION ALL SELECT page_id, 'NP-0', 'Apertura', '' FROM {paginas} WHERE cerrada AND lang = 'de'""")
def t18(t):
    return P.page_notices(P.parse_pages(portal_pages(t), "page_id", "html"), "page_id")
