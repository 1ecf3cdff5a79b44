"""Queries of change detection, merges, chains and streams (U*, H*, W8, A13, A22, R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapunto.operators import changes as C
from contrapunto.operators import integrity as IN
from contrapunto.operators.edits import apply_edits
from contrapunto.plans.analogs import NEW_STAMP, OLD_STAMP
from contrapunto.plans.registry import query
from contrapunto.sources.sinks import save_snapshot
from contrapunto.streaming import streams as ST

FIELDS = ["estado", "valor", "modificatorios", "adjudicado", "pagado"]


@query("U1_added", "SELECT id_contrato FROM {foto_nueva} EXCEPT SELECT id_contrato FROM {foto_vieja}")
def u1(t):
    return C.added(t.foto_nueva, t.foto_vieja, "id_contrato")


@query("U2_removed", "SELECT id_contrato FROM {foto_vieja} EXCEPT SELECT id_contrato FROM {foto_nueva}")
def u2(t):
    return C.removed(t.foto_nueva, t.foto_vieja, "id_contrato")


@query("U3_common", "SELECT id_contrato FROM {foto_vieja} INTERSECT SELECT id_contrato FROM {foto_nueva}")
def u3(t):
    return C.common(t.foto_nueva, t.foto_vieja, "id_contrato")


_N = "CASE WHEN lower(trim(coalesce({0}, ''))) = 'nan' THEN '' ELSE trim(coalesce({0}, '')) END"
_DIFF = """
d AS (SELECT coalesce(o.id_contrato, n.id_contrato) id_contrato, o.id_contrato oi, n.id_contrato ni, """ + ", ".join(
    f"{_N.format('o.' + f)} o_{f}, {_N.format('n.' + f)} n_{f}" for f in FIELDS) + """ FROM {foto_vieja} o FULL JOIN {foto_nueva} n ON o.id_contrato = n.id_contrato),
x AS (SELECT id_contrato, 'nuevo' tipo, NULL campo, NULL antes, NULL despues FROM d WHERE oi IS NULL UNION ALL SELECT id_contrato, 'eliminado', NULL, NULL, NULL FROM d WHERE ni IS NULL """ + " ".join(
    f"UNION ALL SELECT id_contrato, 'cambio', '{f}', o_{f}, n_{f} FROM d WHERE oi IS NOT NULL AND ni IS NOT NULL AND o_{f} <> n_{f}" for f in FIELDS) + ")"


@query("H1_snapshot_diff", _DIFF + " SELECT * FROM x")
def h1(t):
    return C.diff(t.foto_vieja, t.foto_nueva, "id_contrato", FIELDS)


@query("H3_change_summary", _DIFF + """
SELECT CASE WHEN tipo <> 'cambio' THEN tipo WHEN campo = 'estado' THEN 'estado' WHEN campo = 'modificatorios' THEN 'modificatorios' ELSE 'valor' END grupo, count(*) n
FROM x WHERE coalesce(campo, '') <> 'adjudicado' GROUP BY 1""")
def h3(t):
    buckets = {"estado": "estado", "modificatorios": "modificatorios", "valor": "valor", "pagado": "valor"}
    return C.summarize_changes(C.diff(t.foto_vieja, t.foto_nueva, "id_contrato", FIELDS), buckets)


_MOVES = _DIFF + """, mv AS (SELECT 'nuevo' tipo, id_contrato id, NULL antes, NULL despues FROM d WHERE oi IS NULL UNION ALL SELECT 'desaparecido', id_contrato, NULL, NULL FROM d WHERE ni IS NULL
UNION ALL SELECT 'cambio_estado', id_contrato, o_estado, n_estado FROM d WHERE oi IS NOT NULL AND ni IS NOT NULL AND o_estado <> n_estado AND o_estado <> '' AND n_estado <> ''
UNION ALL SELECT 'adjudicado', id_contrato, o_adjudicado, n_adjudicado FROM d WHERE o_adjudicado = 'No' AND n_adjudicado = 'Si')"""


@query("H2_movements", _MOVES + " SELECT * FROM mv")
def h2(t):
    return C.movements(t.foto_nueva, t.foto_vieja, "id_contrato", {"cambio_estado": "estado"}, "adjudicado")


# ---- Fingerprints (H4, H7) --------------------------------------------------

_PJ = "json_object('adjudicado', adjudicado, 'entidad', entidad, 'fase', fase, 'nombre', nombre, 'precio_base', CAST(precio_base AS VARCHAR))"
_CJ = "json_object('estado', estado, 'fecha_liquidacion', CAST(fecha_liquidacion AS VARCHAR), 'id_contrato', id_contrato, 'proveedor', proveedor, 'valor', CAST(valor AS VARCHAR))"
_P_COLS = ["fase", "entidad", "nombre", "adjudicado", "precio_base"]
_C_COLS = ["id_contrato", "estado", "valor", "proveedor", "fecha_liquidacion"]


def _print_sql(name: str, contracts: str, where: str = "") -> str:
    lanes = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) l{i}" for i in range(4))
    text = "|| '|' || ".join(f"coalesce(CAST(l{i} AS VARCHAR), '0')" for i in range(4))
    return f"""
{name}_h AS (SELECT process_id, sha256(CAST({_CJ} AS VARCHAR)) h FROM {contracts}), {name}_s AS (SELECT process_id, count(*) n, {lanes} FROM {name}_h GROUP BY 1),
{name} AS (SELECT process_id, sha256(CAST({_PJ} AS VARCHAR) || '|' || CAST(coalesce(n, 0) AS VARCHAR) || '|' || {text}) huella FROM {{procesos}} LEFT JOIN {name}_s USING (process_id))"""


@query("H4_fingerprint", _print_sql("f", "{contratos}") + " SELECT * FROM f")
def h4(t):
    return IN.fingerprint(t.procesos, t.contratos, _P_COLS, _C_COLS)


_OLD_CONTRACTS = f"(SELECT * FROM {{contratos}} WHERE fecha_firma < DATE '{NEW_STAMP}') z"


@query("H7_stale_check", _print_sql("f", "{contratos}") + ", " + _print_sql("g", _OLD_CONTRACTS) + """,
s AS (SELECT process_id, CASE WHEN fase = 'HOUSEHOLD' THEN '' ELSE huella END guardada FROM g JOIN {procesos} USING (process_id) UNION ALL SELECT url, 'x' FROM {watch} WHERE process_id IS NULL)
SELECT process_id, CASE WHEN f.huella IS NULL THEN 'error' WHEN guardada = '' THEN 'no_baseline' WHEN guardada <> f.huella THEN 'stale' ELSE 'fresh' END estado FROM s LEFT JOIN f USING (process_id)""")
def h7(t):
    current = IN.fingerprint(t.procesos, t.contratos, _P_COLS, _C_COLS)
    old = IN.fingerprint(t.procesos, t.contratos.where(F.col("fecha_firma") < F.lit(NEW_STAMP).cast("date")), _P_COLS, _C_COLS)
    old = old.join(t.procesos.select("process_id", "fase"), "process_id").select("process_id", F.when(F.col("fase") == "HOUSEHOLD", "").otherwise(F.col("huella")).alias("huella"))
    lost = t.watch.where("process_id is null").select(F.col("url").alias("process_id"), F.lit("x").alias("huella"))
    return IN.verify_rows(old.unionByName(lost), current).select("process_id", "estado")


# ---- Chains (H5, H6, W8, A22) -----------------------------------------------

_E_COLS = ["pos", "op", "nuevo", "props"]
_EJ = "CAST(json_object('nuevo', nuevo, 'op', op, 'pos', CAST(pos AS VARCHAR), 'props', props) AS VARCHAR)"
_CHAIN = """
RECURSIVE_e AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY pos) cpos, """ + _EJ + """ payload FROM {bitacora}),
ch AS (SELECT chain_id, cpos, pos, op, ts, repeat('0', 64) prev_hash, sha256(payload || repeat('0', 64)) hash FROM RECURSIVE_e WHERE cpos = 1
  UNION ALL SELECT e.chain_id, e.cpos, e.pos, e.op, e.ts, ch.hash, sha256(e.payload || ch.hash) FROM RECURSIVE_e e JOIN ch ON e.chain_id = ch.chain_id AND e.cpos = ch.cpos + 1)"""


def chained(t, segment=IN.SEGMENT):
    return IN.build_chain(t.bitacora, "chain_id", "pos", _E_COLS, segment=segment)


@query("H6_build_chain", _CHAIN + " SELECT chain_id, cpos, pos, prev_hash, hash FROM ch")
def h6(t):
    return chained(t).select("chain_id", "cpos", "pos", "prev_hash", "hash")


@query("H6_chain_roots", _CHAIN + """
SELECT chain_id, sha256(sha256(arg_max(hash, cpos))) raiz, count(*) entradas FROM ch GROUP BY 1""")
def h6_roots(t):
    return IN.chain_roots(chained(t), "chain_id")


#: The same chains in segments of three, and the heads of the segments.
_SHORT = """
RECURSIVE_e AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY pos) cpos, """ + _EJ + """ payload FROM {bitacora}),
g AS (SELECT *, (cpos - 1) // 3 segmento, CASE WHEN cpos <= 3 THEN repeat('0', 64) ELSE sha256(chain_id || ':' || ((cpos - 1) // 3)) END inicio FROM RECURSIVE_e),
ch AS (SELECT chain_id, cpos, segmento, inicio prev_hash, sha256(payload || inicio) hash FROM g WHERE (cpos - 1) % 3 = 0
  UNION ALL SELECT g.chain_id, g.cpos, g.segmento, ch.hash, sha256(g.payload || ch.hash) FROM g JOIN ch ON g.chain_id = ch.chain_id AND g.cpos = ch.cpos + 1 WHERE (g.cpos - 1) % 3 <> 0),
heads AS (SELECT chain_id, segmento, arg_max(hash, cpos) hash, count(*) n FROM ch GROUP BY 1, 2)"""
_TREE = _SHORT + """,
tr AS (SELECT chain_id, 0 nivel, CAST(segmento AS BIGINT) orden, hash h FROM heads
  UNION ALL SELECT chain_id, nivel + 1, orden // 2, sha256(string_agg(h, '' ORDER BY orden)) FROM (SELECT *, count(*) OVER (PARTITION BY chain_id) ancho FROM tr) WHERE ancho > 1 OR nivel < 2 GROUP BY 1, 2, 3)"""


@query("H6_segments", _SHORT + " SELECT chain_id, cpos, segmento, prev_hash, hash FROM ch")
def h6_segments(t):
    return chained(t, 3).select("chain_id", "cpos", "segmento", "prev_hash", "hash")


@query("H6_merkle_roots", _TREE + """
SELECT chain_id, arg_max(h, nivel) raiz, (SELECT sum(n) FROM heads WHERE heads.chain_id = tr.chain_id)::BIGINT entradas FROM tr GROUP BY 1""")
def h6_merkle(t):
    return IN.chain_roots(chained(t, 3), "chain_id", 2)


@query("H6_inclusion_proofs", _TREE + """
SELECT chain_id, segmento, (SELECT max(nivel) FROM tr WHERE tr.chain_id = h.chain_id) niveles, segmento <> 1 valida FROM heads h""")
def h6_proofs(t):
    log = chained(t, 3)
    tree = IN.merkle_tree(log, "chain_id", 2)
    heads = log.groupBy("chain_id", "segmento").agg(F.max_by("hash", "cpos").alias("hash"))
    heads = heads.withColumn("hash", F.when(F.col("segmento") == 1, F.sha2("hash", 256)).otherwise(F.col("hash")))  # the second ones are forged
    return IN.check_proofs(IN.inclusion_proofs(heads, tree, "chain_id", 2), heads, IN.chain_roots(log, "chain_id", 2, tree), "chain_id")


@query("H5_lost_entries", """
e AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY pos) cpos FROM {bitacora}),
c AS (SELECT chain_id, count(*) n, arg_min(op, cpos) primera FROM e GROUP BY 1)
SELECT chain_id, 4 cpos, true hash_ok, false enlace_ok FROM c WHERE primera IN ('fill', 'replace') AND n > 3
UNION ALL SELECT chain_id, n, true, false FROM c WHERE primera = 'consulta'""")
def h5_lost(t):
    """Segments of three: the second is lost in some chains, the last entry in others."""
    log = chained(t, 3)
    chains = t.bitacora.groupBy("chain_id").agg(F.min_by("op", "pos").alias("primera"), F.count("*").alias("n"))
    d = log.join(chains.hint("shuffle_hash"), "chain_id")
    kept = d.where("not (primera in ('fill', 'replace') and segmento = 1) and not (primera = 'consulta' and cpos = n)").drop("primera", "n")
    return IN.verify_chain(kept, "chain_id", _E_COLS, IN.chain_roots(log, "chain_id"), 3)


def _tampered(t, segment=IN.SEGMENT):
    """The chained log with errors above 90 rewritten and one operation's links lost."""
    edited = (F.col("op") == "verify_drift") & (F.col("nuevo").cast("double") > 90)
    cut = (F.col("op") == "fill") & (F.col("nuevo").cast("double") > 90)
    return chained(t, segment).withColumns({"nuevo": F.when(edited, "0.00").otherwise(F.col("nuevo")), "prev_hash": F.when(cut, F.repeat(F.lit("f"), F.lit(64))).otherwise(F.col("prev_hash"))})


@query("H5_W8_verify_chain", """
SELECT chain_id, cpos, false hash_ok, op <> 'fill' enlace_ok FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY pos) cpos FROM {bitacora})
WHERE op IN ('fill', 'verify_drift') AND CAST(nuevo AS DOUBLE) > 90""")
def h5(t):
    return IN.verify_chain(_tampered(t), "chain_id", _E_COLS)


@query("A22_log_summary", """
SELECT op, count(*) n, min(ts) desde, max(ts) hasta, (SELECT count(*) FROM {bitacora} WHERE op IN ('fill', 'verify_drift') AND CAST(nuevo AS DOUBLE) > 90) = 0 integra FROM {bitacora} GROUP BY 1""")
def a22(t):
    log = _tampered(t)
    return IN.log_summary(log, IN.verify_chain(log, "chain_id", _E_COLS)).select("op", "n", "desde", "hasta", "integra")


# ---- Ledger import (H9, A13) ------------------------------------------------

_IMPORT = """
r AS (SELECT *, nullif(regexp_extract(url, 'CO1\\.[A-Z]+\\.[0-9A-Za-z]+'), '') pid, coalesce(vigencia, CAST(sheet_ord AS VARCHAR)) vig FROM {ledger} WHERE contains(lower(url), 'portal.example.org')),
wi AS (SELECT process_id, min(seq) i FROM {watch} WHERE process_id IS NOT NULL GROUP BY 1), wu AS (SELECT url, min(seq) i FROM {watch} GROUP BY 1),
m AS (SELECT r.*, coalesce(CAST(wi.i AS VARCHAR), CAST(wu.i AS VARCHAR), pid, r.url) item, coalesce(wi.i, wu.i) IS NOT NULL conocido FROM r LEFT JOIN wi ON r.pid = wi.process_id LEFT JOIN wu ON r.url = wu.url),
im AS (SELECT item, pid, sheet, sheet_ord, row_no, url, vig vigencia,
   CASE WHEN row_no <= 99999 AND (numero LIKE 'contrato%' OR row_no >= 1) THEN 'CONTRATO-ENT-' || lpad(CAST(row_no AS VARCHAR), CAST(greatest(4, length(CAST(row_no AS VARCHAR))) AS INT), '0') || '-' || CASE WHEN numero LIKE 'contrato%' THEN CAST(sheet_ord AS VARCHAR) ELSE vig END END consecutivo,
   CASE WHEN conocido AND sheet = 'Hoja 1995' THEN 'ya_registrada' WHEN NOT conocido AND row_number() OVER (PARTITION BY item ORDER BY sheet_ord, row_no) = 1 THEN 'nueva' ELSE 'fusionada' END resultado FROM m)"""


def imported(t):
    w = t.watch.withColumn("item", F.col("seq").cast("string"))
    known = w.select("item", "process_id", "url")
    rec = t.ledger.where("sheet = 'Hoja 1995'")
    by_id = rec.join(known.where("process_id is not null").select("item", F.col("process_id").alias("k")), F.concat(F.lit("CO1.NTC."), "custkey") == F.col("k"))
    by_url = rec.join(known.select("item", F.col("url").alias("k")), F.col("url") == F.col("k"))
    recorded = by_id.select("item", "sheet", "row_no", "url").unionByName(by_url.select("item", "sheet", "row_no", "url"))
    return C.import_ledger(t.ledger, known, recorded, "portal.example.org")


@query("H9_import_ledger", _IMPORT + " SELECT item, pid, sheet, row_no, url, vigencia, consecutivo, resultado FROM im")
def h9(t):
    return imported(t).select("item", "pid", "sheet", "row_no", "url", "vigencia", "consecutivo", "resultado")


@query("H9_import_items", _IMPORT + """
SELECT item, arg_min(pid, (sheet_ord, row_no)) pid, arg_min(url, (sheet_ord, row_no)) url, arg_min(sheet, (sheet_ord, row_no)) primera_hoja, count(*) apariciones FROM im GROUP BY 1""")
def h9_items(t):
    return C.import_items(imported(t))


@query("H9_import_lists", _IMPORT + """, u AS (SELECT item, 'hojas' campo, sheet v, (sheet_ord, row_no) o FROM im UNION ALL SELECT item, 'vigencias', vigencia, (sheet_ord, row_no) FROM im UNION ALL SELECT item, 'consecutivos', consecutivo, (sheet_ord, row_no) FROM im),
g AS (SELECT item, campo, v, min(o) o FROM u WHERE v IS NOT NULL GROUP BY 1, 2, 3) SELECT item, campo, string_agg(v, ' | ' ORDER BY o, v) texto, 0 part FROM g GROUP BY 1, 2""")
def h9_lists(t):
    return C.import_lists(imported(t))


@query("A13_import_report", _IMPORT + """
SELECT sheet, count(*) encontradas, count(*) FILTER (resultado = 'nueva') nuevas, count(*) FILTER (resultado = 'fusionada') fusionadas, count(*) FILTER (resultado = 'ya_registrada') ya_registradas,
  count(*) FILTER (consecutivo IS NOT NULL) con_consecutivo FROM im GROUP BY 1""")
def a13(t):
    return C.import_report(imported(t))


# ---- Merges (H10, H11, H15), edits (H12, H14), drift (H13) ------------------


def _seed(t):
    return t.watch.where("vigencia <> '1995'").select("url", "process_id", F.concat(F.lit("Semilla "), "note").alias("note"), "sheet", F.lit(None).cast("date").alias("edited_at"))


def _local(t):
    return t.watch.where("vigencia <> '2001'").select("url", "process_id", "note", F.when(F.col("vigencia") != "1998", F.col("sheet")).alias("sheet"), "edited_at")


_SEED = """
s AS (SELECT url, process_id, 'Semilla ' || note note, sheet FROM {watch} WHERE vigencia <> '1995'),
l AS (SELECT url, process_id, note, CASE WHEN vigencia <> '1998' THEN sheet END sheet, edited_at FROM {watch} WHERE vigencia <> '2001')"""


@query("H10_merge_seed", _SEED + """
SELECT coalesce(s.url, l.url) url, coalesce(s.process_id, l.process_id) process_id, CASE WHEN s.url IS NULL THEN l.note WHEN l.edited_at IS NOT NULL THEN coalesce(l.note, s.note) ELSE s.note END note,
  CASE WHEN s.url IS NULL THEN l.sheet WHEN l.edited_at IS NOT NULL THEN coalesce(l.sheet, s.sheet) ELSE s.sheet END sheet, CASE WHEN s.url IS NULL OR l.edited_at IS NOT NULL THEN l.edited_at END edited_at,
  CASE WHEN s.url IS NULL THEN 'manual' WHEN l.edited_at IS NOT NULL THEN 'editado' ELSE 'semilla' END origen FROM s FULL JOIN l ON s.url = l.url""")
def h10(t):
    return C.merge_seed(_seed(t), _local(t), ["note", "sheet"])


@query("H11_merge_lww", """
l AS (SELECT url, note, edited_at FROM {watch} WHERE vigencia <> '2001'),
r AS (SELECT url, 'Remota ' || note note, CASE WHEN vigencia < '1998' THEN CAST(edited_at + INTERVAL 1 DAY AS DATE) WHEN vigencia = '1999' THEN NULL ELSE edited_at END edited_at FROM {watch} WHERE vigencia <> '1995')
SELECT coalesce(l.url, r.url) url, CASE WHEN l.url IS NULL OR (r.edited_at IS NOT NULL AND r.edited_at > coalesce(l.edited_at, DATE '0001-01-01')) THEN r.note ELSE l.note END note,
  CASE WHEN l.url IS NULL OR (r.edited_at IS NOT NULL AND r.edited_at > coalesce(l.edited_at, DATE '0001-01-01')) THEN 'remota' ELSE 'local' END replica FROM l FULL JOIN r ON l.url = r.url""")
def h11(t):
    d = t.watch.select("url", "note", "edited_at", "vigencia")
    local = d.where("vigencia <> '2001'").drop("vigencia")
    stamp = F.when(F.col("vigencia") < "1998", F.date_add("edited_at", 1)).when(F.col("vigencia") != "1999", F.col("edited_at"))
    remote = d.where("vigencia <> '1995'").select("url", F.concat(F.lit("Remota "), "note").alias("note"), stamp.alias("edited_at"))
    return C.merge_lww(local, remote, "url", "edited_at").select("url", "note", "replica")


@query("H15_upsert_docs", """
SELECT process_id, doc_id, CASE WHEN dataset <> 'archivo_2022' THEN 'nuevo ' || nombre ELSE nombre END nombre FROM {archivos}""")
def h15(t):
    old = t.archivos.where("dataset <> 'archivo_2025'").select("process_id", "doc_id", "nombre", "fecha")
    new = t.archivos.where("dataset <> 'archivo_2022'").select("process_id", "doc_id", F.concat(F.lit("nuevo "), "nombre").alias("nombre"), "fecha")
    return C.upsert_docs(old, new, ["process_id", "doc_id"], "fecha").select("process_id", "doc_id", "nombre")


@query("H13_count_drift", """
SELECT a guardadas, b vivas, CAST(round_even(abs(a - b) * 100.0 / b, 1) AS DOUBLE) desvio_pct, abs(a - b) * 100 > 5 * b alerta FROM (SELECT (SELECT count(*) FROM {integrado}) a, (SELECT count(*) FROM orders) b)""")
def h13(t):
    return C.count_drift(t.integrado, t.orders).withColumn("desvio_pct", F.col("desvio_pct").cast("double"))


def _edits(t):
    """One edit per supplier row against the watch list built from the same rows."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    url = lambda i: F.concat(F.lit("https://portal.example.org/x?noticeUID=CO1.NTC."), i)
    op = F.when(n < 8, "edit").when(n < 12, "remove").otherwise("add")
    target = F.when(n >= 20, F.concat(F.lit("https://otro.example.net/"), k)).when(n >= 16, url(k)).when(n >= 12, url(k + 1000000)).otherwise(url(k))
    new_url = F.when(n < 3, url(k + 2000000))
    note = F.when((n >= 3) & (n < 6), F.concat(F.lit("nota "), k)).when(n >= 12, "alta")
    return t.supplier.select(k.alias("ord"), op.alias("op"), target.alias("url"), new_url.alias("new_url"), note.alias("note"), F.lit(None).cast("string").alias("sheet"))


def _watch_of_suppliers(t):
    return t.supplier.where("s_nationkey <> 9").select(
        F.concat(F.lit("https://portal.example.org/x?noticeUID=CO1.NTC."), "s_suppkey").alias("url"), F.concat(F.lit("CO1.NTC."), "s_suppkey").alias("process_id"), F.lit("previa").alias("note"), F.lit("Hoja 2000").alias("sheet"))


@query("H12_edit_log", """
SELECT s_suppkey ord, CASE WHEN s_nationkey < 8 THEN 'edit' WHEN s_nationkey < 12 THEN 'remove' ELSE 'add' END op,
  CASE WHEN s_nationkey = 9 THEN 'no_encontrado' WHEN s_nationkey < 6 THEN 'aplicado' WHEN s_nationkey < 8 THEN 'sin_cambio' WHEN s_nationkey < 16 THEN 'aplicado' WHEN s_nationkey < 20 THEN 'duplicado' ELSE 'dominio_invalido' END estado FROM supplier""")
def h12(t):
    return apply_edits(_watch_of_suppliers(t), _edits(t), "portal.example.org")[1].select("ord", "op", "estado")


@query("H12_edited_watch", """
SELECT 'https://portal.example.org/x?noticeUID=CO1.NTC.' || CASE WHEN s_nationkey < 3 THEN s_suppkey + 2000000 ELSE s_suppkey END url, 'CO1.NTC.' || CASE WHEN s_nationkey < 3 THEN s_suppkey + 2000000 ELSE s_suppkey END process_id,
  CASE WHEN s_nationkey BETWEEN 3 AND 5 THEN 'nota ' || s_suppkey ELSE 'previa' END note, 'Hoja 2000' sheet FROM supplier WHERE s_nationkey NOT BETWEEN 8 AND 11
UNION ALL SELECT 'https://portal.example.org/x?noticeUID=CO1.NTC.' || (s_suppkey + 1000000), 'CO1.NTC.' || (s_suppkey + 1000000), 'alta', NULL FROM supplier WHERE s_nationkey BETWEEN 12 AND 15""")
def h12_watch(t):
    return apply_edits(_watch_of_suppliers(t), _edits(t), "portal.example.org")[0].select("url", "process_id", "note", "sheet")


def _edits_in_order(t):
    """Three edits per supplier that build on each other, against the list of the same rows (without nation 9)."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    url = lambda i: F.concat(F.lit("https://portal.example.org/x?noticeUID=CO1.NTC."), i)
    other = F.when(n % 2 == 0, url(k + 1000000)).otherwise(url(k + 2000000))
    row = lambda i, op, link, new=None, note=None, sheet=None: F.struct((3 * k + i).alias("ord"), F.lit(op).alias("op"), link.alias("url"), *[(F.lit(None).cast("string") if v is None else v).alias(c) for c, v in (("new_url", new), ("note", note), ("sheet", sheet))])
    move = F.array(row(0, "edit", url(k), other), row(1, "edit", other, None, F.concat(F.lit("nota "), k)), row(2, "add", other, None, None, F.concat(F.lit("Hoja "), 2001 + n)))
    swap = F.array(row(0, "remove", url(k)), row(1, "add", url(k), None, F.lit("otra"), F.lit("Hoja 1999")), row(2, "edit", url(k), url(k)))
    clash = F.array(row(0, "add", other, None, F.lit("nueva")), row(1, "edit", url(k), other), row(2, "remove", other))
    return t.supplier.select(F.explode(F.when(n < 8, move).when(n < 16, swap).otherwise(clash)).alias("e")).select("e.*")


#: Per supplier: the new link, and what the rules leave, by nation.
_ORDERED = """
s AS (SELECT s_suppkey k, s_nationkey n, 'https://portal.example.org/x?noticeUID=CO1.NTC.' u, s_suppkey + CASE WHEN s_nationkey % 2 = 0 THEN 1000000 ELSE 2000000 END o FROM supplier)"""


@query("H12_ordered_log", _ORDERED + """
SELECT 3 * k + i ord, CASE WHEN n < 8 THEN ['edit', 'edit', 'add'][i + 1] WHEN n < 16 THEN ['remove', 'add', 'edit'][i + 1] ELSE ['add', 'edit', 'remove'][i + 1] END op,
  CASE WHEN n < 8 THEN ['aplicado', 'aplicado', 'ampliado'][i + 1] WHEN n = 9 THEN ['no_encontrado', 'aplicado', 'sin_cambio'][i + 1] WHEN n < 16 THEN ['aplicado', 'aplicado', 'sin_cambio'][i + 1] ELSE ['aplicado', 'conflicto', 'aplicado'][i + 1] END estado,
  CASE WHEN n < 8 THEN ['previa', 'previa', 'nota ' || k][i + 1] WHEN n = 9 THEN [NULL, NULL, 'otra'][i + 1] WHEN n < 16 THEN ['previa', NULL, 'otra'][i + 1] ELSE [NULL, 'previa', 'nueva'][i + 1] END antes
FROM s, range(3) r(i)""")
def h12_ordered(t):
    return apply_edits(_watch_of_suppliers(t), _edits_in_order(t), "portal.example.org")[1].select("ord", "op", "estado", "antes")


@query("H12_ordered_watch", _ORDERED + """
SELECT u || CASE WHEN n < 8 THEN o ELSE k END url, 'CO1.NTC.' || CASE WHEN n < 8 THEN o ELSE k END process_id, CASE WHEN n < 8 THEN 'nota ' || k WHEN n < 16 THEN 'otra' ELSE 'previa' END note,
  CASE WHEN n < 8 THEN 'Hoja 2000,Hoja ' || (2001 + n) WHEN n < 16 THEN 'Hoja 1999' ELSE 'Hoja 2000' END hojas, CASE WHEN n < 8 THEN '2000,' || (2001 + n) WHEN n < 16 THEN '1999' ELSE '2000' END vigencias FROM s""")
def h12_ordered_watch(t):
    d = apply_edits(_watch_of_suppliers(t), _edits_in_order(t), "portal.example.org")[0]
    return d.select("url", "process_id", "note", F.array_join("hojas", ",").alias("hojas"), F.array_join("vigencias", ",").alias("vigencias"))


@query("H14_note_log", """
o AS (SELECT conv_id, min(text) t FROM {notas} WHERE role = 'user' GROUP BY 1), n AS (SELECT conv_id, CASE WHEN count(*) > 3 THEN ' ' ELSE max(text) END t FROM {notas} GROUP BY 1)
SELECT 'CO1.NTC.' || n.conv_id clave, CASE WHEN n.t = ' ' THEN 'obs_clear' ELSE 'obs_set' END op, o.t antes, nullif(n.t, ' ') despues FROM n LEFT JOIN o USING (conv_id) WHERE n.t <> ' ' OR o.t IS NOT NULL""".replace("WHERE role", "WHERE sheet"))
def h14(t):
    old = t.notas.where("sheet = 'user'").groupBy("process_id").agg(F.min("text").alias("text")).withColumnRenamed("process_id", "clave")
    new = t.notas.groupBy("process_id").agg(F.when(F.count("*") > 3, " ").otherwise(F.max("text")).alias("text")).withColumnRenamed("process_id", "clave")
    return C.set_notes(old, new)[1]


# ---- Streams ----------------------------------------------------------------


def _event_stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def _op(c="event_type"):
    e = F.col(c)
    return F.when(e == "signup", "fill").when(e == "click", "replace").when(e == "error", "verify_drift").when(e == "purchase", "watch_edit").otherwise("consulta")


@query("R1_stream_activity", "SELECT op, date_trunc('day', ts) desde, count(*) n, max(ts) ultimo FROM {bitacora} GROUP BY 1, 2")
def r1(t):
    d = _event_stream(t).select(F.col("event_id").alias("pos"), F.col("ts").cast("timestamp").alias("ts"), _op().alias("op"))
    rows = ST.run_to_table(ST.stream_activity(d), ST.run_folder(t.spark))
    return ST.newest(rows, ["op", "desde"]).withColumns({"desde": F.col("desde").cast("timestamp_ntz"), "ultimo": F.col("ultimo").cast("timestamp_ntz")})


@query("R2_stream_progress", """
c AS (SELECT user_id job, max(CASE WHEN event_type = 'signup' THEN 100 END) total, min(CASE WHEN event_type = 'signup' THEN ts END) inicio, count(*) FILTER (event_type IN ('view', 'click')) procesados, max(ts) ultimo,
   count(*) FILTER (event_type = 'purchase' AND value > 90) fin FROM events GROUP BY 1)
SELECT job, CASE WHEN fin > 0 THEN total ELSE procesados END procesados, total, CAST(CASE WHEN fin > 0 THEN 100 WHEN total > 0 THEN round_even(procesados * 100.0 / total, 1) ELSE 0 END AS DECIMAL(9,1)) porcentaje,
  CAST(CASE WHEN fin > 0 THEN 0 WHEN procesados > 0 AND total > procesados THEN floor(greatest(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(inicio)), 0) * (total - procesados) / procesados) END AS BIGINT) restante_s,
  coalesce(fin = 0 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ultimo)) < 90000 AND total - procesados > 0, false) activo FROM c""")
def r2(t):
    e = F.col("event_type")
    kind = F.when(e == "signup", "start").when(e.isin("view", "click"), "item").when((e == "purchase") & (F.col("value") > 90), "done")
    d = _event_stream(t).select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), F.lit(100).alias("total"))
    rows = ST.newest(ST.run_to_table(ST.stream_progress(d), ST.run_folder(t.spark)), ["job"])
    return ST.progress_view(rows, "2024-01-31 00:00:00", 90000)


@query("R3_stream_movements", _MOVES + " SELECT * FROM mv")
def r3(t):
    """One snapshot that arrives in several micro-batches, against a stored one."""
    folder = ST.run_folder(t.spark)
    save_snapshot(t.foto_vieja, f"{folder}/fotos", OLD_STAMP)
    total = t.foto_nueva.agg(F.count("*")).scalar()
    t.foto_nueva.withColumns({"stamp": F.lit(NEW_STAMP), "total": total}).repartition(3, "id_contrato").write.parquet(f"{folder}/llegadas")
    landed = t.spark.read.parquet(f"{folder}/llegadas")
    arriving = t.spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/llegadas")
    moves = ST.stream_movements(arriving, f"{folder}/fotos", folder, "id_contrato", {"cambio_estado": "estado"}, "adjudicado")
    return moves.select("tipo", "id", "antes", "despues")


def _lost(t, segment):
    """The tampered log without its most expensive lookups, in files that hold no stretch of a chain whole."""
    gone = (F.col("op") == "consulta") & (F.col("nuevo").cast("double") > 90)
    return _tampered(t, segment).where(~gone).repartition(4, F.xxhash64("pos"))


@query("R4_stream_verify", """
e AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY pos) cpos FROM {bitacora})
SELECT chain_id, count(*) entradas, CAST(sum(CASE WHEN op IN ('fill', 'verify_drift') AND CAST(nuevo AS DOUBLE) > 90 THEN 1 ELSE 0 END) AS BIGINT) rotas, max(cpos) - count(*) faltan
FROM e WHERE op <> 'consulta' OR CAST(nuevo AS DOUBLE) <= 90 GROUP BY 1""")
def r4(t):
    folder = ST.run_folder(t.spark)
    _lost(t, 8).write.parquet(f"{folder}/bitacora")
    log = t.spark.read.parquet(f"{folder}/bitacora")
    stream = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/bitacora")
    rows = ST.run_to_table(ST.stream_verify(stream, _E_COLS, 8), f"{folder}/salida", "append")
    return ST.chain_state(rows)
