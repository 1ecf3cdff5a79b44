"""Operators on the small published cases, and on groups far larger than one cell."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from contrapunto.operators import blocks as B
from contrapunto.operators import changes as C
from contrapunto.operators import documents as D
from contrapunto.operators import fill as FI
from contrapunto.operators import filters as FL
from contrapunto.operators import integrity as IN
from contrapunto.operators import ordering as O
from contrapunto.operators import pages as P
from contrapunto.operators import quality as Q
from contrapunto.operators import resolve as R
from contrapunto.operators import rollups as RU
from contrapunto.operators.edits import apply_edits
from contrapunto.sources import scans as SC


def day(s):
    return dt.date.fromisoformat(s)


# ---- Amendment summary ------------------------------------------------------

ADD = "id_contrato string, tipo string, descripcion string, fecha date, valor decimal(18,2), dias int, seq string"
RICH = "id_contrato string, valor decimal(18,2), dias int, proposito string, descripcion string, fecha_aprob date, seq string"
CON = "id_contrato string, process_id string, seq long, dias_adicionados int"


def amendments(spark, contracts, additions=(), rich=(), processes=("P1",)):
    return RU.amendment_summary(
        spark.createDataFrame([(p,) for p in processes], "process_id string"), spark.createDataFrame(list(contracts), CON),
        spark.createDataFrame(list(additions), ADD), spark.createDataFrame(list(rich), RICH)).collect()


def test_two_additions(spark):
    rows = amendments(spark, [("C1", "P1", 1, 30)], [("C1", "Adición", "d", day("2026-02-10"), None, 0, "1"), ("C1", "Prórroga", "", day("2026-03-05"), None, 0, "2")])
    r = rows[0]
    assert (r.hubo, r.cantidad, r.tipos, r.fecha_ultima, r.fuente, r.dias) == ("Sí", 2, "Adición; Prórroga", day("2026-03-05"), "cb9c(2)", 30)
    assert r.detalle == "Adición — d | Prórroga"


def test_process_without_contract(spark):
    r = amendments(spark, [("C9", "P9", 1, 0)])[0]
    assert (r.hubo, r.cantidad, r.tipos, r.nota) == ("No", 0, "", "Sin modificatorios registrados en la fuente.")


@pytest.mark.parametrize("days,hit", [(0, "No"), (15, "Sí"), (None, "No")])
def test_days_alone(spark, days, hit):
    r = amendments(spark, [("C1", "P1", 1, days)])[0]
    assert r.hubo == hit
    if days:
        assert r.fuente == "+15d" and r.detalle == "15 día(s) adicionados al contrato"


def test_rich_details_win_and_overflow(spark):
    rich = [("C1", Decimal(1000 + i), 0, f"p{i}", "", day("2024-01-01"), f"{i:02d}") for i in range(12)]
    r = amendments(spark, [("C1", "P1", 1, 0)], [("C1", "Adición", "x", day("2023-01-01"), None, 0, "1")], rich)[0]
    assert r.cantidad == 12 and r.detalle.startswith("$1,000 / p0 | $1,001 / p1") and r.detalle.endswith("… y 2 más") and r.fuente == "cb9c(1)+u8cx(12)"


# ---- Child rollups ----------------------------------------------------------


def con(spark, *ids):
    return spark.createDataFrame([(c, "P1", i, 0) for i, c in enumerate(ids)], CON)


def test_policies(spark):
    g = spark.createDataFrame([("A", "Seg1", "Cumplimiento", "r", "Vigente", day("2025-03-31"), day("2024-01-02"), Decimal(3000000), "1"),
                               ("A", "Seg2", "Calidad", "r", "Vencida", day("2024-01-01"), day("2024-01-01"), Decimal(1500000), "2")],
                              "id_contrato string, aseguradora string, tipo string, riesgo string, estado string, fecha_fin date, fecha_exp date, valor decimal(18,2), numero string")
    r = RU.policies(con(spark, "A"), g).first()
    assert (r.polizas, r.vigentes, r.fin_max, r.valor_total, r.aseguradoras, r.primera_expedicion) == (2, 1, day("2025-03-31"), Decimal(4500000), "Seg1 | Seg2", day("2024-01-01"))


def test_payments(spark):
    f = spark.createDataFrame([("A", "1", day("2024-01-15"), "Pagada", True, Decimal(1000), Decimal(1000), Decimal(900)), ("A", "2", day("2024-03-15"), "Radicada", False, Decimal(500), Decimal(500), Decimal(450))],
                              "id_contrato string, numero string, fecha date, estado string, pagada boolean, valor_total decimal(18,2), valor_a_pagar decimal(18,2), valor_neto decimal(18,2)")
    r = RU.payments(con(spark, "A"), f).first()
    assert (r.facturas, r.pagadas, r.facturado, r.a_pagar) == (2, 1, 1500, 1500) and r.ultima.startswith("2024-03-15 #2 Radicada")


def test_progress(spark):
    e = spark.createDataFrame([("A", Decimal(30), Decimal(50), None, None), ("A", Decimal(45), Decimal(60), None, None)], "id_contrato string, avance_real decimal(9,2), avance_esperado decimal(9,2), entrega_real date, entrega_esperada date")
    s = spark.createDataFrame([("A", day("2024-05-01"), "Suspensión", "p")], "id_contrato string, fecha_creacion date, tipo string, proposito string")
    r = RU.progress(con(spark, "A"), e, s).first()
    assert (r.avance_real, r.avance_esperado, r.brecha, r.suspensiones, r.ultima_suspension) == (45, 60, 15, 1, "2024-05-01 - Suspensión")


def test_budget_is_exact(spark):
    c = spark.createDataFrame([("A", "P1", Decimal("100800.50"), Decimal(0))], "id_contrato string, process_id string, valor decimal(18,2), valor_pagado decimal(18,2)")
    a = spark.createDataFrame([("A", "x", Decimal("25000.25")), ("A", "x", Decimal("10000.10")), ("A", "y", Decimal("-5000.05"))], "id_contrato string, tipo string, valor decimal(18,2)")
    r = RU.budget(c, a).first()
    assert (r.adiciones, r.reducciones, r.total) == (Decimal("35000.35"), Decimal("5000.05"), Decimal("130800.80"))
    assert r.total == r.inicial + r.adiciones - r.reducciones


# ---- Large groups -----------------------------------------------------------


def test_listing_keeps_every_value_in_order(spark):
    d = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 10)).alias("k"), F.lpad(F.col("id").cast("string"), 6, "0").alias("v"), (-F.col("id")).alias("o"))
    got = O.listing(d.unionByName(d), ["k"], "v", "t", by="o", cell=100)
    parts = got.where("k = 'hot'").orderBy("part").collect()
    assert all(r.t.count(" | ") < 100 for r in parts) and len(parts) >= 40
    assert " | ".join(r.t for r in parts).split(" | ") == [f"{i:06d}" for i in range(3999, -1, -1)]
    assert got.where("k = 'k1'").count() == 1


def test_positions_match_row_number(spark):
    d = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id"))
    got = O.positions(d, ["k"], ["id"], F.expr("id div 64"), "pos").orderBy("id").collect()
    seen = {0: 0, 1: 0}
    for r in got:
        seen[r.k] += 1
        assert r.pos == seen[r.k]


def test_top_k_prunes_before_the_shuffle(spark, capsys):
    d = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    O.top_k(d, ["k"], [F.desc("id")], 3).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


# ---- Fill -------------------------------------------------------------------


def _fill(spark, data_dir):
    from contrapunto.plans.analogs import Tables
    from contrapunto.plans.projection_queries import fills_of
    t = Tables(spark, data_dir)
    return t, fills_of(t)


def test_fill_keeps_provenance_and_no_placeholders(spark, data_dir):
    _, fills = _fill(spark, data_dir)
    fills = fills.cache()
    assert fills.where("fuente is null or confianza is null or columna is null").count() == 0
    assert fills.where(F.lower("valor").isin("no definido", "n/a", "")).count() == 0
    assert fills.where("clave = 'avance_fisico' and escribible").count() == 0
    fills.unpersist()


def test_decide_fills_is_idempotent(spark, data_dir):
    _, fills = _fill(spark, data_dir)
    first = FI.decide_fills(fills, fills.select("process_id", "clave", "valor").limit(0))
    assert first.where("op <> 'fill'").count() == 0
    again = FI.decide_fills(fills.where("clave <> 'numero'"), fills.select("process_id", "clave", "valor"))
    assert again.count() == 0


def test_confidence_rules(spark):
    d = spark.createDataFrame([("a", "HIGH")] * 7 + [("a", "LOW")] * 3 + [("b", "HIGH"), ("b", "MEDIUM")], "process_id string, confianza string")
    assert {r.process_id: r.confianza for r in FI.worst_confidence(d).collect()} == {"a": "LOW", "b": "MEDIUM"}
    assert {r.process_id: r.confianza for r in FI.ratio_confidence(d).collect()} == {"a": "HIGH", "b": "MEDIUM"}


def test_unknown_column_group_is_an_error(spark):
    g = B.ColumnGroups()
    g.register("a", ["x"], lambda **t: None)
    with pytest.raises(KeyError):
        g.enrich(spark.createDataFrame([("P",)], "process_id string"), ["zzz"])


# ---- Cascade, filters, links ------------------------------------------------


def test_cascade_order_is_a_parameter(spark):
    w = spark.createDataFrame([(1, "A", None), (2, "B", None), (3, "Z", None)], "item long, process_id string, notice_id string")
    src = lambda *keys: spark.createDataFrame([(k, "r", Decimal(1), day("2024-01-01")) for k in keys], "clave string, ref string, valor decimal(18,2), fecha_firma date")
    s = {"api": src("A"), "portal": src("A", "B"), "integrado": src("A", "B")}
    got = lambda pr: {r.item: r.data_source for r in R.cascade(w, s, pr).collect()}
    assert got(["api", "portal", "integrado"]) == {1: "api", 2: "portal", 3: "none"}
    assert got(["api", "integrado", "portal"])[2] == "integrado" and got(["portal"]) == {1: "portal", 2: "portal", 3: "none"}
    with pytest.raises(KeyError):
        got(["otra"])


def test_empty_facets_keep_all(spark):
    d = spark.createDataFrame([("x", day("2024-01-01"))], "estado string, fecha_firma date")
    assert FL.facet_filter(d, {"estado": []}).count() == 1 and FL.facet_filter(d, {}, ["2023"]).count() == 0


def test_link_column_detection(spark):
    cells = spark.createDataFrame([("h1", 1, 1, "A", "x"), ("h1", 1, 2, "B", "https://portal.example.org/1"), ("h2", 1, 1, "Link", "y"), ("h2", 1, 2, "B", "https://portal.example.org/1")],
                                  "sheet string, row_no int, col_no int, header string, val string")
    got = {r.sheet: (r.col_no, r.via) for r in SC.detect_link_column(cells, "portal.example.org").collect()}
    assert got == {"h1": (2, "conteo"), "h2": (1, "encabezado")}
    assert SC.detect_link_column(cells, "portal.example.org", preferred="B").where("via = 'preferida'").count() == 2


# ---- Quality ----------------------------------------------------------------


@pytest.mark.parametrize("note,api,docs,label", [
    (False, False, False, "concuerdan_sin_modif"), (True, True, True, "concuerdan_con_modif"), (True, False, True, "api_atrasado_docs_y_nota_si"), (True, True, False, "concuerdan_con_modif"),
    (False, True, False, "fuente_dice_si_nota_no"), (False, False, True, "fuente_dice_si_nota_no"), (False, True, True, "fuente_dice_si_nota_no"), (True, False, False, "nota_dice_si_fuente_no")])
def test_verdict_table(spark, note, api, docs, label):
    d = spark.createDataFrame([(note, api, docs)], "n boolean, a boolean, d boolean")
    assert d.select(Q.verdict("n", "a", "d").alias("v")).first().v == label


def test_zero_is_compared_and_blank_is_not(spark):
    d = spark.createDataFrame([(1, "0", "2"), (2, "", "2"), (3, "1", "5"), (4, "0", "1")], "id int, a string, b string")
    assert [r.id for r in Q.check_pairs(d, ["id"], [("a", "b", "mods_count")]).collect()] == [1]


def test_money_rules(spark):
    d = spark.createDataFrame([(1, "100", "101"), (2, "100", "102"), (3, "100", "0")], "id int, a string, b string")
    assert [r.id for r in Q.check_pairs(d, ["id"], [("a", "b", "money")]).collect()] == [2]


# ---- Changes ----------------------------------------------------------------


def test_movements_need_a_baseline(spark):
    cur = spark.createDataFrame([("A", "x", "Si")], "id string, fase string, adj string")
    assert C.movements(cur, None, "id", {"fase": "fase"}).count() == 0
    prev = spark.createDataFrame([("A", "", "No"), ("B", "x", "No")], "id string, fase string, adj string")
    assert sorted(r.tipo for r in C.movements(cur, prev, "id", {"cambio_fase": "fase"}, "adj").collect()) == ["adjudicado", "desaparecido"]


def ledger(spark):
    u = "https://portal.example.org/x?noticeUID=CO1.NTC."
    rows = [("Hoja 2024", 2, 2, u + "1", "CONTRATO-ENT-0001-2024", None), ("Hoja 2024", 2, 3, u + "2", "2", None), ("Hoja 2023", 1, 2, u + "3", "x", None),
            ("Hoja 2023", 1, 3, u + "1\n", "9", "2023"), ("Hoja 2018-2021", 0, 5, u + "4", "1", "2018"), ("Hoja 2023", 1, 4, "", "1", None), ("Hoja 2023", 1, 5, "https://otro.example.net/1", "1", None)]
    return spark.createDataFrame(rows, "sheet string, sheet_ord int, row_no int, url string, numero string, vigencia string")


def test_import_counts_and_second_run_adds_nothing(spark):
    none = spark.createDataFrame([], "item string, process_id string, url string")
    rec = spark.createDataFrame([], "item string, sheet string, row_no int, url string")
    first = C.import_ledger(ledger(spark), none, rec, "portal.example.org").cache()
    assert (first.count(), first.where("resultado = 'nueva'").count(), first.where("resultado = 'fusionada'").count()) == (5, 4, 1)
    assert C.import_items(first).count() == 4
    watch = C.import_items(first).select("item", F.col("pid").alias("process_id"), "url")
    again = C.import_ledger(ledger(spark), watch, first.select("item", "sheet", "row_no", "url"), "portal.example.org")
    assert {r.resultado for r in again.collect()} == {"ya_registrada"} and again.count() == 5
    lists = {(r.item, r.campo): r.texto for r in C.import_lists(first).collect()}
    assert lists[("CO1.NTC.1", "hojas")] == "Hoja 2023 | Hoja 2024" and lists[("CO1.NTC.4", "consecutivos")] == "CONTRATO-ENT-0001-2018"


def test_lww_merge_is_idempotent(spark):
    d = lambda *r: spark.createDataFrame(list(r), "url string, note string, edited_at string")
    a, b = d(("u", "local", "2024"), ("v", "l", None)), d(("u", "remota", "2025"), ("v", "r", None), ("w", "solo", None))
    m = C.merge_lww(a, b, "url", "edited_at")
    assert {r.url: r.note for r in m.collect()} == {"u": "remota", "v": "l", "w": "solo"}
    assert {r.url: r.note for r in C.merge_lww(m.drop("replica"), b, "url", "edited_at").collect()} == {"u": "remota", "v": "l", "w": "solo"}


def test_edits_reject_and_log(spark):
    u = "https://portal.example.org/x?noticeUID=CO1.NTC."
    w = spark.createDataFrame([(u + "1", "CO1.NTC.1", "n", "h"), (u + "2", "CO1.NTC.2", "n", "h")], "url string, process_id string, note string, sheet string")
    e = spark.createDataFrame([(1, "add", u + "1", None, None, None), (2, "add", u + "5", None, "a", "h"), (3, "add", u + "5&x=1", None, None, None), (4, "edit", u + "2", u + "1", None, None),
                               (5, "remove", u + "9", None, None, None), (6, "add", "https://malo.example/1", None, None, None)], "ord int, op string, url string, new_url string, note string, sheet string")
    out, log = apply_edits(w, e, "portal.example.org")
    assert {r.ord: r.estado for r in log.collect()} == {1: "duplicado", 2: "aplicado", 3: "duplicado", 4: "conflicto", 5: "no_encontrado", 6: "dominio_invalido"}
    assert sorted(r.process_id for r in out.collect()) == ["CO1.NTC.1", "CO1.NTC.2", "CO1.NTC.5"]


def test_edits_follow_each_other(spark):
    u = "https://portal.example.org/x?noticeUID=CO1.NTC."
    w = spark.createDataFrame([(u + "1", "CO1.NTC.1", "n", "Hoja 2020"), (u + "2", "CO1.NTC.2", None, None), (u + "7", "CO1.NTC.7", "igual", "h")], "url string, process_id string, note string, sheet string")
    rows = [(1, "edit", u + "1", u + "3", None, None), (2, "edit", u + "3", None, "segunda", None), (3, "add", u + "3&x=1", None, None, "Hoja 2021"), (4, "add", u + "3", None, None, "Hoja 2021"),
            (5, "edit", u + "2", u + "3", None, None), (6, "remove", u + "3", None, None, None), (7, "edit", u + "2", u + "3", None, None), (8, "add", u + "2", None, "libre", None),
            (9, "edit", u + "1", None, "x", None), (10, "remove", None, None, None, None), (11, "add", None, None, None, None)]
    e = spark.createDataFrame(rows[::-1], "ord int, op string, url string, new_url string, note string, sheet string")
    out, log = apply_edits(w, e, "portal.example.org")
    assert [r.estado for r in log.orderBy("ord").collect()] == ["aplicado", "aplicado", "ampliado", "duplicado", "conflicto", "aplicado", "aplicado", "aplicado", "no_encontrado", "no_encontrado", "dominio_invalido"]
    assert sorted((r.url[-1], r.note) for r in out.collect()) == [("2", "libre"), ("3", None), ("7", "igual")]
    many = spark.range(3000).selectExpr("cast(id as int) ord", "'edit' op", f"'{u}7' url", "cast(null as string) new_url", "concat('v', id) note", "concat('Hoja ', 1990 + id % 30) sheet")
    out, log = apply_edits(w, many, "portal.example.org")
    item = out.where("note = 'v2999'").first()
    assert log.where("estado = 'aplicado'").count() == 3000 and len(item.hojas) == 31 and item.vigencias[0] == "1990"
    assert apply_edits(w.limit(0), many.limit(0), "portal.example.org")[0].count() == 0


# ---- Integrity --------------------------------------------------------------


def entries(spark, n=10):
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 0).alias("chain_id"), F.lit("fill").alias("op"), F.concat(F.lit("v"), "id").alias("nuevo"))


COLS = ["pos", "op", "nuevo"]


def test_chain_starts_at_genesis_and_verifies(spark):
    log = IN.build_chain(entries(spark), "chain_id", "pos", COLS).cache()
    assert log.orderBy("cpos").first().prev_hash == "0" * 64
    assert IN.verify_chain(log, "chain_id", COLS).count() == 0


def test_edited_payload_and_edited_link_are_found(spark):
    log = IN.build_chain(entries(spark), "chain_id", "pos", COLS)
    edited = log.withColumn("nuevo", F.when(F.col("pos") == 4, "otro").otherwise(F.col("nuevo")))
    bad = IN.verify_chain(edited, "chain_id", COLS).collect()
    assert [(r.cpos, r.hash_ok, r.enlace_ok) for r in bad] == [(5, False, True)]
    relinked = log.withColumn("prev_hash", F.when(F.col("pos") == 4, F.repeat(F.lit("a"), F.lit(64))).otherwise(F.col("prev_hash")))
    relinked = relinked.withColumn("hash", F.when(F.col("pos") == 4, F.sha2(F.concat(IN.canonical(COLS), "prev_hash"), 256)).otherwise(F.col("hash")))
    bad = {r.cpos: (r.hash_ok, r.enlace_ok) for r in IN.verify_chain(relinked, "chain_id", COLS).collect()}
    assert bad == {5: (True, False), 6: (True, False)}


def test_a_missing_entry_breaks_the_link(spark):
    log = IN.build_chain(entries(spark), "chain_id", "pos", COLS)
    assert [r.cpos for r in IN.verify_chain(log.where("pos <> 4"), "chain_id", COLS).collect()] == [6]


def test_a_lost_segment_or_tail_is_found(spark):
    n = IN.SEGMENT * 3
    log = IN.build_chain(entries(spark, n), "chain_id", "pos", COLS).cache()
    roots = IN.chain_roots(log, "chain_id")
    at = lambda d, r=None: sorted(x.cpos for x in IN.verify_chain(d, "chain_id", COLS, r).collect())
    assert at(log, roots) == []
    assert at(log.where("segmento <> 0")) == [1]
    assert at(log.where("segmento <> 1")) == [IN.SEGMENT + 1]
    assert at(log.where(f"cpos not between {IN.SEGMENT - 5} and {IN.SEGMENT}")) == [IN.SEGMENT - 5]
    assert at(log.where(f"cpos <= {n - 7}")) == [] and at(log.where(f"cpos <= {n - 7}"), roots) == [n - 6]
    assert at(log.limit(0), roots) == [1]


@pytest.mark.parametrize("shuffle", ["2", "7"])
def test_listing_parts_do_not_depend_on_partitions(spark, shuffle):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        d = spark.range(900).selectExpr("'a' k", "concat('v', id) v", "id o").unionByName(spark.range(5).selectExpr("'b' k", "concat('w', id) v", "id o"))
        got = {(r.k, r.part): r.t.split(" | ") for r in O.listing(d, ["k"], "v", "t", by="o", cell=256).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {("a", p): [f"v{i}" for i in range(256 * p, min(900, 256 * p + 256))] for p in range(4)}
    assert got == {**want, ("b", 0): [f"w{i}" for i in range(5)]}


def test_source_values_come_from_one_row(spark):
    d = spark.createDataFrame([("c", 5, "2024-01-01", "A"), ("c", 3, "2024-02-01", "B")], "id_contrato string, valor long, fecha string, proveedor string")
    r = Q.source_values({"x": d}).first()
    assert (float(r.valor_x), r.fecha_x, r.proveedor_x) == (3.0, "2024-02-01", "B")


def test_long_chain_is_segmented(spark):
    n = IN.SEGMENT * 2 + 10
    log = IN.build_chain(entries(spark, n), "chain_id", "pos", COLS).cache()
    assert log.select("segmento").distinct().count() == 3 and IN.verify_chain(log, "chain_id", COLS).count() == 0
    root = IN.chain_roots(log, "chain_id").first()
    changed = IN.build_chain(entries(spark, n).withColumn("nuevo", F.when(F.col("pos") == 7, "z").otherwise(F.col("nuevo"))), "chain_id", "pos", COLS)
    assert root.entradas == n and IN.chain_roots(changed, "chain_id").first().raiz != root.raiz


def test_fingerprint_ignores_order_and_sees_changes(spark):
    p = spark.createDataFrame([("P1", "x")], "process_id string, fase string")
    c = [("P1", "C1", "10"), ("P1", "C2", "20")]
    f = lambda rows: IN.fingerprint(p, spark.createDataFrame(rows, "process_id string, id_contrato string, valor string"), ["fase"], ["id_contrato", "valor"]).first().huella
    assert f(c) == f(c[::-1]) and f(c) != f([c[0], ("P1", "C2", "21")]) and f(c) != f([c[0]]) and f(c + [c[0]]) != f(c)


# ---- Documents --------------------------------------------------------------


@pytest.mark.parametrize("name,kind,number", [
    ("Modificatorio No 2.pdf", "Modificatorio", "2"), ("OTROSÍ N° 1A.pdf", "Otrosi", "1A"), ("Póliza adicional.pdf", None, None), ("MODULO 3.pdf", None, None), ("Adición y prórroga.pdf", "Prorroga", None),
    ("Acta de Liquidación.pdf", "Liquidacion", None), ("MOD 4 contrato", "Modificatorio", None), ("Otrosí 3 de 2021 contrato No 55", "Otrosi", "3"), ("adicional.pdf", None, None), ("informe.pdf", None, None)])
def test_name_types(spark, name, kind, number):
    r = D.classify_names(spark.createDataFrame([(name,)], "nombre string")).first()
    assert (r.tipo, r.numero) == (kind, number)


@pytest.mark.parametrize("text,amount", [
    ("SEGUNDA: Adicionar el contrato en la suma de DIECIOCHO MILLONES ($18.000.000) M/CTE", 18000000),
    ("adicionar el contrato. el canon mensual es de $1.052.000 mensuales", 1052000), ("adicionar el contrato sin cifra", None),
    ("adicionar el contrato " + "x" * 500 + " suma de $2.000.000", 2000000), ("adicionar el contrato " + "x" * 500 + " canon mensual por valor de $2.000.000", None)])
def test_added_amount(spark, text, amount):
    assert spark.createDataFrame([(text,)], "t string").select(D.added_amount("t").alias("a")).first().a.valor == amount


def test_amounts_of_every_verb_and_of_nothing(spark):
    far = "z" * 450
    rows = [("canon mensual. adicionar el contrato $1.000.000 " + far + " adicionar el contrato $3.000.000",), (None,), ("",), ("adicionar el contrato $50.000 y $2.500.000",)]
    got = [r.a for r in spark.createDataFrame(rows, "t string").coalesce(1).select(D.added_amount("t").alias("a")).collect()]
    assert [a and (a.valor, a.aviso) for a in got] == [(3000000, None), None, (None, D.NOTE_NO_AMOUNT), (2500000, None)]


@pytest.mark.parametrize("text,days", [
    ("prorróguese el plazo. prorrogar por CINCO (5) meses más", 150), ("prorrogar por 45 días", 45), ("prorrogar en dos semanas", 14), ("prorrogar por 2 (dos) años", None),
    ("prorrogar por varios días" + "y" * 500 + " prorrogar el plazo por un año", 365), ("prorrogar" + "y" * 500 + " por 9 días", None), ("prorrogar sin plazo", None), (None, None)])
def test_extension_days(spark, text, days):
    assert spark.createDataFrame([(text,)], "t string").select(D.extension_days("t").alias("d")).first().d == days


def test_specific_types_have_no_subtypes(spark):
    text = "Prorrogar el plazo y adicionar el contrato. " * 3
    d = spark.createDataFrame([("Modificatorio", text), ("Liquidacion", text), (None, text)], "tipo string, texto string")
    got = {r.tipo: r.s for r in d.select("tipo", D.subtypes("texto", "tipo").alias("s")).collect()}
    assert got == {"Modificatorio": ["Prorroga", "Adicion"], "Liquidacion": [], None: []}


def test_short_text_only_warns(spark):
    r = D.amendment_details(spark.createDataFrame([("Modificatorio", "corto")], "tipo string, texto string")).first()
    assert (r.subtipos, r.valor_adicionado, r.avisos) == ([], None, D.NOTE_SHORT)


def test_support_words_deep_in_the_body_do_not_decide(spark):
    head = "MODIFICATORIO No 3 AL CONTRATO DE OBRA\n"
    d = spark.createDataFrame([(1, head + "x" * 900 + " póliza de cumplimiento"), (2, "póliza de cumplimiento\n" + head)], "doc_id int, texto string")
    assert {r.doc_id: (r.tipo, r.numero) for r in D.classify_content(d).collect()}[1] == ("Modificatorio", "3")
    assert {r.doc_id: r.tipo for r in D.classify_content(d).collect()}[2] == "Poliza (soporte)"


def test_the_earliest_word_decides_however_late(spark):
    far = "palabra comun " * 2000
    d = spark.createDataFrame([(1, far + "\nse firma la prórroga y la adición"), (2, far + "\ncertificado de disponibilidad presupuestal\n" + far + " adicion"),
                               (3, far + " adicion " + far + "\ncertificado de disponibilidad presupuestal"), (4, far + "\nasunto: legalización\n" + far + "cesión"), (5, far), (6, None), (7, " ")], "doc_id int, texto string")
    got = {r.doc_id: (r.tipo, float(r.confianza), r.revisar) for r in D.classify_content(d).collect()}
    assert got == {1: ("Prorroga", 0.9, False), 2: ("Compromiso (soporte)", 0.95, False), 3: ("Adicion", 0.9, False), 4: ("Legalizacion (soporte)", 0.92, False), 5: (None, 0.3, True), 6: (None, 0.0, True), 7: (None, 0.0, True)}
    many = "\n".join(["linea %d sin nada" % i for i in range(60)] + ["OTROSI NUMERO %d DEL CONTRATO" % i for i in range(9)])
    titles = spark.createDataFrame([(many,)], "c string").select(D.title_candidates("c").alias("t"), D.title_candidates("c", 30, 5).alias("few")).first()
    assert len(titles.t) == 9 and titles.few == ["linea 0 sin nada"]


def test_notes(spark):
    d = spark.createDataFrame([("PRÓRROGA y otrosí; no leg",), ("nada",), ("NO  LEG",)], "text string")
    assert [(r.modificatorio, r.no_leg, r.menciones) for r in D.parse_notes(d).collect()] == [("Sí", "Sí", "OTROSI; PRORROGA"), ("No", "No", ""), ("No", "Sí", "")]


# ---- Pages ------------------------------------------------------------------

PAGE = """<html><body><label>Estado:</label><br/><b>En borrador</b><table>
<tr><td><label>  Título : </label></td><td><span>Obra del&nbsp;puente
   tramo 2</span></td><td>fuera</td></tr>
<tr><td><label>Valor total:</label></td><td><input type="text" value="$ 7.000"/>no se lee</td></tr>
<tr><td><label>Fase:</label></td><td></td></tr><tr><td><label>Fase:</label></td><td>Cierre</td></tr><tr><td><label>Fase:</label></td><td>Otra</td></tr>
<tr><td><label>Lotes?:</label></td><td>translator.loadFile(3)</td></tr>
<tr><td><label>No</label></td><td>x</td></tr></table>
<table id="x_GridDocument_y"><tr><td><span class="VortalSpan">Plano 1.pdf</span></td><td><a onclick="getAction('/Public/Tendering/Uno/DownloadFile' + '?' + 'documentFileId=' + '71' + '&' + 'mkey=' + '0f_3', true);">ver</a></td></tr>
<tr><td><span class="VortalSpan">Plano 1.pdf</span></td><td><a onclick="getAction('/Public/Tendering/Dos/DownloadFile' + '?' + 'documentFileId=' + '72', true);">ver</a></td></tr>
<tr><td><span class="VortalSpan">Acta.pdf</span></td><td><a onclick="abrir('/Public/Tendering/Dos/DownloadFile'); otra('documentFileId=' + '73')">ver</a></td></tr></table>
<table><tr><td>Notificación:</td><td>N-5</td><td>Cierre de ofertas</td><td>03/09/2023 08:00 AM</td></tr><tr><td>notificacion</td><td>N-5</td><td>Aviso 04/09/2023 9:15 pm</td><td></td></tr>
<tr><td>Notificación</td><td></td></tr><tr><td>Nota</td><td>N-5</td></tr></table></body></html>"""


def test_page_parts(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<html><nav><a href='/x'>x</a></nav></html>"), (3, None), (4, "")], "k int, h string")
    got = {r.k: r for r in P.parse_pages(pages, "k", "h", "https://p.example").collect()}
    one = got[1]
    assert one.fields == {"titulo": "Obra del puente | tramo 2", "valor_total": "$ 7.000", "fase": "Cierre", "estado": "En borrador"}
    assert one.all_labels == {"Estado": "En borrador", "Titulo": "Obra del puente | tramo 2", "Valor total": "$ 7.000", "Fase": "Cierre", "Lotes?": ""}
    url = "https://p.example/Public/Tendering/Uno/DownloadFile?documentFileId=71&mkey=0f_3"
    assert [tuple(d) for d in one.documents] == [("Plano 1.pdf", url), ("Acta.pdf", "")]
    assert [tuple(n) for n in one.notificaciones] == [("N-5", "Cierre de ofertas", "03/09/2023 08:00 AM"), ("N-5", "Aviso", "04/09/2023 9:15 pm")]
    for k in (2, 3, 4):
        assert (got[k].all_labels, got[k].fields, got[k].documents, got[k].notificaciones) == ({}, {}, [], [])


def test_page_texts_are_whole(spark):
    html = f"<table><tr><td><label>{'L' * 300}</label></td><td>{'v' * 2000}</td></tr><tr><td><label>Fase</label></td><td>{'w' * 900}</td></tr></table>"
    pages = spark.createDataFrame([(1, html)], "k int, h string")
    r = P.parse_pages(pages, "k", "h").first()
    assert len(r.all_labels["L" * 300]) == 2000 and len(r.fields["fase"]) == 900
    short = P.parse_pages(pages, "k", "h", label_limit=120, value_limit=500).first()
    assert list(short.all_labels) == ["Fase"] and len(short.fields["fase"]) == 500


def test_landed_documents_are_counted_by_fault(spark):
    rows = [("Adicion", True, None, 0.9, False), (None, True, "u", 0.3, True), (None, True, "u", 0.3, False), (None, None, " ", 0.3, None), (None, False, "u", None, False)]
    r = D.check_docs(spark.createDataFrame(rows, "tipo string, nucleo boolean, url string, confianza double, revisar boolean")).first()
    assert (r.docs, r.nucleo_sin_tipo, r.sin_enlace, r.confianza_baja) == (5, 2, 2, 2)
