"""Plans that must not deal out, sort or read their rows more often than needed."""

import re

from pyspark.sql import functions as F

from contrapunto import schemas as S
from contrapunto.functions.text import leading_number
from contrapunto.operators import documents as D
from contrapunto.operators import fill as FI
from contrapunto.operators import integrity as IN
from contrapunto.operators import ordering as O
from contrapunto.operators import resolve as RE
from contrapunto.operators import rollups as R
from contrapunto.operators.detail import process_detail
from contrapunto.plans.analogs import Tables
from contrapunto.plans.rollup_queries import a2_block, a3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Broadcast)Exchange ", plan(df)))


def test_contract_block_is_one_pass(spark, data_dir):  # F16
    assert exchanges(a2_block(Tables(spark, data_dir))) == 1


def test_lists_of_small_and_large_groups(spark, monkeypatch):  # F17
    rows = [(g, v, o) for g, n in (("a", 3), ("b", 11), (None, 7)) for i in range(n) for v, o in ((f"v{i}", -i), (f"v{i % 2}", i))] + [("c", "", 1), ("d", None, 1)]
    df = spark.createDataFrame(rows, "g string, v string, o int")
    for repeats in (True, False):
        got = {}
        for few in (1, 5, 100):  # all numbered, some, none
            monkeypatch.setattr(O, "FEW", few)
            got[few] = sorted(O.listing(df, ["g"], "v", "t", by="o", cell=2, repeats=repeats).collect(), key=repr)
        assert got[1] == got[5] == got[100] and {r["g"] for r in got[100]} == {"a", "b", None}
    assert exchanges(O.listing(df, ["g"], "v", "t")) == 1


def test_policies_meet_contracts_twice(spark, data_dir):  # F18
    assert "SortMergeJoin" not in plan(R.with_process(Tables(spark, data_dir).garantias, Tables(spark, data_dir).contratos))
    t = Tables(spark, data_dir)
    assert exchanges(R.policy_totals(t.contratos, t.garantias, ["aseguradora", "tipo", "riesgo"])) == 3
    assert a3(t).count() > 0


def test_fills_know_their_columns(spark):  # F14, F19
    names = [*S.LEDGER_COLUMNS.values(), "35A. ADICIONES VALOR TOTAL", " 4. X", "4.", "sin numero", *S.INTERNAL_LABELS]
    rows = spark.createDataFrame([(n,) for n in names], "c string")
    for name, own in rows.select("c", F.coalesce(leading_number("c"), "c").isin(S.INTERNAL_LABELS)).collect():
        assert FI.own_column(name) == own


def test_tree_reads_its_log_once(spark):  # F25
    log = spark.range(40).select((F.col("id") % 3).alias("c"), F.expr("id div 9").alias("segmento"), F.col("id").alias("cpos"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    assert "Range" not in plan(IN.merkle_tree(log, "c", 2))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_children_of_all_kinds_meet_the_contracts_in_one_join(spark):  # F13
    p = spark.createDataFrame([("P1", "x")], "process_id string, fase string")
    c = spark.createDataFrame([("C1", "P1"), ("C2", "P1")], "id_contrato string, process_id string")
    kids = {k: (spark.createDataFrame([("C1", 1, 'a"b'), ("C2", None, None), ("C9", 3, "x")], "id_contrato string, n int, t string"), ["n", "t"]) for k in "abc"}
    d = process_detail(p, c, kids, ["fase"], ["process_id"])
    assert plan_of(d).count("Join ") == 1
    rows = sorted(tuple(r) for r in d.where("seccion in ('a', 'b', 'c')").collect())
    assert rows == sorted(("P1", k, i, j) for k in "abc" for i, j in (("C1", '{"n":"1","t":"a\\"b"}'), ("C2", '{"n":null,"t":null}')))


def test_vocabularies_are_gathered_from_sums(spark):  # F13
    c = spark.createDataFrame([("C1", "P1"), ("C2", "P1"), ("C3", "P2")], "id_contrato string, process_id string")
    child = spark.createDataFrame([("C1", "a", 1), ("C1", "b", 2), ("C2", "a", 4), ("C2", None, 8), ("C2", "", 16), ("C3", None, None)], "id_contrato string, t string, v int")
    d = R.child_rollup(child, c, ["t"], {"n": (F.count("*"), F.sum), "v": (F.sum("v"), F.sum), "m": (F.max("v"), F.max)}, few=True)
    assert plan_of(d).count("Aggregate [") == 2
    assert sorted(tuple(r) for r in d.select("process_id", "n", "v", "m", "t").collect()) == [("P1", 5, 31, 16, "a | b"), ("P2", 1, None, None, None)]


def test_child_texts_are_written_without_a_variant(spark):  # F15
    c = spark.createDataFrame([("C1", "P1")], "id_contrato string, process_id string")
    kid = spark.createDataFrame([("C1", 'a"\\\n\x01é/', "1.50"), ("C1", None, "x"), ("C2", "", None), ("C1", "t", " 7 ")], "id_contrato string, zeta string, alfa string")
    one = [RE.child_rows(c, {"k": lambda: kid, "no": lambda: spark.read.parquet("/no/hay")}, {"k": {"alfa": "decimal(9,2)"}}, **x) for x in ({"as_text": True}, {})]
    assert "to_variant_object" not in plan_of(one[0]) and "try_variant_get" not in plan_of(one[0])
    key = lambda d: sorted(tuple("" if v is None else v for v in r) for r in d.collect())
    assert key(one[0]) == key(one[1].withColumn("datos", F.to_json("datos")))


def test_lost_entries_are_found_in_one_window_over_segments(spark):  # F22
    d = spark.createDataFrame([(g, i) for g in ("a", "b", "c", "d", "e") for i in range(1, 9)], "chain_id string, pos long")
    log = IN.build_chain(d, "chain_id", "pos", ["pos"], segment=3)
    roots = IN.chain_roots(log, "chain_id")
    kept = log.where("not (chain_id = 'a' and segmento = 1) and not (chain_id = 'b' and cpos >= 7) and not (chain_id = 'c' and cpos in (1, 2, 3, 5, 6)) and chain_id <> 'd'")
    out = IN.verify_chain(kept, "chain_id", ["pos"], roots, 3)
    assert plan_of(out).count("lead(") == 1
    assert sorted(tuple(r) for r in out.collect()) == [("a", 4, True, False), ("b", 7, True, False), ("c", 1, True, False), ("c", 5, True, False), ("d", 1, True, False)]


def test_a_text_is_folded_once(spark):  # F24
    d = spark.createDataFrame([(1, "Otrosí y prórroga, acta de inicio", 1), (2, None, 2), (3, "nada", 0)], "doc_id long, texto string, n_pages int")
    out = D.document_summary(d)
    assert plan_of(out).count("translate(") == 1
    assert [(r.palabras_modif, r.palabras_leg, r.escaneado) for r in out.orderBy("doc_id").collect()] == [("OTROSI; PRORROGA", "ACTA DE INICIO", True), ("", "", None), ("", "", False)]


def test_the_first_title_is_the_first_candidate(spark):  # F28
    rows = ["MODIFICATORIO No 2 AL CONTRATO\nx", "abc\n\n  ADENDA No 5 AL PLIEGO  \nOTROSI NUMERO CINCO", "nada\nde nada", "", " \n ", None, "corto\nTEXTO SOLO EN MAYUSCULAS"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, c string")
    got = d.select("i", D.first_title("c").alias("a"), F.get(D.title_candidates("c"), F.lit(0)).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [r.b for r in got] == ["MODIFICATORIO No 2 AL CONTRATO", "ADENDA No 5 AL PLIEGO", "nada", None, None, None, "TEXTO SOLO EN MAYUSCULAS"]


def test_children_meet_the_contracts_before_they_are_texts(spark):  # F3
    p = spark.createDataFrame([("P1", "x")], "process_id string, fase string")
    c = spark.createDataFrame([("C1", "P1")], "id_contrato string, process_id string")
    kids = {"a": (spark.sql("SELECT 'C1' id_contrato, 'x' t, CAST(1.5 AS DECIMAL(9,2)) v, DATE '2024-01-31' d, 'y' u"), ["u", "t", "v"]),
            "b": (spark.sql("SELECT 'C1' id_contrato, DATE '2024-01-31' d, CAST(2 AS DECIMAL(9,2)) w, CAST(NULL AS STRING) t"), ["d", "w", "t"])}
    d = process_detail(p, c, kids, ["fase"], ["process_id"])
    assert "to_json" not in plan_of(d.where("seccion in ('a', 'b')")).split("Join ")[1]
    assert sorted((r.seccion, r.contenido) for r in d.where("clave = 'C1' and seccion <> 'contrato'").collect()) == [
        ("a", '{"t":"x","u":"y","v":"1.50"}'), ("b", '{"d":"2024-01-31","t":null,"w":"2.00"}')]
