"""Per-process aggregates.

Children are aggregated by contract first and joined to the contracts afterwards,
so raw children never meet each other and each child table is shuffled once, as
partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapunto.functions.money import percent_of
from contrapunto.functions.text import fold, null_placeholder
from contrapunto.operators import ordering as O
from contrapunto.schemas import TOTAL



def total(c) -> Column:
    return F.sum(c).cast(TOTAL)


def money_text(c: str) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.col(c), 0))


def with_process(child: DataFrame, contracts: DataFrame) -> DataFrame:
    """Hash join: the ids of contracts begin alike, which makes sorting by them slow."""
    return child.join(contracts.select("id_contrato", "process_id").hint("shuffle_hash"), "id_contrato")


def child_rollup(child: DataFrame, contracts: DataFrame, labels: list[str], aggs: dict[str, tuple], few: bool = False) -> DataFrame:
    """One scan of a child table to one row per process.

    ``aggs`` maps a name to (aggregate over child rows, how its partials merge).
    Without labels sums by contract meet the contracts.  With labels the rows do, since sums by contract and labels
    would be dealt out twice; the vocabularies are sets that grow inside the aggregate, no larger than their cells.
    Where a process has ``few`` different labels its rows are summed by them first: sets are sorted aggregates, slow over rows.
    """
    first = [a.alias(n) for n, (a, _) in aggs.items()]
    if not labels:
        return with_process(child.groupBy("id_contrato").agg(*first), contracts).groupBy("process_id").agg(*[fn(n).alias(n) for n, (_, fn) in aggs.items()])
    rows = with_process(child, contracts)
    if few:
        rows, first = rows.groupBy("process_id", *labels).agg(*first), [fn(n).alias(n) for n, (_, fn) in aggs.items()]
    return rows.groupBy("process_id").agg(*first, *[O.vocabulary(null_placeholder(x)).alias(x) for x in labels])


# ---- Amendments (A1, P22) ---------------------------------------------------


def amendment_totals_by_process(contracts: DataFrame, additions: DataFrame, rich: DataFrame) -> DataFrame:
    """Counts, sums and types of both amendment tables, one scan each."""
    add = child_rollup(additions, contracts, ["tipo"], {"n_add": (F.count("*"), F.sum), "f_add": (F.max("fecha"), F.max)})
    mod = child_rollup(rich, contracts, [], {
        "n_rich": (F.count("*"), F.sum), "v_rich": (F.sum("valor"), F.sum), "d_rich": (F.sum("dias"), F.sum),
        "f_rich": (F.max("fecha_aprob"), F.max)})
    days = contracts.groupBy("process_id").agg(F.sum("dias_adicionados").alias("d_own"))
    per = days.join(add, "process_id", "left").join(mod, "process_id", "left")
    return per.select(
        "process_id", F.coalesce("n_add", F.lit(0)).alias("n_add"), F.coalesce("n_rich", F.lit(0)).alias("n_rich"),
        F.coalesce(F.col("v_rich"), F.lit(0)).cast(TOTAL).alias("valor"),
        F.coalesce(F.nullif("d_rich", F.lit(0)), "d_own", F.lit(0)).alias("dias"),
        F.greatest("f_add", "f_rich").alias("fecha_ultima"), F.replace("tipo", F.lit(" | "), F.lit("; ")).alias("tipos"))


def amendment_details(contracts: DataFrame, additions: DataFrame, rich: DataFrame, k: int = 10) -> DataFrame:
    """First k described amendments of a process, rich rows preferred."""
    keys = contracts.select("id_contrato", "process_id", F.col("seq").alias("cseq"))

    def head(df, text):
        few = O.top_k(df.withColumn("t", text), ["id_contrato"], ["seq"], k, "_r")
        few = few.select("id_contrato", "seq", "t").join(keys, "id_contrato")
        return O.top_list(few, ["process_id"], ["cseq", "seq"], k, "t", "d")

    rich_text = F.concat_ws(
        " / ", F.when(F.col("valor") != 0, money_text("valor")),
        F.when(F.col("dias") != 0, F.concat(F.lit("+"), "dias", F.lit("d"))),
        F.coalesce(F.nullif("proposito", F.lit("")), "descripcion"),
    )
    add_text = F.concat_ws(" — ", F.coalesce("tipo", F.lit("modificación")), F.nullif("descripcion", F.lit("")))
    a, r = head(additions, add_text), head(rich, rich_text)
    return a.withColumnRenamed("d", "a").join(r.withColumnRenamed("d", "r"), "process_id", "full").select(
        "process_id", F.coalesce("r", "a").alias("lista"))


def amendment_note(df: DataFrame) -> Column:
    """One readable sentence per process, from the summary columns."""
    noun = F.when(F.col("cantidad") == 1, "modificatorio").otherwise("modificatorios")
    kinds = F.coalesce(F.nullif(F.replace("tipos", F.lit("; "), F.lit(", ")), F.lit("")), F.lit("MODIFICACION"))
    text = F.concat_ws(
        ". ",
        F.concat(F.col("cantidad"), F.lit(" "), noun, F.lit(" en la fuente ("), kinds, F.lit(")")),
        F.when(F.col("valor") != 0, F.concat(F.lit("valor acumulado "), money_text("valor"))),
        F.when(F.col("dias") != 0, F.concat(F.lit("+"), "dias", F.lit(" día(s)"))),
        F.when(F.col("fecha_ultima").isNotNull(), F.concat(F.lit("último "), F.col("fecha_ultima").cast("string"))),
    )
    return F.when(F.col("hubo") == "No", "Sin modificatorios registrados en la fuente.").otherwise(text)


def amendment_summary(processes: DataFrame, contracts: DataFrame, additions: DataFrame, rich: DataFrame,
                      tags: tuple[str, str] = ("cb9c", "u8cx")) -> DataFrame:
    totals = amendment_totals_by_process(contracts, additions, rich)
    lists = amendment_details(contracts, additions, rich)
    base = processes.select("process_id").join(totals, "process_id", "left")
    base = base.join(lists, "process_id", "left").fillna({"n_add": 0, "n_rich": 0, "dias": 0, "tipos": ""})
    base = base.withColumn("valor", F.coalesce("valor", F.lit(0).cast(TOTAL)))
    n = F.greatest("n_add", "n_rich")
    none = (F.col("n_add") == 0) & (F.col("n_rich") == 0)
    tag = lambda name, c: F.when(F.col(c) > 0, F.concat(F.lit(name + "("), F.col(c), F.lit(")")))
    out = base.select(
        "process_id",
        F.when((n > 0) | (F.col("dias") > 0) | (F.col("valor") > 0), "Sí").otherwise("No").alias("hubo"),
        n.alias("cantidad"), "tipos", "fecha_ultima", "valor", F.col("dias").cast("bigint").alias("dias"),
        F.when(none & (F.col("dias") != 0), F.concat(F.lit("+"), "dias", F.lit("d")))
        .otherwise(F.concat_ws("+", tag(tags[0], "n_add"), tag(tags[1], "n_rich"))).alias("fuente"),
        F.concat_ws(
            " | ",
            F.when(none & (F.col("dias") != 0), F.concat("dias", F.lit(" día(s) adicionados al contrato"))),
            "lista", F.when(n > 10, F.concat(F.lit("… y "), n - 10, F.lit(" más"))),
        ).alias("detalle"),
    )
    return out.withColumn("nota", amendment_note(out))


# ---- Contracts (A2) ---------------------------------------------------------


def contract_rollup(contracts: DataFrame) -> DataFrame:
    """Counts, money sums, dates and states of a process, in one pass over the contracts."""
    sums = {"contratos": (F.count("*"), F.sum), "valor": (F.sum("valor"), F.sum), "valor_pagado": (F.sum("valor_pagado"), F.sum),
            "dias_adicionados": (F.sum("dias_adicionados"), F.sum), "primera_firma": (F.min("fecha_firma"), F.min), "ultimo_fin": (F.max("fecha_fin"), F.max)}
    per = contracts.groupBy("process_id", "estado", "tipodoc").agg(*[a.alias(n) for n, (a, _) in sums.items()])
    d = per.groupBy("process_id").agg(*[fn(n).alias(n) for n, (_, fn) in sums.items()], O.vocabulary("estado").alias("estados"),
                                      O.vocabulary(null_placeholder("tipodoc")).alias("tipos_doc"))
    return d.withColumns({"valor": F.col("valor").cast(TOTAL), "valor_pagado": F.col("valor_pagado").cast(TOTAL),
                          "valor_pendiente": (F.col("valor") - F.col("valor_pagado")).cast(TOTAL)})


def contract_lists(contracts: DataFrame, cell: int = 256) -> DataFrame:
    """Ids, references, suppliers, documents and dates of a process, as joined text.

    These sets are open, so a process with many contracts spans several parts.
    """
    d = contracts.select(
        "process_id", "seq",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("campo"), v.cast("string").alias("v")) for n, v in [
                ("ids", F.col("id_contrato")), ("referencias", F.col("referencia")), ("proveedores", F.col("proveedor")),
                ("documentos", F.when(null_placeholder("tipodoc").isNull(), F.col("documento"))
                 .otherwise(F.concat_ws(":", "tipodoc", "documento"))),
                ("fechas_firma", F.col("fecha_firma")),
            ]
        ])).alias("x"),
    ).select("process_id", "seq", "x.campo", "x.v")
    return O.listing(d, ["process_id", "campo"], "v", "texto", by="seq", cell=cell)


# ---- Policies, payments, progress, edits, documents (A3-A7, A9) -------------


POLICY_AGGS = {
    "polizas": ("count(*)", F.sum), "vigentes": ("count_if(lower(estado) = 'vigente')", F.sum), "fin_max": ("max(fecha_fin)", F.max),
    "primera_expedicion": ("min(fecha_exp)", F.min), "valor_total": ("sum(valor)", F.sum)}


def policy_totals(contracts: DataFrame, g: DataFrame, labels: list[str], only: list[str] | None = None, few: bool = False) -> DataFrame:
    return child_rollup(g, contracts, labels, {n: (F.expr(e), fn) for n, (e, fn) in POLICY_AGGS.items() if only is None or n in only}, few)


def policies(contracts: DataFrame, g: DataFrame, k: int = 10) -> DataFrame:
    out = policy_totals(contracts, g, ["aseguradora", "tipo", "riesgo"])
    out = out.withColumn("valor_total", F.col("valor_total").cast(TOTAL)).withColumnsRenamed({"aseguradora": "aseguradoras", "tipo": "tipos", "riesgo": "riesgos"})
    text = F.concat("tipo", F.lit(" "), "aseguradora", F.lit(" #"), "numero",
                    F.lit(" ("), "estado", F.lit(", vence "), F.col("fecha_fin").cast("string"), F.lit(")"))
    rows = with_process(g.select("id_contrato", "tipo", "aseguradora", "numero", "estado", "fecha_fin"), contracts)
    lists = O.top_list(rows.withColumn("t", text), ["process_id"], ["fecha_fin", "numero", "t"], k, "t", "detalle")
    return out.join(lists, "process_id", "left")


def payments(contracts: DataFrame, f: DataFrame, k: int = 8) -> DataFrame:
    per = f.groupBy("id_contrato").agg(
        F.count("*").alias("n"), F.count_if("pagada").alias("p"), F.sum("valor_total").alias("t"),
        F.sum("valor_a_pagar").alias("a"), F.sum("valor_neto").alias("e"))
    sums = with_process(per, contracts).groupBy("process_id").agg(
        F.sum("n").alias("facturas"), F.sum("p").alias("pagadas"), total("t").alias("facturado"),
        total("a").alias("a_pagar"), total("e").alias("neto"))
    text = F.concat_ws(" ", F.col("fecha").cast("string"), F.concat(F.lit("#"), "numero"), "estado",
                       F.concat(F.lit("$"), F.col("valor_a_pagar").cast("string")))
    order = [F.desc("fecha"), "numero", "t"]
    few = O.top_k(f.withColumn("t", text), ["id_contrato"], order, k, "_r").select("id_contrato", "fecha", "numero", "t")
    few = with_process(few, contracts)
    lists = O.top_list(few, ["process_id"], order, k, "t", "detalle")
    last = O.latest(few, ["process_id"], order).select("process_id", F.col("t").alias("ultima"))
    out = sums.join(last, "process_id", "left").join(lists, "process_id", "left")
    return out


def progress(contracts: DataFrame, e: DataFrame, s: DataFrame) -> DataFrame:
    per = e.groupBy("id_contrato").agg(
        F.max("avance_real").alias("r"), F.max("avance_esperado").alias("x"),
        F.max("entrega_real").alias("er"), F.max("entrega_esperada").alias("ee"))
    real = with_process(per, contracts).groupBy("process_id").agg(
        F.max("r").alias("avance_real"), F.max("x").alias("avance_esperado"),
        F.max("er").alias("entrega_real"), F.max("ee").alias("entrega_esperada"))
    order = F.struct("fecha_creacion", "tipo", "proposito")
    sus = s.groupBy("id_contrato").agg(F.count("*").alias("n"), F.max(F.when(F.col("fecha_creacion").isNotNull(), order)).alias("u"))
    sus = with_process(sus, contracts).groupBy("process_id").agg(F.sum("n").alias("suspensiones"), F.max("u").alias("u"))
    out = real.join(sus, "process_id", "full")
    return out.select(
        "process_id", "avance_real", "avance_esperado",
        (F.col("avance_esperado") - F.col("avance_real")).cast("decimal(10,2)").alias("brecha"),
        "entrega_real", "entrega_esperada", F.coalesce("suspensiones", F.lit(0)).alias("suspensiones"),
        F.col("u.tipo").alias("tipo_suspension"), F.col("u.proposito").alias("proposito"),
        F.concat_ws(" - ", F.col("u.fecha_creacion").cast("string"), "u.tipo").alias("ultima_suspension"),
    )


def process_edits(m: DataFrame, k: int = 5) -> DataFrame:
    text = F.concat_ws(" ", F.date_format("ultima", "yyyy-MM-dd'T'HH:mm:ss"), "descripcion")
    sums = m.groupBy("process_id").agg(F.count("*").alias("ediciones"), F.max("ultima").alias("ultima"))
    lists = O.top_list(m, ["process_id"], [F.desc("ultima"), F.desc("seq")], k, text, "detalle")
    return sums.join(lists, "process_id", "left")


def document_counts(docs: DataFrame, category: Column, k: int = 8) -> DataFrame:
    """Documents per category and the newest k amendments and legalizations."""
    d = docs.withColumn("cat", category)
    cats = ["modificatorios", "legalizaciones", "actas", "informes", "pliegos", "otros"]
    counts = d.groupBy("process_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("cat") == c).alias(c) for c in cats])
    text = F.concat(F.col("nombre"), F.lit(" ("), F.col("fecha").cast("string"), F.lit(")"))
    out = counts
    for c in cats[:2]:
        part = O.top_list(d.where(F.col("cat") == c), ["process_id"], [F.desc("fecha"), F.desc("nombre")], k, text, f"lista_{c}")
        out = out.join(part, "process_id", "left")
    return out


def whole_lists(contracts: DataFrame, g: DataFrame, f: DataFrame, edits: DataFrame, docs: DataFrame, category: Column, cell: int = 256) -> DataFrame:
    """The lists of A3, A4, A6 and A7 in full: ``(process_id, lista, part, texto)``.

    Policies by end date, the others newest first, equal dates by their text; ``cell`` texts a part, so
    nothing is left out and no cell is unbounded.  The rollups keep the first few for a single row.
    """
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    row = lambda d, name, at, text: d.select("process_id", F.lit(name).alias("lista"), F.coalesce(at, F.lit(1 << 40)).alias("o"), text.alias("t"))
    own = lambda d: with_process(d, contracts)
    policy = F.concat_ws("", "tipo", F.lit(" "), "aseguradora", F.lit(" #"), "numero", F.lit(" ("), "estado", F.lit(", vence "), F.col("fecha_fin").cast("string"), F.lit(")"))
    invoice = F.concat_ws(" ", F.col("fecha").cast("string"), F.concat(F.lit("#"), "numero"), "estado", F.concat(F.lit("$"), F.col("valor_a_pagar").cast("string")))
    edit = F.concat_ws(" ", F.date_format("ultima", "yyyy-MM-dd'T'HH:mm:ss"), "descripcion")
    named = docs.withColumn("lista", category).where("lista in ('modificatorios', 'legalizaciones')")
    parts = [row(own(g.select("id_contrato", "tipo", "aseguradora", "numero", "estado", "fecha_fin")), "polizas", day("fecha_fin"), policy),
             row(own(f.select("id_contrato", "fecha", "numero", "estado", "valor_a_pagar")), "facturas", -day("fecha"), invoice),
             row(edits, "ediciones", -F.unix_micros(F.col("ultima").cast("timestamp")), edit),
             named.select("process_id", "lista", F.coalesce(-day("fecha"), F.lit(1 << 40)).alias("o"), F.concat_ws("", "nombre", F.lit(" ("), F.col("fecha").cast("string"), F.lit(")")).alias("t"))]
    per = lambda d, name: own(d.groupBy("id_contrato").agg(F.count("*").alias("n"))).groupBy("process_id").agg(F.sum("n").alias("n")).withColumn("lista", F.lit(name))
    sizes = [per(g, "polizas"), per(f, "facturas"), edits.groupBy("process_id").agg(F.count("*").alias("n")).withColumn("lista", F.lit("ediciones")),
             named.groupBy("process_id", "lista").agg(F.count("*").alias("n"))]
    return O.listing(reduce(DataFrame.unionByName, parts), ["process_id", "lista"], "t", "texto", by="o", cell=cell, repeats=True,
                     sizes=reduce(DataFrame.unionByName, sizes))


# ---- Budget (A8) ------------------------------------------------------------


def budget(contracts: DataFrame, additions: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Initial, additions, reductions, total and paid share, in exact decimals.

    With ``labels`` the vocabularies of those addition columns come along.
    """
    add = child_rollup(additions, contracts, labels or [], {
        "adiciones": (F.sum(F.when(F.col("valor") > 0, F.col("valor"))), F.sum),
        "reducciones": (F.sum(F.when(F.col("valor") <= 0, -F.col("valor"))), F.sum)}, few=True)
    s = contracts.groupBy("process_id").agg(total("valor").alias("inicial"), total("valor_pagado").alias("pagado"))
    zero = F.lit(0).cast(TOTAL)
    s = s.join(add, "process_id", "left").withColumns({c: F.coalesce(F.col(c).cast(TOTAL), zero) for c in ("adiciones", "reducciones")})
    s = s.withColumn("total", (F.col("inicial") + F.col("adiciones") - F.col("reducciones")).cast(TOTAL))
    return s.withColumn("avance_pct", F.when(F.col("inicial") > 0, percent_of("pagado", "total")))


# ---- Entity, recency and freshness views (A16-A21, A29) ---------------------


def entity_counts(processes: DataFrame, contracts: DataFrame, integrated: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of counters; notices are counted once over both sources."""
    p = processes.agg(F.count("*").alias("procesos"), F.count_if(F.lower("adjudicado").isin("si", "sí")).alias("adjudicados"))
    c = contracts.agg(F.count("*").alias("contratos"), F.count_if(fold("estado") == "EN EJECUCION").alias("en_ejecucion"))
    n = contracts.select("notice_id").unionByName(integrated.select("notice_id"))
    count = F.approx_count_distinct("notice_id", 0.01) if approximate else F.count_distinct("notice_id")
    rows = p.unionByName(c, allowMissingColumns=True).unionByName(n.agg(count.alias("avisos")), allowMissingColumns=True)
    return rows.agg(*[F.max(x).alias(x) for x in rows.columns])


def recency_key() -> Column:
    return F.coalesce("fecha_notificacion", "fecha_actualizacion", "fecha_fin")


def recent_amendments(contracts: DataFrame, n: int = 20, mode: str = "recency") -> DataFrame:
    """Newest amended contracts, each row carrying the totals over all amended ones."""
    if mode == "recency":
        hit, order = (F.col("estado") == "Modificado") | (F.col("dias_adicionados") > 0), recency_key()
    elif mode == "signed":
        hit, order = F.col("estado").rlike("(?iu)modific") | (F.col("dias_adicionados") > 0), F.col("fecha_firma")
    else:
        raise ValueError("mode is 'recency' or 'signed'")
    m = contracts.where(hit).withColumn("recencia", order)
    head = O.first_rows(m, [F.desc_nulls_last("recencia"), "seq"], n)
    return head.select(
        "id_contrato", "estado", "dias_adicionados", "fecha_firma", "recencia",
        m.agg(F.count("*")).scalar().alias("total_modificados"),
        m.agg(F.sum("dias_adicionados")).scalar().alias("total_dias"),
        m.agg(F.max("recencia")).scalar().alias("ultimo"))


def coverage(unified: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("data_source") == s)
    out = unified.agg(F.count("*").alias("total"), n("api").alias("api"), n("integrado").alias("integrado"),
                      n("portal").alias("portal"), n("none").alias("sin_fuente"))
    pct = lambda c: F.when(F.col("total") > 0, F.floor(c * 100 / F.col("total") + 0.5)).otherwise(0).cast("bigint")
    reliable, seen = F.col("api") + F.col("portal"), F.col("api") + F.col("portal") + F.col("integrado")
    return out.select("*", reliable.alias("confiable"), seen.alias("detectado"),
                      pct(reliable).alias("pct_confiable"), pct(seen).alias("pct_detectado"))


def freshness(df: DataFrame, as_of: str) -> DataFrame:
    return df.agg(F.max("fecha_firma").alias("ultima_firma")).select(
        "ultima_firma", F.datediff(F.lit(as_of).cast("date"), "ultima_firma").alias("dias_desde"))


def attention_stats(df: DataFrame) -> DataFrame:
    """Counters over distinct processes; flags ``modificado`` and ``vence`` per row."""
    key = F.coalesce("process_id", "url", F.lit(""))
    need = df.where(F.col("modificado") | F.col("vence")).groupBy(key.alias("k")).agg(
        F.max("modificado").alias("m"), F.max("vence").alias("v"))
    return need.agg(F.count("*").alias("total"), F.count_if("m").alias("modificados"), F.count_if("v").alias("por_vencer"))


def last_activity(log: DataFrame) -> DataFrame:
    at = lambda op: F.max(F.when(F.col("op") == op, F.col("ts")))
    out = log.agg(at("fill").alias("ultimo_fill"), at("replace").alias("ultimo_replace"),
                  at("verify_drift").alias("ultima_verificacion"), F.count("*").alias("total_operaciones"))
    return out.withColumn("ultima_consulta", F.greatest("ultimo_fill", "ultimo_replace", "ultima_verificacion"))


def run_report(rows: DataFrame) -> DataFrame:
    """Totals of a run from the amendment summary and its not-found marks."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if("encontrado").alias("ok"),
        F.count_if(F.col("hubo") == "Sí").alias("con_modificatorio"),
        F.count_if(F.col("encontrado") & (F.col("hubo") == "No")).alias("sin_modificatorio"),
        F.count_if(~F.col("encontrado")).alias("errores"))
