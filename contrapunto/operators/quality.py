"""Checks (Q*).  They emit issue rows and never remove or block data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapunto import schemas as S
from contrapunto.functions.dates import norm_date
from contrapunto.functions.identifiers import check_digit, taxid_match
from contrapunto.functions.money import money_close, parse_money
from contrapunto.functions.similarity import jaro_winkler
from contrapunto.functions.text import col, norm_words, squeeze
from contrapunto.operators.ordering import date_order_breaks


def issue(cond: Column, rule: str, column: str, severity: str, detail: Column) -> Column:
    return F.when(cond, F.struct(F.lit(rule).alias("regla"), F.lit(column).alias("columna"), F.lit(severity).alias("severidad"), detail.cast("string").alias("detalle")))


def emit(df: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    found = F.array_compact(F.array(*checks))
    return df.select(*keys, F.explode(found).alias("_x")).select(*keys, "_x.*")


def check_dates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Years outside 1990..2100 and neighbours out of order (both dates present)."""
    checks = []
    for c in order:
        checks.append(issue(F.year(c) < 1990, "anio_antiguo", c, "warn", F.year(c)))
        checks.append(issue(F.year(c) > 2100, "anio_futuro", c, "warn", F.year(c)))
    for a, b in zip(order, order[1:]):
        checks.append(issue(F.col(b) < F.col(a), "orden_fechas", b, "warn", F.concat_ws(" < ", F.col(b).cast("string"), F.col(a).cast("string"))))
    return emit(df, keys, checks)


def check_arithmetic(df: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """Negative amounts, and initial + additions - reductions against the total."""
    zero = F.lit(0).cast("decimal(18,2)")
    expected = F.col("inicial") + F.coalesce("adiciones", zero) - F.coalesce("reducciones", zero)
    return emit(df, keys, [
        issue(F.col("inicial") < 0, "monto_negativo", "inicial", "warn", F.col("inicial")),
        issue(F.col("total") < 0, "monto_negativo", "total", "warn", F.col("total")),
        issue(F.abs(expected - F.col("total")) > tolerance, "aritmetica", "total", "warn", expected.cast("decimal(38,2)")),
    ])


def check_taxid(df: DataFrame, keys: list[str], number: str, digit: str, kind: str | None = None) -> DataFrame:
    """6-11 digits, matching check digit, and no digit for other document kinds."""
    s = F.regexp_replace(F.trim(F.col(number).cast("string")), r"[-. ]", "")
    is_nit = F.lit(True) if kind is None else F.coalesce(F.upper(kind) == "NIT", F.lit(True))
    shaped, has_digit = s.rlike(r"^\d{6,11}$"), F.coalesce(F.trim(digit), F.lit("")) != ""
    present = F.coalesce(s, F.lit("")) != ""
    return emit(df, keys, [
        issue(present & ~shaped & is_nit, "formato", number, "warn", s),
        issue(present & shaped & ~is_nit & has_digit, "digito_sobrante", digit, "warn", F.col(digit)),
        issue(present & shaped & is_nit & has_digit & (F.trim(digit) != check_digit(s)), "digito", digit, "warn", F.concat_ws(" != ", digit, check_digit(s))),
    ])


def check_percent(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return emit(df, keys, [issue(~F.col(c).between(0, 100), "porcentaje", c, "warn", F.col(c)) for c in columns])


# ---- Source against source (Q6-Q10) -----------------------------------------


def _differs(kind: str, a: Column, b: Column) -> Column:
    if kind == "exact_ci":
        return F.lower(F.trim(squeeze(a))) != F.lower(F.trim(squeeze(b)))
    if kind in ("money", "money_soft"):
        x, y = parse_money(a, "auto"), parse_money(b, "auto")
        return ~money_close(x, y, 0.01 if kind == "money" else 0.20, "second")
    if kind == "mods_count":
        x, y = parse_money(a, "plain"), parse_money(b, "plain")
        return (F.coalesce(x, F.lit(0)) == 0) & (F.coalesce(y, F.lit(0)) > 1)
    if kind == "fuzzy_name":
        x, y = F.lower(F.trim(squeeze(a))), F.lower(F.trim(squeeze(b)))
        return (x != "") & (y != "") & (jaro_winkler(x, y) < 0.85)
    if kind == "taxid":
        return ~taxid_match(a, b)
    raise ValueError(f"unknown rule kind {kind!r}")


def check_pairs(df: DataFrame, keys: list[str], rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(column a, column b, kind)``; absent values are skipped, zero is compared."""
    checks = []
    for a, b, kind in rules:
        x, y = F.col(a).cast("string"), F.col(b).cast("string")
        present = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
        checks.append(issue(present & F.coalesce(_differs(kind, x, y), F.lit(False)), kind, a, "warn", F.concat_ws(" vs ", x, y)))
    return emit(df, keys, checks)


def check_internal(df: DataFrame, keys: list[str], rules: list[tuple[str, str, str]], dates: list[str]) -> DataFrame:
    pairs = check_pairs(df, keys, rules)
    breaks = df.select(*keys, F.explode(date_order_breaks(dates)).alias("detalle"))
    return pairs.unionByName(breaks.select(*keys, F.lit("orden_fechas").alias("regla"), F.lit("fechas").alias("columna"), F.lit("warn").alias("severidad"), "detalle"))


def text_match(a, b, share: float = 0.85) -> Column:
    """Equal, one inside the other, or enough of the smaller word set shared."""
    a, b = norm_words(a), norm_words(b)
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    both = F.size(F.array_intersect(wa, wb))
    enough = both >= F.lit(share) * F.least(F.size(wa), F.size(wb))
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a) | enough)


def source_values(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per id with the normalised value, date and supplier of every source.

    Each frame brings ``(id_contrato, valor, fecha, proveedor)``; one shuffle on the
    id stacks them, and the pairs to compare are a fixed set of columns.
    """
    rows = reduce(DataFrame.unionByName, [
        d.select("id_contrato", F.lit(s).alias("src"), col("valor").cast("decimal(18,2)").alias("valor"), "fecha", "proveedor") for s, d in frames.items()])
    # one whole row per source (the latest, then the largest), never columns of different rows
    picks = [F.max(F.when(F.col("src") == s, F.struct("fecha", "valor", "proveedor"))).alias(s) for s in frames]
    return rows.groupBy("id_contrato").agg(*picks).select("id_contrato", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in frames for c in ("valor", "fecha", "proveedor")])


def cross_check(values: DataFrame, sources: list[str], tolerance: float = 0.005) -> DataFrame:
    """Disagreements of every source pair on value, date and supplier, with the gap in %."""
    checks = []
    for i, a in enumerate(sources):
        for b in sources[i + 1:]:
            va, vb = F.col(f"valor_{a}"), F.col(f"valor_{b}")
            larger = F.greatest(F.abs(va), F.abs(vb))
            gap = F.when(larger > 0, F.bround(F.abs(va - vb).cast("double") * 100 / larger.cast("double"), 2)).otherwise(0.0)

            def row(field, cond, x, y, pct):
                return F.when(cond, F.struct(F.lit(field).alias("campo"), F.lit(a).alias("fuente_a"), x.cast("string").alias("valor_a"),
                                             F.lit(b).alias("fuente_b"), y.cast("string").alias("valor_b"), pct.cast("decimal(9,2)").alias("diff_pct")))

            no = F.lit(None).cast("double")
            fa, fb, pa, pb = F.col(f"fecha_{a}"), F.col(f"fecha_{b}"), F.col(f"proveedor_{a}"), F.col(f"proveedor_{b}")
            checks.append(row("valor", ~money_close(va, vb, tolerance, "larger"), va, vb, gap))
            checks.append(row("fecha", fa != fb, fa, fb, no))
            checks.append(row("proveedor", ~text_match(pa, pb) & (F.trim(pa) != "") & (F.trim(pb) != ""), pa, pb, no))
    found = F.array_compact(F.array(*checks))
    return values.select("id_contrato", F.explode(found).alias("_x")).select("id_contrato", "_x.*")


def discrepancy_stats(d: DataFrame, critical: float = 50) -> DataFrame:
    per = d.groupBy("campo", "id_contrato").agg(F.count("*").alias("n"), F.count_if(F.col("diff_pct") > critical).alias("c"))
    return per.groupBy("campo").agg(F.sum("n").alias("discrepancias"), F.count("*").alias("afectados"), F.sum("c").alias("criticas"))


# ---- Coverage audit (Q11, A27), verdict (Q12) -------------------------------


def audit_items(items: DataFrame) -> DataFrame:
    """The 13 coverage checks of every watched item.

    Expects ``process_id, notice_id, url, data_source, ref, fecha_firma, vigencia,
    sheet`` and the presence marks ``en_portal_n, en_portal_p, en_integrado,
    en_enlace`` (the id appears inside a link of another key).
    """
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    src = lambda s: F.col("data_source") == s
    pid = F.col("process_id")
    draft = pid.startswith("CO1.REQ.") | pid.startswith("CO1.BDOS.")
    none = F.lit(None).cast("string")
    return emit(items, ["item"], [
        issue(~pid.rlike(r"^CO1\.[A-Z]+\.\d+$"), "01_formato", "process_id", "warn", pid),
        issue(F.col("datos_manuales").isNotNull(), "02_fuga", "datos_manuales", "fp", none),
        issue(src("none") & has("en_enlace"), "03_indice", "url", "fn", pid),
        issue(src("api") & F.col("ref").isNull(), "04_api_sin_id", "ref", "fp", none),
        issue(src("integrado") & F.col("ref").isNull(), "05_integrado_sin_enlace", "ref", "fp", none),
        issue(src("portal") & F.col("ref").isNull(), "06_portal_sin_campos", "ref", "fp", none),
        issue(src("none") & has("en_portal_n"), "07_aviso_en_portal", "notice_id", "fn", F.col("notice_id")),
        issue(src("none") & has("en_portal_p"), "08_proceso_en_portal", "process_id", "fn", pid),
        issue(src("api") & has("en_integrado"), "09_tambien_integrado", "data_source", "info", none),
        issue(src("api") & (F.year("fecha_firma").cast("string") != F.col("vigencia")), "10_vigencia", "vigencia", "warn", F.concat_ws(" != ", "vigencia", F.year("fecha_firma"))),
        issue(F.col("sheet").isNull(), "11_sin_apariciones", "sheet", "warn", none),
        issue(~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "12_no_https", "url", "warn", F.left("url", F.lit(60))),
        issue(src("none") & pid.isNotNull() & ~draft, "13_captura", "process_id", "scrape", none),
    ])


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severidad").agg(F.count("*").alias("n"))


def verdict(note, api, docs, source: str = "fuente") -> Column:
    """Three signals to one label; only a note nobody confirms needs a person.

    ``docs_dice_si_api_no`` is part of the label set but cannot occur.
    """
    note, api, docs = col(note), col(api), col(docs)
    said = api | docs
    return (F.when(~note & ~said, "concuerdan_sin_modif").when(note & ~api & docs, "api_atrasado_docs_y_nota_si")
            .when(note & said, "concuerdan_con_modif").when(said, f"{source}_dice_si_nota_no").otherwise(f"nota_dice_si_{source}_no"))


def audit_verdicts(rows: DataFrame, source: str = "fuente") -> DataFrame:
    """``valido`` false marks rows whose link could not be read."""
    v = F.when(~F.col("valido"), "no_aplicable").otherwise(verdict("nota", "api", "docs", source))
    return rows.withColumn("veredicto", v).withColumn("revisar", F.col("veredicto") == f"nota_dice_si_{source}_no")


# ---- Portal checks (Q13, Q15, Q16), pinned items (Q17) ----------------------


def completeness(portal: DataFrame, critical: list[str] = S.CRITICAL_FIELDS) -> DataFrame:
    """Missing critical fields of a flat snapshot and the status they imply."""
    gone = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in critical]))
    return portal.withColumn("faltantes", F.array_join(gone, ", ")).withColumn(
        "estado_captura", F.when(F.size(gone) == 0, "ok_completo").otherwise("ok_parcial"))


def stamp_missing(portal: DataFrame, stamp: str) -> DataFrame:
    changed = F.col("scraped_at").isNull() | (F.coalesce("status", F.lit("")) == "")
    return portal.withColumn("sellado", changed).withColumns({
        "scraped_at": F.coalesce("scraped_at", F.lit(stamp).cast("date")), "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("ok_completo"))})


def portal_status(portal: DataFrame) -> DataFrame:
    return portal.groupBy(F.coalesce("status", F.lit("(sin status)")).alias("status")).agg(
        F.count("*").alias("capturas"), F.count_if(F.col("n_docs") > 0).alias("con_documentos"),
        F.count_if(F.col("n_docs") == 0).alias("sin_documentos"), F.sum("n_docs").alias("documentos"))


def gates(portal: DataFrame, watch: DataFrame, expected_items: int, portal_floor: int, min_share: float = 0.7) -> DataFrame:
    """One row per gate: documents share, expected watch size, snapshot floor."""
    p = portal.agg(F.count("*").alias("n"), F.count_if(F.col("n_docs") > 0).alias("d"))
    w = watch.agg(F.count("*").alias("n"))
    row = lambda g, ok, detail: F.struct(F.lit(g).alias("gate"), ok.alias("passed"), detail.cast("string").alias("detail"))
    pg = p.select(F.explode(F.array(
        row("documentos", F.col("d") >= F.lit(min_share) * F.col("n"), F.concat_ws("/", "d", "n")),
        row("capturas", F.col("n") >= portal_floor, F.col("n")))).alias("x")).select("x.*")
    wg = w.select(row("lista", F.col("n") == expected_items, F.col("n")).alias("x")).select("x.*")
    return pg.unionByName(wg)


def check_pinned(cascaded: DataFrame, expected: DataFrame) -> DataFrame:
    """Listed items against the source they must resolve to (``none`` included)."""
    d = expected.join(cascaded.select("item", "data_source"), "item", "left")
    got = F.coalesce("data_source", F.lit("none"))
    return d.select("item", "esperado", got.alias("obtenido"), (got == F.col("esperado")).alias("cumple"))


def source_row(df: DataFrame, value, date, supplier, money_mode: str | None = None) -> DataFrame:
    """A source's rows in the shape ``source_values`` takes."""
    v = col(value) if money_mode is None else parse_money(value, money_mode)
    d = col(date)
    d = norm_date(date) if money_mode is not None else d
    return df.select("id_contrato", v.alias("valor"), d.alias("fecha"), col(supplier).alias("proveedor"))
