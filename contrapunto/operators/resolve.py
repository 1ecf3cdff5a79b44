"""Key resolution and joins (J*, P5).

Substring and OR lookups are rewritten to equi-joins on ids extracted once per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrapunto.functions.identifiers import contract_id, id_kind, infer_process_id, link_id, notice_id
from contrapunto.operators import ordering as O


def resolve_pivot(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pivot ids to notices through the landed mapping; misses are kept as misses."""
    m = mapping.select(F.col("pivot_id").alias("process_id"), F.col("notice").alias("_n"), F.lit(True).alias("_seen"))
    d = links.join(m, "process_id", "left")
    state = (F.when(id_kind("process_id") != "PPI", "no_pivote").when(F.col("_n").isNotNull(), "resuelto")
             .when(F.col("_seen"), "sin_aviso").otherwise("sin_captura"))
    return d.withColumn("notice", F.when(id_kind("process_id") == "PPI", F.col("_n"))).withColumn("via", state).drop("_n", "_seen")


def pivot_mapping(pages: DataFrame, pivot: str, html: str) -> DataFrame:
    return pages.groupBy(F.col(pivot).alias("pivot_id")).agg(F.min(notice_id(html)).alias("notice"))


def process_contracts(p: DataFrame, c: DataFrame) -> DataFrame:
    """Contracts of a process: same portfolio, or its notice inside the contract link.

    Two equi-joins instead of an OR: the notice join skips pairs the portfolio join
    already gives, so no duplicate removal over the result is needed.
    """
    left = p.select("process_id", F.col("portfolio").alias("p_portfolio"))
    d = c.withColumn("notice", notice_id("url"))
    one = left.join(d, F.col("p_portfolio") == F.col("portfolio")).withColumn("via", F.lit("portafolio"))
    two = left.join(d, left["process_id"] == F.col("notice"))
    two = two.where("portfolio is null or portfolio <> p_portfolio").withColumn("via", F.lit("aviso"))
    cols = [left["process_id"].alias("process_id"), "id_contrato", "via"]
    return one.select(*cols).unionByName(two.select(*cols))


def lookup_process(links: DataFrame, p: DataFrame) -> DataFrame:
    """Exact id, then resolved notice in the link, then raw id in the link; first hit wins."""
    link_keys = p.select("id_del_proceso", F.col("url").alias("p_url"))
    exact = link_keys.select(F.col("id_del_proceso").alias("pid"), F.col("id_del_proceso").alias("hit1")).dropDuplicates(["pid"])
    by_notice = link_keys.groupBy(notice_id("p_url").alias("notice")).agg(F.min("id_del_proceso").alias("hit2"))
    by_token = link_keys.groupBy(infer_process_id("p_url").alias("pid")).agg(F.min("id_del_proceso").alias("hit3"))
    d = links.join(exact, "pid", "left").join(by_notice.where("notice is not null"), "notice", "left").join(by_token.where("pid is not null"), "pid", "left")
    tier = F.when(F.col("hit1").isNotNull(), 1).when(F.col("hit2").isNotNull(), 2).when(F.col("hit3").isNotNull(), 3)
    return d.withColumn("encontrado", F.coalesce("hit1", "hit2", "hit3")).withColumn("nivel", tier).drop("hit1", "hit2", "hit3")


def contract_children(c: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Row counts and existence of every child table per contract.

    Each child is reduced to its key first; a missing child gives zeros.
    """
    out = c.select("id_contrato", "process_id")
    for name, child in children.items():
        n = child.groupBy("id_contrato").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(n, "id_contrato", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def child_rows(c: DataFrame, children: dict[str, Callable[[], DataFrame]], fields: dict[str, dict[str, str]], as_text: bool = False) -> DataFrame:
    """Every child row of every contract as ``(id_contrato, process_id, hijo, datos, error)``: a tagged union.

    A child is given as a function that reads it, with ``id_contrato`` and either a JSON text ``raw`` or
    columns of its own; ``datos`` is a variant, so children of any shape share the table.  With ``as_text`` it is
    that variant's JSON text; text columns are then written and read as they are, without a variant between.  ``fields``
    names what a child's rows must hold and as which type.  A bad row is kept with its ``error``, and a child that
    cannot be read at all is one row without a contract: neither touches the other children.
    """
    def rows(name: str, read: Callable[[], DataFrame]) -> DataFrame:
        try:
            child = read()
            child.schema  # noqa: B018 - what cannot be resolved fails here
        except AnalysisException as exc:
            missing = c.sparkSession.range(1).select(F.lit(None).cast("string").alias("id_contrato"), F.lit(None).cast("string").alias("datos"))
            return missing.select("id_contrato", F.lit(name).alias("hijo"), (F.col("datos") if as_text else F.parse_json("datos")).alias("datos"), F.lit(f"sin fuente: {exc.getCondition()}").alias("error"))
        plain = [x for x in child.columns if x != "id_contrato"]
        wanted = fields.get(name, {})
        if as_text and plain != ["raw"] and all(child.schema[x].dataType == T.StringType() for x in plain) and set(wanted) <= set(plain):
            data = F.to_json(F.struct(*sorted(plain)), {"ignoreNullFields": "false"})
            d = child.select("id_contrato", data.alias("datos"), *[F.col(f).try_cast(kind).isNull().alias(f"_{i}") for i, (f, kind) in enumerate(wanted.items())])
        else:
            data = F.try_parse_json("raw") if plain == ["raw"] else F.to_variant_object(F.struct(*plain))
            d = child.select("id_contrato", data.alias("datos"))
            d = d.select("id_contrato", (F.to_json("datos") if as_text else F.col("datos")).alias("datos"),
                         *[F.try_variant_get("datos", f"$.{f}", kind).isNull().alias(f"_{i}") for i, (f, kind) in enumerate(wanted.items())])
        bad = [F.when(F.col(f"_{i}"), F.lit(f)) for i, f in enumerate(wanted)]
        wrong = F.array_join(F.array_compact(F.array(*bad)), ", ") if bad else F.lit("")
        error = F.when(F.col("datos").isNull(), F.lit("ilegible")).when(wrong != "", F.concat(F.lit("campos: "), wrong))
        return d.select("id_contrato", F.lit(name).alias("hijo"), "datos", error.alias("error"))

    stacked = reduce(DataFrame.unionByName, [rows(n, read) for n, read in children.items()])
    return stacked.join(c.select("id_contrato", "process_id").hint("shuffle_hash"), "id_contrato", "left").select("id_contrato", "process_id", "hijo", "datos", "error")


# ---- Source cascade (J4-J6) -------------------------------------------------


def _keys_long(watch: DataFrame, keys: list[Column]) -> DataFrame:
    ranked = F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct(F.lit(i).alias("rank"), k.alias("clave"))) for i, k in enumerate(keys)]))
    return watch.select("item", F.explode(ranked).alias("x")).select("item", "x.rank", "x.clave")


def multi_key_lookup(watch: DataFrame, right: DataFrame, keys: list[Column]) -> DataFrame:
    """Best-ranked key of each item that the right side (one row per ``clave``) holds."""
    hits = _keys_long(watch, keys).join(right, "clave")
    payload = F.struct(*[c for c in right.columns if c != "clave"])
    return hits.groupBy("item").agg(F.min(F.struct("rank", "clave", payload.alias("m"))).alias("x")).select("item", "x.rank", "x.clave", "x.m")


def source_keys(contracts: DataFrame, integrated: DataFrame, portal: DataFrame) -> dict[str, DataFrame]:
    """One row per lookup key for the three sources, last row of a key wins."""
    c = contracts.select(F.explode(F.array("id_contrato", "process_id")).alias("clave"), F.col("id_contrato").alias("ref"), "valor", "fecha_firma", "seq")
    i = integrated.select(F.explode(F.array(notice_id("url_contrato"), contract_id("url_contrato"))).alias("clave"),
                          F.col("url_contrato").alias("ref"), "valor", "fecha_firma", "seq")
    p = portal.select(F.col("notice_id").alias("clave"), F.col("titulo").alias("ref"), F.lit(None).cast("decimal(18,2)").alias("valor"),
                      F.col("scraped_at").alias("fecha_firma"), "seq")
    keep = lambda d: O.latest(d.where("clave is not null"), ["clave"], [F.desc("seq")]).drop("seq")
    return {"api": keep(c), "integrado": keep(i), "portal": keep(p)}


def cascade(watch: DataFrame, sources: dict[str, DataFrame], priority: list[str] = ("api", "portal", "integrado")) -> DataFrame:
    """Source, matched row and its date for every item, by an explicit priority.

    Sources are stacked, so the number of shuffles does not grow with their number.
    """
    unknown = set(priority) - set(sources)
    if unknown:
        raise KeyError(f"unknown sources {sorted(unknown)}")
    stacked = reduce(DataFrame.unionByName, [
        sources[s].withColumns({"src_rank": F.lit(i), "src": F.lit(s)}) for i, s in enumerate(priority)])
    keys = _keys_long(watch, [F.col("process_id"), F.col("notice_id")])
    best = keys.join(stacked, "clave").groupBy("item").agg(
        F.min(F.struct("src_rank", "rank", "clave", "src", "ref", "valor", "fecha_firma")).alias("x"))
    return watch.join(best, "item", "left").select(
        watch["*"], F.coalesce("x.src", F.lit("none")).alias("data_source"), F.col("x.ref").alias("ref"),
        F.col("x.valor").alias("valor"), F.col("x.fecha_firma").alias("fecha_firma"))


# ---- Notes and ledger lookups (J8-J10) --------------------------------------


def notes_for(items: DataFrame, keys: list[Column], notes: DataFrame) -> DataFrame:
    """Notes of an item by any of its keys, each ledger row once."""
    hits = _keys_long(items, keys).select("item", "clave").distinct().join(notes, "clave")
    return hits.groupBy("item", "sheet", "row_no").agg(F.min("text").alias("text"))


def ledger_for(items: DataFrame, keys: list[Column], ledger: DataFrame) -> DataFrame:
    """Ledger row of an item: first key that hits, last sheet and row of that key."""
    last = O.latest(ledger, ["clave"], [F.desc("sheet_ord"), F.desc("row_no")])
    return multi_key_lookup(items, last, keys)


def ledger_keys(ledger: DataFrame, domain: str) -> DataFrame:
    """Every key a ledger row is found by: link, lower link, parsed id."""
    d = ledger.where(F.contains(F.lower("url"), F.lit(domain)))
    keys = F.array_distinct(F.array_compact(F.array("url", F.lower("url"), link_id("url"))))
    return d.withColumn("clave", F.explode(keys))


def enrich_year(items: DataFrame, keys: list[Column], ledger: DataFrame, note: str = "note", pattern: str = r"hoja\s+(\d{4})") -> DataFrame:
    """Fiscal year and sheet from the ledger, else from the item's note."""
    hit = ledger_for(items, keys, ledger).select("item", F.col("m.vigencia").alias("v"), F.col("m.sheet").alias("s"))
    year = F.nullif(F.regexp_extract(F.col(note), pattern, 1), F.lit(""))
    d = items.join(hit, "item", "left")
    via = F.when(F.col("s").isNotNull(), "ledger").when(year.isNotNull(), "nota").otherwise("sin_dato")
    return d.select("item", F.when(F.col("s").isNotNull(), F.col("v")).otherwise(year).alias("vigencia_resuelta"),
                    F.coalesce("s", F.concat(F.lit("Hoja "), year)).alias("hoja_resuelta"), via.alias("via"))


# ---- Presence (J11-J14, J16) -------------------------------------------


def multi_source(ids: DataFrame, sources: list[DataFrame], at_least: int = 2) -> DataFrame:
    """Ids present in at least that many sources."""
    keyed = reduce(DataFrame.unionByName, [s.select("clave").distinct().withColumn("src", F.lit(i)) for i, s in enumerate(sources)])
    counts = keyed.groupBy("clave").agg(F.count("*").alias("fuentes"))
    return ids.join(counts, "clave").where(F.col("fuentes") >= at_least)


def still_missing(listed: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """A known-missing list split into still missing and newly covered."""
    seen = reduce(DataFrame.unionByName, [s.select("clave") for s in sources]).distinct().withColumn("_hit", F.lit(True))
    state = F.when(F.col("_hit"), "cubierto").otherwise("sigue_sin_fuente")
    return listed.join(seen, "clave", "left").withColumn("estado", state).drop("_hit")


def orphans(rows: DataFrame, keys: list[Column], watch_keys: DataFrame) -> DataFrame:
    """Source rows without a key, or whose keys no watched item has."""
    known = watch_keys.select(F.col("clave").alias("_w")).where("_w is not null").distinct()
    d = rows.withColumn("_keys", F.array_compact(F.array(*keys)))
    none = d.where(F.size("_keys") == 0).withColumn("motivo", F.lit("sin_clave"))
    matched = d.select("seq", F.explode("_keys").alias("_w")).join(known, "_w", "left_semi").select("seq").distinct()
    rest = d.where(F.size("_keys") > 0).join(matched, "seq", "left_anti").withColumn("motivo", F.lit("sin_seguimiento"))
    return none.unionByName(rest).drop("_keys")


def siblings(contracts: DataFrame) -> DataFrame:
    """Sibling count of every contract; the members are the contracts table itself."""
    n = contracts.groupBy("process_id").agg(F.count("*").alias("n"))
    return contracts.join(n, "process_id").select("process_id", "id_contrato", (F.col("n") - 1).alias("hermanos"))


def siblings_of(picked: DataFrame, contracts: DataFrame) -> DataFrame:
    """Other contracts of the picked contract's process, for one pick per process."""
    one = picked.groupBy("process_id").agg(F.min("id_contrato").alias("elegido"))
    d = contracts.select("process_id", "id_contrato").join(one, "process_id")
    return d.where("id_contrato <> elegido").select("elegido", "process_id", F.col("id_contrato").alias("hermano"))


def siblings_of_all(picked: DataFrame, contracts: DataFrame, cell: int = 256) -> tuple[DataFrame, DataFrame]:
    """Siblings of every pick without listing pairs: (picks, members).

    A pick has its process, its number of siblings and its place: part and position in the members'
    listing, so its siblings are that process's parts without this one entry.  Members are written once
    per process, in parts of ``cell``; both tables are as large as their inputs.
    """
    members = O.listing(contracts, ["process_id"], "id_contrato", "miembros", cell=cell)
    place = O.numbered(contracts.select("process_id", "id_contrato").distinct(), ["process_id"], ["id_contrato"], "pos")
    n = contracts.groupBy("process_id").agg((F.count_distinct("id_contrato") - 1).alias("hermanos"))
    picks = picked.select("process_id", F.col("id_contrato").alias("elegido")).distinct().join(place.withColumnRenamed("id_contrato", "elegido"), ["process_id", "elegido"]).join(n, "process_id")
    return picks.select("elegido", "process_id", "hermanos", F.expr(f"(pos - 1) div {cell}").cast("int").alias("part"), F.expr(f"(pos - 1) % {cell}").cast("int").alias("lugar")), members


def attach_doc_meta(docs: DataFrame, meta: DataFrame) -> DataFrame:
    return docs.join(meta.select("process_id", "doc_id", "nombre", "url"), ["process_id", "doc_id"], "left")
