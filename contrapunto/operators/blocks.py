"""Column blocks derived per process, contract or link."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapunto import schemas as S
from contrapunto.functions.identifiers import link_id, notice_id
from contrapunto.functions.text import null_placeholder
from contrapunto.operators import ordering as O


def extras(df: DataFrame, explicit: list[str], width: int | None = None, total: int | None = None, empty: tuple[str, ...] = S.LIST_PLACEHOLDERS) -> Column:
    """All non-empty undeclared columns as sorted ``k=v`` text, whole unless widths are given (published: 80 and 1500)."""
    names = sorted(c for c in df.columns if c not in explicit and not c.startswith("_"))
    parts = []
    for c in names:
        v = F.col(c).cast("string")
        v = F.when(~v.isin(*empty), F.replace(F.replace(v, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit(" ")))
        parts.append(F.concat(F.lit(c + "="), v if width is None else F.left(v, F.lit(width))))
    text = F.concat_ws(" | ", *parts)
    return text if total is None else F.left(text, F.lit(total))


def not_legalized() -> Column:
    """Signed, not settled, and in no closing state."""
    closed = F.col("estado").rlike("(?iu)Cerrado|Terminado|Liquidad")
    return F.coalesce(F.col("fecha_firma").isNotNull() & (F.lower("liquidacion") != "si") & ~closed, F.lit(False))


def contract_note(legal: bool = True) -> Column:
    return F.concat_ws(
        " · ", F.when(F.contains("estado", F.lit("Modificad")), "Modificado"),
        F.when(F.col("dias_adicionados") > 0, F.concat(F.lit("+"), "dias_adicionados", F.lit(" días"))),
        F.when(not_legalized(), "Sin legalización") if legal else F.lit(None),
        F.when(F.lower(F.trim("liquidacion")) == "si", "Liquidado"))


def contract_flags(df: DataFrame) -> DataFrame:
    modified = F.col("estado").rlike("(?iu)Modificad") | (F.coalesce("dias_adicionados", F.lit(0)) > 0)
    return df.withColumns({"es_modificado": modified, "es_no_leg": not_legalized()})


def is_draft(pid) -> Column:
    return F.coalesce(F.col(pid).startswith("CO1.REQ.") | F.col(pid).startswith("CO1.BDOS."), F.lit(False))


def verify_status(watch: DataFrame, portal_keys: DataFrame) -> DataFrame:
    """internal / verified / draft / not public, decided by the link and the snapshot."""
    keys = portal_keys.select(F.col("notice_id").alias("_n")).distinct().withColumn("_hit", F.lit(True))
    d = watch.withColumn("_n", F.coalesce("notice_id", "process_id")).join(keys, "_n", "left")
    status = (F.when(F.contains("url", F.lit("CO1ContractsManagement")), "contrato_interno").when(F.col("_hit"), "verificado")
              .when(is_draft("process_id"), "borrador").otherwise("no_en_api"))
    return d.withColumn("estado_verificacion", status).drop("_n", "_hit")


def reconcile(watch: DataFrame, processes: DataFrame, contracts: DataFrame) -> DataFrame:
    """Where each watched link was found, as an ordered set of outcomes."""
    d = watch.withColumn("pid", F.coalesce("process_id", link_id("url")))
    d = d.withColumn("ntc", F.coalesce("notice_id", notice_id("url"), F.when(F.col("pid").startswith("CO1.NTC."), F.col("pid"))))
    p = processes.select(F.col("process_id").alias("ntc"), F.col("nombre").alias("objeto_proceso")).dropDuplicates(["ntc"])
    by_id = contracts.select(F.col("id_contrato").alias("pid"), F.col("id_contrato").alias("c_id"))
    by_portfolio = contracts.where("portfolio is not null").groupBy(F.col("portfolio").alias("pid")).agg(F.min_by("id_contrato", "seq").alias("c_id"))
    c = by_id.unionByName(by_portfolio)
    d = d.join(p, "ntc", "left").join(c, "pid", "left")
    status = (F.when(F.col("pid").isNull(), "parse_error").when(is_draft("pid"), "draft_request")
              .when(F.col("ntc").isNotNull() & F.col("objeto_proceso").isNotNull(), "ok_with_notice")
              .when(F.col("ntc").isNotNull(), "ok_no_notice").when(F.col("c_id").isNotNull(), "found_in_contracts").otherwise("not_found"))
    return d.select("url", "pid", F.col("ntc").alias("notice"), status.alias("estado"), "objeto_proceso", F.when(F.col("ntc").isNull(), F.col("c_id")).alias("id_contrato"))


def process_block(p: DataFrame, names: dict[str, str], explicit: list[str]) -> DataFrame:
    """Renamed mirror of the process columns plus the catch-all text."""
    return p.select("process_id", *[null_placeholder(F.col(c).cast("string")).alias(n) for c, n in names.items()],
                    extras(p, explicit).alias("otros_campos"))


def process_mirror(p: DataFrame) -> DataFrame:
    """The published 26-column block of a process, from its source fields as text.

    Numbers lose their thousands commas and trailing zeros, and stay text where they are none; dates
    keep their day; a duration has its unit.
    """
    def cell(source: str, how: str) -> Column:
        v = F.col(source).cast("string")
        if how == "numero":
            n = F.replace(v, F.lit(","), F.lit("")).try_cast("decimal(34,6)").cast("string")
            return F.coalesce(F.regexp_replace(n, r"\.?0+$", ""), v)  # six places: there always is a point
        if how == "fecha":
            return F.left(v, F.lit(10))
        if how == "duracion":
            return F.when(v != "", F.trim(F.concat_ws(" ", v, F.col("unidad_de_duracion"))))
        return v

    blank = lambda c: F.nullif(c, F.lit(""))
    explicit = ["process_id", *[f for _, f, _ in S.PROCESS_BLOCK], *S.PROCESS_SHOWN]
    return p.select("process_id", *[blank(cell(f, how)).alias(label) for label, f, how in S.PROCESS_BLOCK], blank(extras(p, explicit)).alias(S.PROCESS_EXTRAS))


def contract_block(contracts: DataFrame, cell: int = 256) -> DataFrame:
    """The published 24-column block of a process's contracts, from their source fields as text, in parts.

    Sums read numbers with thousands commas and skip what is none; a sum of nothing is null.  Ids and references
    come as they are, states, suppliers and documents sorted, other values once each in the order of ``seq``.
    Part 0 holds the sums and the first ``cell`` values of every list; what a process has beyond that
    follows in further parts, so no cell is unbounded and nothing is left out.
    """
    text = lambda f: F.col(f).cast("string")
    known = lambda c: F.when(~c.isin("", "No definido", "No Definido"), F.trim(c))
    document = F.when(text("documento_proveedor") != "", F.concat_ws(":", F.nullif(text("tipodocproveedor"), F.lit("")), text("documento_proveedor")))
    shape = {"lista": text, "conjunto": text, "documento": lambda f: document, "valores": lambda f: known(text(f)), "fechas": lambda f: known(F.left(text(f), F.lit(10)))}
    ordered = lambda how: F.lit(0).cast("bigint") if how in ("conjunto", "documento") else F.col("seq").cast("bigint")
    item = lambda label, v, how: F.struct(F.lit(label).alias("campo"), v.alias("v"), ordered(how).alias("o"))
    explicit = ["process_id", "seq", *[f for _, f, _ in S.CONTRACT_BLOCK], *S.CONTRACT_SHOWN]
    others = extras(contracts, explicit, empty=(*S.LIST_PLACEHOLDERS, "0"))
    lists = [item(label, shape[how](f), how) for label, f, how in S.CONTRACT_BLOCK if how in shape] + [item(S.CONTRACT_EXTRAS, others, "lista")]
    whole = [label for label, _, how in S.CONTRACT_BLOCK if how == "lista"] + [S.CONTRACT_EXTRAS]
    labels = [label for label, _, how in S.CONTRACT_BLOCK if how != "suma"] + [S.CONTRACT_EXTRAS]
    money = lambda f: F.sum(F.replace(text(f), F.lit(","), F.lit("")).try_cast("decimal(28,4)")).cast("decimal(38,4)")
    totals = [money(f).alias(label) for label, f, how in S.CONTRACT_BLOCK if how == "suma"]
    whole_row = [F.col(f"`{label}`") for label, _, _ in S.CONTRACT_BLOCK] + [F.col(f"`{S.CONTRACT_EXTRAS}`")]
    large = O.oversized(contracts.groupBy("process_id").agg(F.count("*").alias("n")), ["process_id"], cell)
    # processes of at most ``cell`` contracts in one pass
    few = contracts if large is None else contracts.join(large.withColumnRenamed("process_id", "_k"), F.col("process_id").eqNullSafe(F.col("_k")), "left_anti")
    few = few.select("*", *[x["v"].alias(f"_v{i}") for i, x in enumerate(lists)], F.col("seq").cast("bigint").alias("_o"))
    few = few.groupBy("process_id").agg(F.collect_list(F.struct("_o", *[f"_v{i}" for i in range(len(lists))])).alias("_a"), *totals)

    def cell_of(i: int, label: str, sorted_: bool) -> Column:
        items = F.filter(F.transform("_a", lambda x: F.struct((F.lit(0).cast("bigint") if sorted_ else x["_o"]).alias("o"), x[f"_v{i}"].alias("v"))), lambda x: x["v"] != "")
        return F.nullif(F.array_join(O.in_order(items, label in whole), " | "), F.lit("")).alias(label)

    hows = [how for _, _, how in S.CONTRACT_BLOCK if how in shape] + ["lista"]
    few = few.select("process_id", F.lit(0).cast("bigint").alias("part"), *[cell_of(i, label, how in ("conjunto", "documento")) for i, (label, how) in enumerate(zip(labels, hows))],
                     *[f"`{label}`" for label, _, how in S.CONTRACT_BLOCK if how == "suma"])
    few = few.where(F.coalesce(*[F.col(f"`{label}`") for label in labels]).isNotNull()).select("process_id", "part", *whole_row)
    if large is None:
        return few
    contracts = contracts.join(large.withColumnRenamed("process_id", "_k"), F.col("process_id").eqNullSafe(F.col("_k")), "left_semi")
    long = contracts.select("process_id", F.explode(F.array(*lists)).alias("x")).select("process_id", "x.*")
    parts = O.listing(long.where(F.col("campo").isin(whole)), ["process_id", "campo"], "v", "t", by="o", cell=cell, repeats=True).unionByName(
        O.listing(long.where(~F.col("campo").isin(whole)), ["process_id", "campo"], "v", "t", by="o", cell=cell))
    wide = parts.groupBy("process_id", "part").agg(*[F.max(F.when(F.col("campo") == x, F.col("t"))).alias(x) for x in labels])
    sums = contracts.groupBy("process_id").agg(*totals).withColumn("part", F.lit(0).cast("bigint"))
    d = wide.withColumn("part", F.col("part").cast("bigint")).join(sums, ["process_id", "part"], "left")
    return few.unionByName(d.select("process_id", "part", *whole_row))


def identity_block(p: DataFrame, contracts: DataFrame, places: DataFrame, cell: int = 256) -> DataFrame:
    """Identity columns with the distinct execution addresses, in parts when many."""
    a = contracts.select("id_contrato", "process_id", F.col("seq").alias("cseq")).join(places, "id_contrato")
    a = a.select("process_id", null_placeholder("direccion").alias("d"), F.struct("cseq", "seq").alias("o"))
    lists = O.listing(a, ["process_id"], "d", "direcciones", by="o", cell=cell)
    return p.select(
        "process_id", "fase", "entidad", "nit_entidad", F.col("nombre").alias("objeto"),
        F.concat(F.lit("$"), F.format_number("precio_base", 0)).alias("valor")).join(lists, "process_id", "left")


def portal_block(portal: DataFrame, labels: dict[str, str] = S.PORTAL_LABELS, most: int | None = None) -> DataFrame:
    """Curated label columns, notice and document texts (all, or the first ``most``), counts and missing fields."""
    fields = [F.try_element_at("fields", F.lit(k)).alias("portal_" + k) for k in labels.values()]
    item = lambda n: F.trim(F.concat_ws(" ", n["evento"], n["fecha"]))
    told = lambda c: F.col(c) if most is None else F.slice(c, 1, most)
    return portal.select(
        "notice_id", *fields,
        F.array_join(F.transform(told("notificaciones"), item), " | ").alias("notificaciones_texto"),
        F.coalesce(F.size("notificaciones"), F.lit(0)).alias("notificaciones_n"),
        F.array_join(F.transform(told("documents"), lambda d: d["name"]), " | ").alias("documentos_texto"),
        F.coalesce(F.size("documents"), F.lit(0)).alias("documentos_n"),
        F.array_join("missing_fields", ", ").alias("faltantes"), "status", "scraped_at")


class ColumnGroups:
    """Ordered registry of user column groups, each ``tables -> DataFrame(process_id, cols)``."""

    def __init__(self):
        self._groups: dict[str, tuple[list[str], Callable]] = {}

    def register(self, name: str, columns: list[str], fn: Callable[..., DataFrame]) -> None:
        self._groups[name] = (columns, fn)

    @property
    def names(self) -> list[str]:
        return list(self._groups)

    def enrich(self, base: DataFrame, fields: list[str] | None = None, **tables) -> DataFrame:
        """Left-joins the wanted groups in registration order; an unknown name is an error.

        A group that cannot be built (a missing column or table) yields nulls and its
        reason in ``<name>_error``; the others are not affected.
        """
        unknown = [f for f in fields or [] if f not in self._groups]
        if unknown:
            raise KeyError(f"unknown column groups {unknown}; known: {self.names}")
        out = base
        for name, (columns, fn) in self._groups.items():
            if fields and name not in fields:
                continue
            try:
                part, reason = fn(**tables).select("process_id", *columns), None
            except Exception as exc:  # noqa: BLE001 - isolation is the contract here
                part, reason = None, f"{type(exc).__name__}"
            if part is None:
                out = out.withColumns({c: F.lit(None).cast("string") for c in columns}).withColumn(f"{name}_error", F.lit(reason))
            else:
                out = out.join(part, "process_id", "left")
        return out
