"""Sinks (K*): fills, snapshots, published indexes, exports and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrapunto.functions.identifiers import contract_id, notice_id
from contrapunto.operators import ordering as O


def apply_fills(ledger: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Changed cells only: known columns take the new value where there is one.

    Fill columns the ledger lacks are appended on the right.
    """
    renamed = fills.select(*keys, *[F.col(c).alias("_new_" + c) for c in fills.columns if c not in keys])
    d = ledger.join(renamed, keys, "left")
    old = [F.coalesce(F.col("_new_" + c), F.col(c)).alias(c) if c in fills.columns and c not in keys else F.col(c) for c in ledger.columns]
    new = [F.col("_new_" + c).alias(c) for c in fills.columns if c not in ledger.columns]
    return d.select(*old, *new)


def pivot_fills(decided: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long fills to one row per key over a fixed column list."""
    return decided.groupBy(*keys).agg(*[F.max(F.when(F.col("columna") == c, F.col("nuevo"))).alias(c) for c in columns])


def rebuild(ledger: DataFrame, fills: DataFrame, keys: list[str], internal: list[str]) -> DataFrame:
    """Clean re-export: internal columns stay, every derivable one comes from the fills."""
    return ledger.select(*keys, *internal).join(fills.select(*keys, *[c for c in fills.columns if c not in keys and c not in internal]), keys, "left")


def save_snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """Snapshot of one day; a second run on the same day replaces only that day."""
    (df.withColumn("stamp", F.lit(stamp)).write.partitionBy("stamp").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def previous_snapshot(snapshots: DataFrame, before: str) -> DataFrame:
    """Rows of the newest snapshot strictly before a stamp; reads that partition only."""
    last = snapshots.where(F.col("stamp") < before).agg(F.max("stamp")).scalar()
    return snapshots.where(F.col("stamp") == last)


def _summary(columns: list[str]) -> Column:
    pairs = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))
    entries = F.array_sort(F.map_entries(kept))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def publish_index(rows: DataFrame, url: str, number: str, seq: str, columns: list[str]) -> DataFrame:
    """Summaries by notice id and by contract id; the last row of a key wins."""
    number_key = F.when(F.col(number).startswith("CO1.PCCNTR."), F.col(number))
    keys = F.array(F.struct(F.lit("notice").alias("clase"), notice_id(url).alias("clave")),
                   F.struct(F.lit("contrato").alias("clase"), number_key.alias("clave")))
    d = rows.withColumn("_k", F.explode(keys)).where("_k.clave is not null").select("*", "_k.clase", "_k.clave")
    last = O.latest(d, ["clase", "clave"], [F.desc(seq)])
    return last.select("clase", "clave", _summary(columns).alias("resumen"))


def keyless(rows: DataFrame, url: str, number: str) -> DataFrame:
    return rows.where(notice_id(url).isNull() & contract_id(number).isNull() & contract_id(url).isNull())


SOURCE_LABELS = {"api": "Datos abiertos", "integrado": "Integrado", "portal": "Portal (copia)"}


def export_view(u: DataFrame) -> DataFrame:
    """The 16 curated columns of the download."""
    label = reduce(lambda acc, kv: acc.when(F.col("data_source") == kv[0], kv[1]), SOURCE_LABELS.items(), F.when(F.lit(False), ""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return u.select(
        text("vigencia").alias("Vigencia"), text("sheet").alias("Hoja"), text("referencia").alias("Numero Contrato"),
        text("process_id").alias("Process ID"), text("notice_id").alias("Notice UID"), text("objeto").alias("Objeto"),
        text("proveedor").alias("Proveedor"), F.col("valor").alias("Valor (COP)"), text("fecha_firma").alias("Fecha de firma"),
        text("estado").alias("Estado"), text("modalidad").alias("Modalidad"), F.col("dias_adicionados").alias("Dias adicionados"),
        F.when(F.lower("liquidacion") == "si", "Si").otherwise("No").alias("Liquidado"), text("notas").alias("Notas"),
        label.otherwise("Sin datos publicos").alias("Origen del dato"), text("url").alias("URL del proceso"))


def raw_columns(portal: DataFrame, maps: dict[str, str]) -> DataFrame:
    """The union of all map keys as prefixed column names: a distributed distinct."""
    keys = [portal.select(F.explode(F.map_keys(c)).alias("k")).select(F.concat(F.lit(prefix + "."), "k").alias("columna")) for c, prefix in maps.items()]
    return reduce(DataFrame.unionByName, keys).distinct()


def export_raw(portal: DataFrame, ids: list[str], maps: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Wide dump: a column for each of ``columns`` (default: all ``raw_columns``), looked up in the row's own maps.

    Rows are not shuffled.  The names of the columns are part of the plan, so by default they come to
    the driver; a caller with very many passes the wanted ones, or reads ``raw_columns`` in parts.
    """
    names = sorted(r["columna"] for r in raw_columns(portal, maps).collect()) if columns is None else columns
    own = {prefix: c for c, prefix in maps.items()}

    def cell(name: str) -> Column:
        prefix = next(p for p in sorted(own, key=len, reverse=True) if name.startswith(p + "."))
        return F.try_element_at(F.col(own[prefix]), F.lit(name.removeprefix(prefix + "."))).alias(name)

    return portal.select(*ids, *[cell(n) for n in names])


def audit_report(verdicts: DataFrame) -> dict[str, DataFrame]:
    """KPIs with the verdict counts, the detail, and only the rows a person must read."""
    kpis = verdicts.groupBy("veredicto").agg(F.count("*").alias("filas"), F.max("revisar").alias("requiere_revision"))
    return {"resumen": kpis, "detalle": verdicts, "alertas": verdicts.where("revisar")}
