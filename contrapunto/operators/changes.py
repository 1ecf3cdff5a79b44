"""Change detection and merges (U*, H1-H3, H9-H15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapunto.functions.dates import sheet_year
from contrapunto.functions.identifiers import contains_link_of, infer_process_id, link_id, norm_sequence, strip_controls
from contrapunto.functions.text import col
from contrapunto.operators import ordering as O


def added(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.select(key).distinct().join(old.select(key), key, "left_anti")


def removed(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return added(old, new, key)


def common(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.select(key).distinct().join(old.select(key), key, "left_semi")


def _clean(c) -> Column:
    s = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.lower(s) == "nan", "").otherwise(s)


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Added, removed and changed rows, one output row per changed field.

    The snapshots meet once, on the id; only the changed fields are unpivoted.
    """
    side = lambda d, name: d.select(key, F.struct(*[_clean(f).alias(f) for f in fields]).alias(name))
    d = side(old, "o").join(side(new, "n"), key, "full")
    row = lambda kind, f, a, b: F.struct(F.lit(kind).alias("tipo"), f.cast("string").alias("campo"), a.cast("string").alias("antes"), b.cast("string").alias("despues"))
    null = F.lit(None).cast("string")
    fields_changed = F.array_compact(F.array(*[
        F.when(F.col(f"o.{f}") != F.col(f"n.{f}"), row("cambio", F.lit(f), F.col(f"o.{f}"), F.col(f"n.{f}"))) for f in fields]))
    rows = (F.when(F.col("o").isNull(), F.array(row("nuevo", null, null, null)))
            .when(F.col("n").isNull(), F.array(row("eliminado", null, null, null))).otherwise(fields_changed))
    return d.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def summarize_changes(changes: DataFrame, buckets: dict[str, str]) -> DataFrame:
    """Counts per bucket: new, removed, and each field's bucket (fields outside are not counted)."""
    name = F.when(F.col("tipo") != "cambio", F.col("tipo"))
    for f, b in buckets.items():
        name = name.when(F.col("campo") == f, b)
    return changes.withColumn("grupo", name).where("grupo is not null").groupBy("grupo").agg(F.count("*").alias("n"))


def movements(cur: DataFrame, prev: DataFrame | None, key: str, moved: dict[str, str], awarded: str | None = None) -> DataFrame:
    """New and gone ids, moves of a field between two known values, No to Si awards.

    Without a baseline there is nothing to compare, so nothing is reported.
    """
    if prev is None:
        return cur.select(F.lit("").alias("tipo"), F.col(key).alias("id"), F.lit("").alias("antes"), F.lit("").alias("despues")).where("false")
    fields = list(dict.fromkeys([*moved.values(), *([awarded] if awarded else [])]))
    side = lambda d, name: d.select(key, F.struct(*[_clean(f).alias(f) for f in fields]).alias(name))
    d = side(prev, "o").join(side(cur, "n"), key, "full")
    row = lambda cond, kind, a, b: F.when(cond, F.struct(F.lit(kind).alias("tipo"), F.col(key).alias("id"), a.cast("string").alias("antes"), b.cast("string").alias("despues")))
    null = F.lit(None)
    rows = [row(F.col("o").isNull(), "nuevo", null, null), row(F.col("n").isNull(), "desaparecido", null, null)]
    for kind, f in moved.items():
        a, b = F.col(f"o.{f}"), F.col(f"n.{f}")
        rows.append(row((a != b) & (a != "") & (b != ""), kind, a, b))
    if awarded:
        a, b = F.col(f"o.{awarded}"), F.col(f"n.{awarded}")
        rows.append(row((a == "No") & (b == "Si"), "adjudicado", a, b))
    return d.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")


# ---- Ledger import (H9, A13) ------------------------------------------------


def import_ledger(ledger: DataFrame, watch: DataFrame, recorded: DataFrame, domain: str, prefix: str = "CONTRATO-ENT") -> DataFrame:
    """Every domain link of the ledger with the item it belongs to and its outcome.

    ``nueva`` creates the item, ``fusionada`` adds an appearance, ``ya_registrada``
    is already on file, so a second run over its own result adds nothing.
    ``recorded`` holds the appearances on file (``item, sheet, row_no, url``).
    """
    d = ledger.withColumn("url", strip_controls("url")).where(contains_link_of("url", domain))
    d = d.withColumn("pid", link_id("url"))
    d = d.withColumn("vigencia", F.coalesce(F.nullif(F.trim("vigencia"), F.lit("")), sheet_year("sheet")))
    d = d.withColumn("consecutivo", norm_sequence("numero", "vigencia", prefix))
    by_id = watch.where("process_id is not null").groupBy(F.col("process_id").alias("pid")).agg(F.min("item").alias("i1"))
    by_url = watch.groupBy("url").agg(F.min("item").alias("i2"))
    d = d.join(by_id, "pid", "left").join(by_url, "url", "left")
    d = d.withColumn("item", F.coalesce("i1", "i2", F.coalesce("pid", "url"))).withColumn("conocido", F.coalesce("i1", "i2").isNotNull())
    first = d.groupBy("item").agg(F.min(F.struct("sheet_ord", "row_no")).alias("primera"))
    seen = recorded.select("item", "sheet", "row_no", "url").distinct().withColumn("_r", F.lit(True))
    d = d.join(first, "item").join(seen, ["item", "sheet", "row_no", "url"], "left")
    outcome = (F.when(F.col("_r"), "ya_registrada")
               .when(~F.col("conocido") & (F.struct("sheet_ord", "row_no") == F.col("primera")), "nueva").otherwise("fusionada"))
    return d.select("item", "pid", "sheet", "sheet_ord", "row_no", "url", "vigencia", "consecutivo", outcome.alias("resultado"))


def import_items(imported: DataFrame) -> DataFrame:
    """Watch items of an import: first link and sheet, appearance and year counts."""
    first = O.latest(imported, ["item"], ["sheet_ord", "row_no"]).select("item", "pid", "url", F.col("sheet").alias("primera_hoja"))
    n = imported.groupBy("item").agg(F.count("*").alias("apariciones"))
    return first.join(n, "item")


def import_lists(imported: DataFrame, cell: int = 256) -> DataFrame:
    """Distinct sheets, years and sequence labels of an item in first-seen order."""
    o = F.struct("sheet_ord", "row_no")
    d = imported.select("item", o.alias("o"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("campo"), F.col(c).alias("v")) for n, c in (("hojas", "sheet"), ("vigencias", "vigencia"), ("consecutivos", "consecutivo"))])).alias("x"))
    return O.listing(d.select("item", "o", "x.campo", "x.v"), ["item", "campo"], "v", "texto", by="o", cell=cell)


def import_report(imported: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("resultado") == r)
    return imported.groupBy("sheet").agg(
        F.count("*").alias("encontradas"), n("nueva").alias("nuevas"), n("fusionada").alias("fusionadas"),
        n("ya_registrada").alias("ya_registradas"), F.count_if(F.col("consecutivo").isNotNull()).alias("con_consecutivo"))


# ---- Merges (H10, H11, H15) -------------------------------------------------


def merge_seed(seed: DataFrame, local: DataFrame, editable: list[str]) -> DataFrame:
    """Edited items keep their editable columns, manual items stay, the rest is replaced."""
    s = seed.select("url", F.struct(*seed.columns).alias("s"))
    m = local.select("url", F.struct(*local.columns).alias("l"))
    d = s.join(m, "url", "full")
    edited = F.col("s").isNotNull() & F.col("l.edited_at").isNotNull()
    out = ["url"]
    for c in seed.columns:
        if c == "url":
            continue
        keep = F.coalesce(f"l.{c}", f"s.{c}") if c in editable else F.col(f"s.{c}")
        if c == "edited_at":
            keep = F.col("l.edited_at")
        out.append(F.when(F.col("s").isNull(), F.col(f"l.{c}")).when(edited, keep).otherwise(F.col(f"s.{c}")).alias(c))
    origin = F.when(F.col("s").isNull(), "manual").when(edited, "editado").otherwise("semilla")
    return d.select(*out, origin.alias("origen"))


def merge_lww(local: DataFrame, remote: DataFrame, key: str, stamp: str) -> DataFrame:
    """Newest stamp wins; on a tie, or without stamps, the local row stays."""
    both = local.withColumn("replica", F.lit("local")).unionByName(remote.withColumn("replica", F.lit("remota")))
    return O.latest(both, [key], [F.desc_nulls_last(stamp), "replica"])


def upsert_docs(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return O.latest(both, keys, [F.desc("_new"), F.desc(version)]).drop("_new")


def count_drift(a: DataFrame, b: DataFrame, pct: float = 5.0) -> DataFrame:
    n = a.agg(F.count("*").alias("guardadas"), b.agg(F.count("*")).scalar().alias("vivas"))
    gap = F.abs(F.col("guardadas") - F.col("vivas"))
    drift = F.when(F.col("vivas") > 0, F.bround(gap * 100.0 / F.col("vivas"), 1))
    return n.select("guardadas", "vivas", drift.alias("desvio_pct"), F.coalesce((F.col("vivas") == 0) | (gap * 100 > F.lit(pct) * F.col("vivas")), F.lit(True)).alias("alerta"))


# ---- Notes (H14); batched edits of the watch list are in edits.py -----------


def set_notes(notes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets notes by key; blank text clears.  Returns (notes, log)."""
    d = notes.select("clave", F.col("text").alias("old")).join(edits.select("clave", F.col("text").alias("new"), F.lit(True).alias("_e")), "clave", "full")
    blank = F.trim(F.coalesce("new", F.lit(""))) == ""
    after = F.when(F.col("_e").isNull(), F.col("old")).when(~blank, F.col("new"))
    op = F.when(blank & F.col("old").isNotNull(), "obs_clear").when(~blank, "obs_set")
    out = d.select("clave", after.alias("text")).where("text is not null")
    log = d.where("_e").select("clave", op.alias("op"), F.col("old").alias("antes"), F.when(~blank, F.col("new")).alias("despues")).where("op is not null")
    return out, log
