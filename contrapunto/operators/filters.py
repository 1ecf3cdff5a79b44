"""Filters and predicates (F*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapunto.functions.text import col


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def facet_filter(df: DataFrame, spec: dict[str, list], years: list[str] | None = None,
                 signed: str = "fecha_firma", fiscal: str = "vigencias") -> DataFrame:
    """AND across facets, OR inside one; an empty facet keeps everything.

    A year matches the signing year or any fiscal year of the row.
    """
    conds = [F.col(c).isin(v) for c, v in spec.items() if v]
    if years:
        hit = F.year(signed).cast("string").isin(years)
        if fiscal in df.columns:
            hit = hit | F.arrays_overlap(F.col(fiscal), F.array(*[F.lit(y) for y in years]))
        conds.append(F.coalesce(hit, F.lit(False)))
    return df.where(_all(conds))


def search(df: DataFrame, q: str, columns: list[str]) -> DataFrame:
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return df.where(F.contains(blob, F.lit(q.lower())))


def search_all(df: DataFrame, q: str, regex: bool = True) -> DataFrame:
    """Match in any column, ignoring case; a regular expression or a literal."""
    texts = [F.col(c).cast("string") for c in df.columns]
    hit = [F.coalesce(x.rlike(f"(?iu){q}") if regex else F.contains(F.lower(x), F.lit(q.lower())), F.lit(False)) for x in texts]
    return df.where(_any(hit))


def lookup_answer(df: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """How many rows match and whether that is none, an answer, or too many."""
    n = search_all(df, q, regex=False).agg(F.count("*").alias("coincidencias"))
    state = F.when(F.col("coincidencias") == 0, "ninguna").when(F.col("coincidencias") > limit, "demasiadas").otherwise("ok")
    return n.withColumn("estado", state)


def column_filter(df: DataFrame, members: dict[str, list], contains: dict[str, str]) -> DataFrame:
    conds = [F.col(c).isin(v) for c, v in members.items()]
    conds += [F.contains(F.lower(F.col(c).cast("string")), F.lit(v.lower())) for c, v in contains.items()]
    return df.where(_all(conds))


def is_expiring(end, as_of: str, days: int = 30) -> Column:
    return F.coalesce(F.datediff(col(end), F.lit(as_of).cast("date")).between(0, days), F.lit(False))


def expiring(df: DataFrame, as_of: str, days: int = 30, end: str = "fecha_fin") -> DataFrame:
    return df.where(is_expiring(end, as_of, days))


def is_amended() -> Column:
    return F.coalesce(F.col("estado") == "Modificado", F.lit(False)) | (F.coalesce("dias_adicionados", F.lit(0)) > 0)


def amended(df: DataFrame) -> DataFrame:
    return df.where(is_amended())


def attention_flags(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return df.withColumn("modificado", is_amended()).withColumn("vence", is_expiring("fecha_fin", as_of, days))


def attention(df: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return attention_flags(df, as_of, days).where("modificado or vence")


def by_sheet(watch: DataFrame, appearances: DataFrame, sheets: list[str], mode: str = "process") -> DataFrame:
    """Watch rows seen on the sheets: once each, or once per appearance.

    Appearances are a table of their own (key ``item``); a hot item never becomes
    one huge array.
    """
    hits = appearances.where(F.col("sheet").isin(sheets))
    if mode == "process":
        return watch.join(hits.select("item").distinct(), "item", "left_semi")
    if mode == "appearance":
        return watch.join(hits.select("item", "sheet", "row_no"), "item")
    raise ValueError("mode is 'process' or 'appearance'")


def pending(watch: DataFrame, portal: DataFrame, force: bool = False) -> DataFrame:
    """Notices still to capture: known notice, not already complete, each once."""
    notice = F.coalesce(F.nullif(F.trim("notice_id"), F.lit("")), F.when(F.col("process_id").startswith("CO1.NTC."), F.trim("process_id")))
    wanted = watch.select(notice.alias("notice_id")).where("notice_id is not null").distinct()
    if force:
        return wanted
    done = portal.where("status is null or status = 'ok_completo'").select("notice_id")
    return wanted.join(done, "notice_id", "left_anti")


def list_watched(watch: DataFrame, sheet: str | None = None, year: str | None = None, limit: int | None = None) -> DataFrame:
    conds = [F.col("sheet") == sheet] if sheet else []
    conds += [F.col("vigencia") == year] if year else []
    out = watch.where(_all(conds))
    return out if limit is None else out.orderBy("seq").limit(limit)


def log_tail(log: DataFrame, op: str | None = None, n: int = 500) -> DataFrame:
    d = log.where(F.col("op") == op) if op else log
    return d.orderBy(F.desc("pos")).limit(n)
