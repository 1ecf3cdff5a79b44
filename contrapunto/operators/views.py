"""Summaries of the watch list and options of its facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sheet_counts(watch: DataFrame, appearances: DataFrame, none: str = "(sin hoja)") -> DataFrame:
    """Appearances per sheet; items without any count once under their own sheet."""
    bare = watch.join(appearances.select("item").distinct(), "item", "left_anti")
    rows = appearances.select(F.col("sheet").alias("hoja")).unionByName(bare.select(F.coalesce("sheet", F.lit(none)).alias("hoja")))
    return rows.groupBy("hoja").agg(F.count("*").alias("n")).orderBy(F.col("hoja") == none, F.desc("hoja"))


def watch_summary(watch: DataFrame) -> DataFrame:
    """Totals, items without notice, and items per sheet and fiscal year."""
    groups = F.array_compact(F.array(
        F.struct(F.lit("total").alias("grupo"), F.lit("").alias("clave")),
        F.when(F.coalesce("notice_id", F.lit("")) == "", F.struct(F.lit("sin_aviso").alias("grupo"), F.lit("").alias("clave"))),
        F.when(F.col("sheet").isNotNull(), F.struct(F.lit("hoja").alias("grupo"), F.col("sheet").alias("clave"))),
        F.when(F.col("vigencia").isNotNull(), F.struct(F.lit("vigencia").alias("grupo"), F.col("vigencia").alias("clave")))))
    return watch.select(F.explode(groups).alias("g")).groupBy("g.grupo", "g.clave").agg(F.count("*").alias("n"))


def facet_options(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct years (signing or fiscal), states, modalities and sheets, newest first."""
    item = lambda f, v: F.struct(F.lit(f).alias("faceta"), v.cast("string").alias("opcion"))
    single = F.array(item("anio", F.year("fecha_firma")), item("estado", F.col("estado")), item("modalidad", F.col("modalidad")))
    years = F.transform("vigencias", lambda v: item("anio", v))
    sheets = F.transform("hojas", lambda v: item("hoja", v))
    d = df.select(F.explode(F.concat(single, years, sheets)).alias("x")).select("x.*").where("opcion is not null and opcion <> ''").distinct()
    d = d.orderBy("faceta", F.desc("opcion"))
    return d if limit is None else d.limit(limit)
