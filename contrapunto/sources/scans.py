"""Scans (S*): landed tables, snapshots, logs, binaries and ledger cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrapunto import schemas as S
from contrapunto.functions.text import flatten_url as url_text
from contrapunto.functions.text import fold
from contrapunto.operators import ordering as O
from contrapunto.operators.documents import sniff


def scan(df: DataFrame, where=None, select: list | None = None, order: list | None = None,
         limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filtered scan; filters and columns reach the file scan through Catalyst."""
    out = df if where is None else df.where(where)
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out if select is None else out.select(*select)


def scan_entity(df: DataFrame, column: str, value) -> DataFrame:
    """Every row of one entity; landed pages are one partitioned read."""
    return df.where(F.col(column) == value)


def scan_pages(spark: SparkSession, path: str, schema: T.StructType, size: int) -> DataFrame:
    """Landed JSON pages (folders ``page=0``, ``page=1``, ...) as a client that pages until a short one would see them.

    Pages behind the first one that is not full, or behind a gap, are left over from another run
    and not read: the page number is a partition of the folder.
    """
    d = spark.read.schema(T.StructType([*schema.fields, T.StructField("page", T.LongType())])).json(path)
    pages = d.groupBy("page").agg(F.count("*").alias("n"))
    after = pages.select((F.col("page") - 1).alias("page"), F.lit(True).alias("_next"))
    ends = pages.join(after, "page", "left").where((F.col("n") < size) | F.col("_next").isNull())
    first_full = pages.where("page = 0").limit(1).select(F.lit(0).cast("long")).scalar()
    return d.where((F.col("page") <= ends.agg(F.min("page")).scalar()) & first_full.isNotNull()).drop("page")


def union_archives(frames: list[tuple[str, DataFrame]], url: str = "url", name: str = "nombre", seq: str = "doc_id") -> DataFrame:
    """Union of archive tables; per download link (else name) the first table wins."""
    tagged = [df.withColumns({"fuente": F.lit(label), "_prio": F.lit(i)}) for i, (label, df) in enumerate(frames)]
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    key = F.coalesce(F.nullif(F.trim(url), F.lit("")), name)
    return O.latest(all_rows.withColumn("clave", key), ["process_id", "clave"], ["_prio", seq]).drop("_prio")


def flatten_urls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Link cells to plain text, whether struct or text holding a JSON object."""
    out = {}
    for c in columns:
        kind = df.schema[c].dataType
        out[c] = F.col(c)["url"] if isinstance(kind, T.StructType) else url_text(c)
    return df.withColumns(out)


def ledger_cells(ledger: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide ledger to cells ``(keys, col_no, header, val)``."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("col_no"), F.lit(c).alias("header"), F.col(c).cast("string").alias("val"))
        for i, c in enumerate(columns, 1)])
    return ledger.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def detect_link_column(cells: DataFrame, domain: str, preferred: str | None = None,
                       headers: list[str] = S.LINK_HEADERS, sample_rows: int | None = None) -> DataFrame:
    """One link column per sheet: preferred header, known header, else most link hits.

    Hits are counted over the whole sheet unless ``sample_rows`` says otherwise.
    """
    d = cells if sample_rows is None else cells.where(F.col("row_no") <= sample_rows)
    hit = F.contains(F.lower("val"), F.lit(domain.lower()))
    per = d.groupBy("sheet", "col_no", "header").agg(F.count_if(hit).alias("hits"))
    h = fold(F.trim("header"))
    rank = F.when(h == (preferred or "").upper(), 0) if preferred else F.when(F.lit(False), 0)
    for i, name in enumerate(headers, 1):
        rank = rank.when(h == name, i)
    per = per.withColumn("rank", rank.when(F.col("hits") > 0, 100)).where("rank is not null")
    order = ["rank", F.desc("hits"), "col_no"]
    how = F.when(F.col("rank") == 0, "preferida").when(F.col("rank") < 100, "encabezado").otherwise("conteo")
    return O.latest(per, ["sheet"], order).select("sheet", "col_no", "header", "hits", how.alias("via"))


def resolve_headers(headers: DataFrame, aliases: dict[str, list[str]] = S.HEADER_ALIASES) -> DataFrame:
    """Logical field of each sheet to its column; first alias wins, then leftmost column."""
    wanted = F.array(*[
        F.struct(F.lit(f).alias("campo"), F.lit(i).alias("alias_rank"), fold(F.lit(a)).alias("alias"))
        for f, names in aliases.items() for i, a in enumerate(names)])
    d = headers.withColumn("_h", fold(F.trim("header"))).withColumn("_w", F.explode(wanted))
    d = d.where(F.contains(F.col("_h"), F.col("_w.alias"))).select("sheet", "col_no", "header", "_w.campo", "_w.alias_rank")
    return O.latest(d, ["sheet", "campo"], ["alias_rank", "col_no"]).select("sheet", "campo", "col_no", "header")


def explode_snapshots(docs: DataFrame, text: str = "value") -> DataFrame:
    """JSON documents keyed by notice to one row per notice."""
    parsed = F.from_json(F.col(text), T.MapType(T.StringType(), S.PORTAL_ENTRY))
    return docs.select(F.explode(parsed).alias("notice_id", "e")).select("notice_id", "e.*")


def scan_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, each one JSON object of any number of ``{notice: entry}``, laid out in any way.

    An entry that is null, or lacks fields, keeps its row with nulls; an entry with fields of another
    shape has nulls for all.  A file that is no JSON object gives no rows (see ``unreadable_snapshots``).
    """
    entries = _documents(spark, path).lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    entry = F.try_variant_get("value", "$", S.PORTAL_ENTRY.simpleString())
    return entries.where("key is not null").select(F.col("key").alias("notice_id"), entry.alias("e")).select("notice_id", "e.*")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("doc"))


def unreadable_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files that are no JSON object."""
    return _documents(spark, path).where("doc is null or schema_of_variant(doc) not like 'OBJECT<%'").select("file")


def snapshot_index(portal: DataFrame) -> DataFrame:
    return portal.select(
        "notice_id", "status", "scraped_at",
        F.coalesce(F.size(F.map_keys("all_labels")), F.lit(0)).alias("campos"),
        F.coalesce(F.size("documents"), F.lit(0)).alias("documentos"),
        F.array_join("missing_fields", ", ").alias("faltantes"))


def scan_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The append-only event log; ``pos`` carries its order."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(S.AUDIT_LOG).json(path)


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", sniff("content").alias("tipo"))
