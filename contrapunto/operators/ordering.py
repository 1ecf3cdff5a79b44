"""Per-group ordering that stays safe when one group holds a large share of the rows.

* ``top_k`` filters on ``row_number() <= k``; Spark then keeps at most k rows per
  group in every map task before the shuffle, so a hot group ships k rows per task.
* ``joined`` and ``vocabulary`` are for closed vocabularies: duplicates go in a
  partial aggregate first, so a cell never sees more than the vocabulary.
* ``listing`` is for open sets: a group of few values is one aggregate, a larger one is cut into
  consecutive parts by the positions of its values (``numbered``), nothing is dropped.
* ``positions`` numbers rows inside groups from per-bucket counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrapunto.functions.text import col
from contrapunto.session import settled, shared_dir

FEW = 2048  # rows of a group that one aggregate may hold


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rn") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every group in the given order (last write wins with desc)."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def first_rows(df: DataFrame, order: list, k: int) -> DataFrame:
    """Global top k; Spark merges per-task heads."""
    return df.orderBy(*order).limit(k)


def _listagg(value: str, sep: str, order: str) -> Column:
    return F.expr(f"listagg({value}, '{sep}') within group (order by {order})")


def vocabulary(c, sep: str = " | ") -> Column:
    """Sorted distinct values as text, for groups already reduced to few rows."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif(col(c), F.lit("")))), sep), F.lit(""))


def joined(df: DataFrame, keys: list[str], value, out: str, sep: str = " | ") -> DataFrame:
    """Distinct values of a closed vocabulary, sorted, as one text per group."""
    d = df.select(*keys, col(value).alias("_v")).where("_v is not null and _v <> ''").distinct()
    return d.groupBy(*keys).agg(_listagg("_v", sep, "_v").alias(out))


def top_list(df: DataFrame, keys: list[str], order: list, k: int, text, out: str, sep: str = " | ",
             more: bool = False) -> DataFrame:
    """First k texts of each group in order, joined; with the overflow count when asked."""
    head = top_k(df.withColumn("_t", col(text)), keys, order, k, "_rn")
    lists = head.groupBy(*keys).agg(_listagg("_t", sep, "_rn").alias(out))
    if not more:
        return lists
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    tail = F.when(F.col("_n") > k, F.concat(F.lit("… y "), F.col("_n") - k, F.lit(" más")))
    return lists.join(counts, keys).withColumn(out, F.concat_ws(sep, F.col(out), tail)).drop("_n")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """1-based position of every row in its group by a total order, for groups of any size.

    Rows are dealt by range of (keys, order), so a large group is spread over many tasks; a row's
    position is its number inside its range plus the counts of the group's earlier ranges.  The
    dealt rows are checkpointed, so that both parts see the same ranges; positions do not depend
    on where the ranges lie.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    d = df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = d.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order)))
    offsets = offsets.withColumnsRenamed({k: "_k" + k for k in [*keys, "_p"]})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_k" + k)) for k in [*keys, "_p"]])
    return local.join(offsets, same).withColumn(out, F.col("_off") + F.col("_i")).drop("_p", "_i", "_off", *["_k" + k for k in [*keys, "_p"]])


def oversized(sizes: DataFrame, keys: list[str], cell: int) -> DataFrame | None:
    """The keys of ``sizes`` whose ``n`` is above ``cell``, computed now; None if there are none."""
    large = settled(sizes.where(F.col("n") > cell).select(*keys))
    return None if large.isEmpty() else large


def in_order(items, repeats: bool) -> Column:
    """The ``v`` of an array of (o, v), by ``o`` and ``v``; the first of equal ones unless ``repeats``."""
    values = F.transform(F.array_sort(items), lambda x: x["v"])
    return values if repeats else F.array_distinct(values)


def listing(df: DataFrame, keys: list[str], value, out: str, sep: str = " | ", by=None, cell: int = 256, repeats: bool = False,
            sizes: DataFrame | None = None) -> DataFrame:
    """All distinct values (with ``repeats`` all values) per group, in value order or first-seen order (``by``).

    A group is cut into consecutive parts of ``cell`` values, numbered from 0, by one rule for
    all sizes: the part is the value's position div ``cell``.  Groups of at most ``FEW`` rows (``cell``, if that is
    more) are sorted and cut in one aggregate; only the others are numbered.  ``sizes`` may give the rows of each group as ``n``
    (keys that come to more than the truth do no harm), else they are counted.
    """
    d = df.select(*keys, col(value).alias("_v"), (col(by) if by is not None else col(value)).alias("_o"))
    large = oversized(sizes if sizes is not None else d.groupBy(*keys).agg(F.count("*").alias("n")), keys, max(FEW, cell))
    d = d.where("_v is not null and _v <> ''")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_k" + k)) for k in keys])
    small = d if large is None else d.join(large.withColumnsRenamed({k: "_k" + k for k in keys}), same, "left_anti")
    small = small.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_v").alias("v"))).alias("_a"))
    small = small.select(*keys, in_order("_a", repeats).alias("_a"))
    small = small.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size(_a) - 1) div {cell}"))))
    small = small.select(*keys, F.array_join(F.slice("_a", (F.col("part") * cell + 1).cast("int"), F.lit(cell)), sep).alias(out), "part")
    if large is None:
        return small
    d = d.join(large.withColumnsRenamed({k: "_k" + k for k in keys}), same, "left_semi")
    d = d if repeats else d.groupBy(*keys, "_v").agg(F.min("_o").alias("_o"))
    d = numbered(d, keys, ["_o", "_v"], "_pos").withColumn("part", F.expr(f"(_pos - 1) div {cell}"))
    return small.unionByName(d.groupBy(*keys, "part").agg(_listagg("_v", sep, "_pos").alias(out)).select(*keys, out, "part"))


def positions(df: DataFrame, keys: list[str], order: list, bucket, out: str = "pos") -> DataFrame:
    """1-based position of every row in its group.

    ``bucket`` must follow the order; rows are numbered inside (group, bucket) and
    shifted by the counts of the earlier buckets, so no task sees a whole group.
    """
    d = df.withColumn("_b", col(bucket))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = d.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    return local.join(offsets, [*keys, "_b"]).withColumn(out, F.col("_off") + F.col("_i")).drop("_b", "_i", "_off")


def date_order_breaks(columns: list[str]) -> Column:
    """``prev > this`` pairs of out-of-order dates, each against the last known one before it."""
    pairs = []
    for i, c in enumerate(columns[1:], 1):
        last = reduce(lambda a, b: F.coalesce(a, b), [F.col(x) for x in reversed(columns[:i])])
        name = reduce(lambda a, b: F.coalesce(a, b), [F.when(F.col(x).isNotNull(), F.lit(x)) for x in reversed(columns[:i])])
        pairs.append(F.when(F.col(c) < last, F.concat_ws("", name, F.lit("="), last, F.lit(f" > {c}="), F.col(c))))
    return F.array_compact(F.array(*pairs))
