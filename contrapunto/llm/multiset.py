"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is cut at line ends, and long lines at clause ends; each piece is hashed to a wide vector
and the vectors are summed, lane by lane, modulo powers of two.  So the order of paragraphs does
not matter, and a paragraph is inserted or deleted by adding or subtracting its own fingerprint.

* ``flags``: 63 lanes that count the pieces whose hash has a given bit, modulo 2**32.  Twice the
  count less the number of pieces is a sum of random signs, so the cosine of two such vectors
  estimates the overlap of the multisets (standard error about 1/8).
* ``sums``: three lanes of hashes modulo 2**40, for equality.

The path is SQL functions only.  In one pass three flag lanes share a long, 21 bits apart; a piece
number counts up to 2**20 before a new partial sum begins, so no lane runs into its neighbour
whatever the length of the text.

Null and empty texts have the fingerprint of no pieces (all zero); two such texts are alike (1),
and unlike any other (0).  Rows that share a ``doc_id`` keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapunto.llm.common import durable, wanted

PIECES = r"\s*[\n\r]+\s*|(?<=[.!?;:,|])\s+"
FIELD, LANES = 21, 63
SPREAD = 1 | 1 << FIELD | 1 << 2 * FIELD
CHUNK_BITS = 20
FLAG_MOD, SUM_MOD = 1 << 32, 1 << 40
LEAST = -(1 << 63)


def _lane(x: Column) -> Column:
    """A lane modulo 2**32 as a signed int."""
    return (F.pmod(x + FLAG_MOD // 2, F.lit(FLAG_MOD)) - FLAG_MOD // 2).cast("int")


def fingerprints(units: DataFrame, keys: list[str], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``keys``, ``carry``, ``n`` (pieces), ``flags`` and ``sums`` for each combination of ``keys``.

    ``carry`` columns depend on the keys.  If the rows are already partitioned by some of the
    keys, this adds no shuffle; otherwise one partial row a key and task is shuffled.
    """
    carry = carry or []
    # a key without any piece must stay: explode_outer gives it one null piece
    pieces = units.select(*keys, *carry, F.posexplode_outer(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), PIECES), lambda p: p != "")).alias("at", "piece"))
    h = pieces.select(
        *keys, *carry, F.shiftright(F.coalesce("at", F.lit(0)), CHUNK_BITS).alias("chunk"),
        F.when(F.col("piece").isNotNull(), F.xxhash64("piece")).alias("h0"),
        *[F.when(F.col("piece").isNotNull(), F.xxhash64(F.lit(i), F.col("piece")).bitwiseAND(F.lit(SUM_MOD - 1))).alias(f"h{i}") for i in (1, 2, 3)])
    part = h.groupBy(*keys, "chunk").agg(
        F.count("h0").alias("n"), *[F.any_value(c).alias(c) for c in carry],
        *[F.sum(F.shiftrightunsigned("h0", s).bitwiseAND(F.lit(SPREAD))).alias(f"p{s}") for s in range(FIELD)],
        *[F.sum(f"h{i}").alias(f"q{i}") for i in (1, 2, 3)])
    field = lambda s, j: F.coalesce(F.shiftrightunsigned(f"p{s}", FIELD * j).bitwiseAND(F.lit((1 << FIELD) - 1)), F.lit(0))
    whole = part.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in carry],
        *[F.sum(field(s, j)).alias(f"f{s + FIELD * j}") for j in range(3) for s in range(FIELD)],
        *[F.sum(F.coalesce(F.col(f"q{i}").bitwiseAND(F.lit(SUM_MOD - 1)), F.lit(0))).alias(f"s{i}") for i in (1, 2, 3)])
    return whole.select(
        *keys, *carry, "n",
        F.array(*[_lane(F.col(f"f{i}")) for i in range(LANES)]).alias("flags"),
        F.array(*[F.col(f"s{i}").bitwiseAND(F.lit(SUM_MOD - 1)) for i in (1, 2, 3)]).alias("sums"))


def combined(a: str, b: str, sign: int = 1) -> list[Column]:
    """``n``, ``flags``, ``sums`` of fingerprint ``a`` with ``b`` inserted (sign 1) or deleted (-1)."""
    def lanes(name: str, held) -> Column:
        return F.zip_with(f"{a}.{name}", f"{b}.{name}", lambda x, y: held(x.cast("long") + sign * y.cast("long"))).alias(name)
    return [(F.col(f"{a}.n") + sign * F.col(f"{b}.n")).alias("n"), lanes("flags", _lane), lanes("sums", lambda x: F.pmod(x, F.lit(SUM_MOD)))]


def printed(fp: str) -> Column:
    """The fingerprint as lower-case hex."""
    wide = lambda x, k: F.lower(F.lpad(F.hex(x), k, "0"))
    return F.concat(wide(F.col(f"{fp}.n"), 16), F.array_join(F.transform(f"{fp}.sums", lambda x: wide(x, 10)), ""),
                    F.array_join(F.transform(f"{fp}.flags", lambda x: wide(x.cast("long").bitwiseAND(F.lit(FLAG_MOD - 1)), 8)), ""))


def likeness(a: str, b: str) -> Column:
    """Estimated cosine of the two multisets of pieces, 0 to 1; 1 for equal fingerprints."""
    def signs(fp: str) -> Column:  # a lane counts modulo 2**32, so the signed sum is read modulo 2**32 too
        return F.transform(f"{fp}.flags", lambda x: F.pmod(2 * x.cast("long") - F.col(f"{fp}.n") + FLAG_MOD // 2, F.lit(FLAG_MOD)).cast("double") - FLAG_MOD // 2)
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = signs(a), signs(b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    equal = (F.col(f"{a}.n") == F.col(f"{b}.n")) & (F.col(f"{a}.sums") == F.col(f"{b}.sums")) & (F.col(f"{a}.flags") == F.col(f"{b}.flags"))
    return F.when(equal, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size)))


def neighbours(docs: DataFrame) -> DataFrame:
    """For each ``key``: ``n`` code points, ``next`` and ``prev`` key in ascending order, closing to a ring.

    Only ids and lengths move.  They are sorted by range once and written, so that the range
    borders are the same for all who read them; each range takes its last row's successor from the
    list of first rows, one row a range.
    """
    ids = docs.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    ranged = durable(ids.repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    ring = Window.orderBy("range")  # a row a range
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(ring), F.first("first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"),
                           F.coalesce(F.lag("last").over(ring), F.last("last").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    inside = Window.partitionBy("range").orderBy("key")
    linked = ranged.select("key", "n", "range", F.lead("key").over(inside).alias("lead"), F.lag("key").over(inside).alias("lag")).join(firsts, "range")
    return linked.select("key", F.coalesce("lead", "after").alias("next"), F.coalesce("lag", "before").alias("prev"))


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document's.

    The edited text has the last half of the code points replaced by the beginning of the next
    document (ascending ``doc_id``, after the last the first; null ids come first).
    """
    # both uses of the texts read the same two columns, so that they share one exchange
    source = wanted(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    near = neighbours(source)
    # each key's previous document needs half its own length from this one
    lengths = source.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    need = near.join(lengths.select(F.col("key").alias("prev"), F.col("n").alias("prev_n")), "prev").select("key", "prev", "next", (F.col("prev_n") / 2).cast("long").cast("int").alias("need"))
    held = source.join(need, "key")
    starts = held.groupBy(F.col("prev").alias("key")).agg(F.min(F.expr("substring(text, 1, need)")).alias("start"))
    half = "cast(length(text) div 2 as int)"
    edited = held.join(starts, "key").select(
        "key", F.monotonically_increasing_id().alias("row"), "next", F.length("text").cast("long").alias("n_chars"), "text",
        F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(start, 1, {half}))").alias("edited"))
    kinds = edited.select("key", "row", "next", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                          F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("u"))
    kinds = kinds.select("key", "row", "next", "n_chars", "edited_sha256", "u.kind", "u.text")
    fp = fingerprints(kinds, ["key", "row", "kind"], carry=["next", "n_chars", "edited_sha256"])
    fp = fp.withColumn("fp", F.struct("n", "flags", "sums"))
    rows = fp.groupBy("key", "row").agg(
        *[F.any_value(c).alias(c) for c in ("next", "n_chars", "edited_sha256")],
        F.max_by("fp", -F.col("kind")).alias("fp"), F.max_by("fp", "kind").alias("edited_fp"))
    kept = durable(rows.drop("row"))
    following = kept.groupBy(F.col("key").alias("next")).agg(F.min("fp").alias("next_fp"))
    return kept.join(following, "next").select(
        F.when(kept["key"] != LEAST, kept["key"]).alias("doc_id"), "n_chars", "edited_sha256", printed("fp").alias("fingerprint"), printed("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
