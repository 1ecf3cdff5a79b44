"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The size of a document is its number of words (runs without ASCII white space).  The sources, by code point
and null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a source's target stops at ``MOST``
times its size and what is over goes to the others by weight, until none is above (``targets``).

A document is cut into blocks of ``BLOCK`` words.  The blocks of a source get a random order (by a keyed
hash, ranked over ranges), and the mix takes it from the front: whole rounds of all blocks, then a last part,
whose last block is cut to the word.  So a source's taken words are its target rounded to a whole number, and
a block is in the mix as often as any other of its source, or once more.

Which output shard a draw belongs to is decided by a tree.  The root holds each source's exact number of
draws.  A node splits its shards in two halves; how many draws of each source go left is one multivariate
hypergeometric draw, seeded by the node.  A leaf so holds an exact count per source, as if all draws had been
shuffled, and takes the next draws of each source's order: disjoint, and none is left over.  Every task
walks the tree for its own draws only; no table of all shards exists anywhere.  ``mixed`` then shuffles each
shard, which is of bounded size, by another hash.

The driver holds one row per source.  Reruns agree: neither the hashes nor the tree depend on how the rows
are partitioned.  Rows that agree in every column are alike, so which of them is drawn more often does not show.

Null texts and texts without words have size 0 and are never taken; null ids, repeated ids and repeated rows
are documents of their own.  A source without words has target 0.  Empty tables give no rows.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrapunto.llm.common import durable, slices, wanted

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 256          # words
SHARD = 1 << 14      # draws a shard holds at most
SEED = 12
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXACT = 10 ** 9      # populations from here on are beyond numpy's sampler


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size."""
    out: dict[int, Fraction] = {}
    while True:
        rest = sum(sizes) - sum(out.values())
        free = [s for s in range(len(sizes)) if s not in out]
        weight = sum(weights[s] for s in free)
        share = {s: Fraction(rest) * weights[s] / weight for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return [(out | share)[s] for s in range(len(sizes))]
        out |= {s: Fraction(most * sizes[s]) for s in over}


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good."""
    if good + bad < EXACT:
        return int(rng.hypergeometric(good, bad, draws))
    low, high, n = max(0, draws - bad), min(good, draws), good + bad
    mean = draws * good / n
    reach = int(12 * (mean * (bad / n) * ((n - draws) / n)) ** 0.5) + 50  # beyond: less than 1e-30
    k = np.arange(max(low, int(mean) - reach), min(high, int(mean) + reach) + 1, dtype=np.float64)
    # logarithms of the ratios of neighbours, summed from the first on
    steps = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(chance, rng.random() * chance[-1], side="right").clip(max=len(k) - 1)])


def split(counts: np.ndarray, draws: int, node: tuple[int, int], seed: int = SEED) -> np.ndarray:
    """How many draws of each source go left at a node that sends ``draws`` left."""
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *node])))
    if (total := int(counts.sum())) < EXACT:
        return rng.multivariate_hypergeometric(counts, draws, method="marginals")
    left = np.zeros_like(counts)
    for s, own in enumerate(counts.tolist()):
        total -= own
        left[s] = _hypergeometric(rng, own, total, draws)
        draws -= int(left[s])
    return left


@dataclass(frozen=True)
class Tree:
    """Leaves are the shards; ``quota`` is the number of draws of each source."""

    quota: tuple[int, ...]
    shards: int
    seed: int = SEED

    @classmethod
    def of(cls, quota: list[int], shard: int = SHARD, seed: int = SEED) -> Tree:
        return cls(tuple(quota), max(1, -(-sum(quota) // shard)), seed)

    def start(self, shard: int) -> int:
        """Draws in the shards before this one: shards differ by one draw at most."""
        return sum(self.quota) * shard // self.shards

    def place(self, source: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The shard of each draw, given as number ``item`` of its source's order."""
        out = np.zeros(len(item), dtype=np.int64)
        todo = [(0, self.shards, np.array(self.quota, dtype=np.int64), np.zeros(len(self.quota), dtype=np.int64), np.arange(len(item)))]
        while todo:
            low, high, counts, first, rows = todo.pop()
            if high - low == 1 or not len(rows):
                out[rows] = low
                continue
            mid = (low + high) // 2
            left = split(counts, self.start(mid) - self.start(low), (low, high), self.seed)
            goes = item[rows] < (first + left)[source[rows]]
            todo += [(low, mid, left, first, rows[goes]), (mid, high, counts - left, first + left, rows[~goes])]
        return out


def _sized(docs: DataFrame, text: bool) -> DataFrame:
    """``row`` (a number of its own), ``doc_id``, ``source``, ``size``, ``print`` (hash of the text), and the text if asked for."""
    names = ["row", "doc_id", "source", "size", "print", *["text"] * text]

    def run(batches):
        for b in slices(batches, 1024):
            size = pa.array([len(t.encode("utf-8").split()) if t else 0 for t in b.column(4).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], size, *b.columns[3:4 + text]], names=names)

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`source`").cast("string").alias("source"), F.xxhash64(F.col("`text`")).alias("print"), F.col("`text`").alias("text"))
    return durable(own.mapInArrow(run, "row long, doc_id long, source string, size long, print long" + ", text string" * text))


def _ranked(blocks: DataFrame) -> DataFrame:
    """``rank`` (from 0) and ``before`` (words) of each block in its source's order.

    Rows are sorted over ranges; each range counts its own, and the sums of the ranges before are added.
    """
    order = ["s", "h", "doc_id", "print", "block", "row"]

    def run(batches):
        at: dict[int, tuple[int, int]] = {}
        for b in batches:
            s, words = b.column(2).to_numpy(), b.column(3).to_numpy()
            rank, before = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for low, high in zip(edges, edges[1:]):
                if low < high:
                    n, w = at.get(int(s[low]), (0, 0))
                    rank[low:high] = n + np.arange(high - low)
                    ends = w + np.cumsum(words[low:high])
                    before[low:high] = ends - words[low:high]
                    at = {int(s[low]): (n + high - low, int(ends[-1]))}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank), pa.array(before)], names=["row", "block", "s", "words", "part", "rank", "before"])

    sorted_ = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    own = durable(sorted_.select("row", "block", "s", "words", F.spark_partition_id().alias("part")).mapInArrow(run, "row long, block long, s int, words long, part int, rank long, before long"))
    ahead = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range, not a row a block
    parts = own.groupBy("s", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    parts = parts.select("s", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w"))
    return own.join(parts, ["s", "part"]).select("row", "block", "s", "words", (F.col("rank") + F.col("n")).alias("rank"), (F.col("before") + F.col("w")).alias("before"))


def _draws(sized: DataFrame, block: int, shard: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(one row per source; one row per draw: ``row``, ``block``, ``round``, ``words``, ``s``, ``shard``)."""
    spark = sized.sparkSession
    sums = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sums))]
    goals = targets([r["size"] for r in sums], weights)
    whole = [int(g + Fraction(1, 2)) for g in goals]
    rows = [(k, r["source"], r["size"], float(g), *(divmod(w, r["size"]) if r["size"] else (0, 0))) for k, (r, g, w) in enumerate(zip(sums, goals, whole))]
    # as a local relation, whose size Spark knows: joins with it need no exchange of the other side
    fields = [("s", pa.int32()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("rounds", pa.int64()), ("rest", pa.int64())]
    sources = spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], schema=pa.schema(fields)))

    full = F.ceil(F.col("size") / block).cast("long")
    cut = sized.where("size > 0").join(sources.select("s", F.col("source").alias("own")), F.col("source").eqNullSafe(F.col("own")))
    cut = cut.select("row", "doc_id", "print", "s", "size", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("block"))
    h = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "print", "block")
    ranked = durable(_ranked(cut.select("row", "doc_id", "print", "s", "block", F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block).alias("words"), h.alias("h"))))

    plan = ranked.join(sources.select("s", "rounds", "rest"), "s")
    last = F.col("before") < F.col("rest")
    counts = {r["s"]: (r["n"], r["more"]) for r in plan.groupBy("s").agg(F.count("*").alias("n"), F.sum(last.cast("long")).alias("more")).collect()}
    rounds = {r[0]: r[4] for r in rows}
    tree = Tree.of([counts.get(s, (0, 0))[0] * rounds[s] + counts.get(s, (0, 0))[1] for s in rounds], shard, seed)
    sizes = np.array([counts.get(s, (0, 0))[0] for s in rounds], dtype=np.int64)

    def run(batches):
        for b in batches:
            s, rank, turn = (b.column(k).to_numpy() for k in (3, 4, 5))
            shards = tree.place(s, turn * sizes[s] + rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column(5), pa.array(shards)], names=["row", "block", "words", "s", "round", "shard"])

    turns = F.col("rounds") + last.cast("long")
    drawn = plan.where(turns > 0).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    part = F.when(F.col("round") < F.col("rounds"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("before")))
    drawn = drawn.select("row", "block", part.alias("words"), "s", "rank", "round")
    return sources, drawn.mapInArrow(run, "row long, block long, words long, s int, round long, shard long")


def taken(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words the mix takes) and ``draws``."""
    sized = _sized(docs, False)
    sources, draws = _draws(sized, block, shard, seed)
    sums = draws.groupBy("row").agg(F.sum("words").alias("taken"), F.count("shard").alias("draws"))
    own = sized.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return own.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("draws", zero).alias("draws"))


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix itself: ``shard``, ``place`` in it, ``doc_id``, ``source``, ``block``, ``round``, ``words`` and ``text``.

    The texts of a document's blocks, in order, give the whole text.
    """
    sized = _sized(docs, True)
    _, draws = _draws(sized, block, shard, seed)

    def pieces(batches):
        for b in slices(batches, 64):
            out = ([], [], [])
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                starts = [m.start() for k, m in enumerate(WORD.finditer(text)) if k % block == 0]
                for k, (low, high) in enumerate(zip([0, *starts[1:]], [*starts[1:], len(text)])):
                    for column, v in zip(out, (row, k, text[low:high])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["row", "block", "text"])

    def cut(batches):
        for b in slices(batches, 1024):
            texts = []
            for text, words in zip(b.column(7).to_pylist(), b.column(6).to_pylist()):
                ends = [m.end() for m in WORD.finditer(text)]
                texts.append(text if words >= len(ends) else text[:ends[words - 1]])
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(texts, pa.string())], names=b.schema.names)

    parts = wanted(sized.where("size > 0"), "row", "text").mapInArrow(pieces, "row long, block long, text string")
    own = draws.join(sized.select("row", "doc_id", "source", "print"), "row").join(parts, ["row", "block"])
    inside = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id").isNull(), "doc_id", "print", "block", "round"), "doc_id", "print", "block", "round", "row")
    return own.select("shard", (F.row_number().over(inside) - 1).alias("place"), "doc_id", "source", "block", "round", "words", "text").mapInArrow(
        cut, "shard long, place int, doc_id long, source string, block long, round long, words long, text string")
