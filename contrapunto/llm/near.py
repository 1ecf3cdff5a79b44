"""Near copies by the similarity of their five-word shingles.

A-Z is lower-cased, words are runs without ASCII white space, and a text is the set of its 5-word
shingles (the whole sequence if there are fewer words), each hashed to 64 bits.  Texts with equal sets
are one node; texts without words, and nulls, are all one node.  Two nodes link if the Jaccard
similarity of their sets is 0.8 or more, and a group is a component of the links.

SimHash comes first: texts whose fingerprints are equal, or linked by its Gray-order index (``simhash.links``, 2 or
fewer differing bits), are compared, and those that are alike are linked.  Texts of similarity 0.8 differ in 2 to 11
bits and more, so the rest comes from MinHash, ``BANDS`` bands of ``ROWS`` least hashes: two nodes of similarity
0.8 share no band with probability (1 - 0.8**8)**64, about 8 in a million, and less above.  Every
link is confirmed on the sets themselves, in whole numbers.

In a bucket (nodes that agree in a band) all are first compared with one of them, the leader: the one that shares
its buckets with the most others, as the text that others were made from does.  Linked nodes are contracted,
and buckets that still hold several components get another leader, up to ``TURNS`` times, while one of them holds more
than ``FEW`` nodes and turns help.  What is then still apart is
compared pair by pair, so no link of a bucket is left out.  Large buckets are dealt to squares of ``CHUNK`` by
``CHUNK`` nodes, which first compare sketches: at similarity 0.8 about 410 of the 512 bytes agree, with a
standard deviation of 9, so pairs under ``SURE`` are no links.  A square with few pairs left gives these to be
confirmed; a square with more than two a node is marked, and gets the sets themselves.  There the similarity
is computed in the task, and only links that join two components leave it: fewer than it has nodes.

One row of each group stays: the one with the least ``doc_id`` (null ids last; of equal ids the one with
the least hash; of rows that are equal in id and text, any one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm import simhash
from contrapunto.llm.common import durable, slices
from contrapunto.llm.components import components

SHINGLE, ROWS, BANDS = 5, 8, 64
SURE = 358     # of 512 sketch bytes: 0.7, where 0.8 less five deviations is 0.71
CHUNK = 2048
TURNS, FEW = 3, 256
_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _random.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_MIX = _random.integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The different shingles' hashes in ascending order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), dtype=np.uint64))


def least(own: np.ndarray) -> np.ndarray:
    """The least of each of the ``ROWS * BANDS`` hash functions over the shingles."""
    h, low = (own >> np.uint64(32)).astype(np.uint32), np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 256):
        x = h[at:at + 256, None] ^ _MASKS
        x *= _FACTORS
        np.minimum(low, x.min(axis=0), out=low)
    return low


def _buckets(own: np.ndarray) -> list[int]:
    """One number for each band, with the band in the last six bits."""
    if not len(own):
        return []
    x = (least(own).reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
    for shift in (31, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def _sketch(own: np.ndarray) -> bytes:
    return ((least(own) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    """``k1``, ``k2`` (two hashes that name a row by its id and text), ``doc_id``, ``text`` and the whole row as ``row``."""
    own = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    k = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "text")
    return own.select(k(1).alias("k1"), k(2).alias("k2"), "doc_id", "text", "row")


def _nodes(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """``k1``, ``k2``, ``doc_id``, ``node``, ``fp`` (its SimHash) and ``buckets`` (of the first ``bands``), a row per document."""
    def run(batches):
        for b in slices(batches):
            texts = b.column(3).to_pylist()
            sets = [shingles(t) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.array([simhash.fingerprint(t or "") for t in texts], dtype=np.uint64).view(np.int64)
            buckets = pa.array([_buckets(s)[:bands] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(node), pa.array(fps), buckets], names=["k1", "k2", "doc_id", "node", "fp", "buckets"])

    return _keyed(docs).select("k1", "k2", "doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long, node long, fp long, buckets array<long>")


def _parts(n: str):
    """One part for each 1024, 4096, 16384, ... partners."""
    return F.pow(F.lit(4), F.ceil(F.log(F.greatest(F.lit(1.0), F.col(n) / 1024)) / F.log(F.lit(4.0)))).cast("long")


def _by_simhash(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, ``parts``) of nodes to compare: each fingerprint's nodes with the least of them, and the least ones of linked fingerprints."""
    own = rows.select("fp", "node").distinct()
    least = durable(own.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    equal = own.join(least, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"), _parts("n").alias("parts"))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias("n" + c))
    linked = simhash.links(least.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), F.lit(1).cast("long").alias("parts"))
    return equal.unionByName(linked).where("a <> b").distinct()


def _sets(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``node``, ``own`` (its shingles) and ``sketch`` for the rows that ``named`` (k1, k2, node) names."""
    def run(batches):
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([_sketch(s) for s in sets], pa.binary())], names=["node", "own", "sketch"])

    one = _keyed(docs).select("k1", "k2", "text").join(named, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return one.select("node", "text").mapInArrow(run, "node long, own array<long>, sketch binary")


def _alike(common, n, m):
    """Whether the Jaccard similarity is 4/5 or more: 9 times the common shingles reach 4 times all."""
    return 9 * common >= 4 * (n + m)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike; the partners of one b are dealt to ``parts`` parts, and its set to each."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    other = sets.select(F.col("node").alias("b"), F.col("own").alias("y")).join(pairs.select("b", "parts").distinct(), "b")
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(other, ["b", "parts", "part"])
    return both.where(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b").distinct()


def _stars(open_: DataFrame) -> DataFrame:
    """``bucket`` and its ``leader``; of the nodes outside the last leader's component the one with the most company."""
    size = open_.groupBy("bucket").agg(F.count("*").alias("n"))
    placed = open_.join(size, "bucket")
    company = placed.groupBy("node").agg(F.sum("n").alias("company"))
    fresh = placed.where("last is null or root <> last").join(company, "node")
    return fresh.groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("best"), F.max("n").alias("n")).select("bucket", F.col("best.node").alias("leader"), "n")


def _by_square(members: DataFrame, payload: str, work) -> DataFrame:
    """``work(side, node, root, payload)`` of each (bucket, i, j), which gives pairs, or None to mark the square."""
    def run(batches):
        key, held = None, []

        def done():
            side, node, root, cells = zip(*held)
            got = work(np.array(side), np.array(node, dtype=np.int64), np.array(root, dtype=np.int64), cells)
            ab = np.array([(None, None)] if got is None else got, dtype=object).reshape(-1, 2)
            columns = [pa.array(ab[:, k].tolist(), pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([k] * len(ab), pa.int64()) for k in key]], names=["a", "b", "bucket", "i", "j"])

        for b in slices(batches):
            for *own, side, node, root, cell in zip(*[b.column(k).to_pylist() for k in range(7)]):
                if own != key:
                    if held:
                        yield done()
                    key, held = own, []
                held.append((side, node, root, cell))
        if held:
            yield done()

    ordered = members.select("bucket", "i", "j", "side", "node", "root", payload).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.mapInArrow(run, "a long, b long, bucket long, i long, j long")


def _sketched(side, node, root, cells) -> list[tuple[int, int]] | None:
    """Pairs of different components whose sketches agree in ``SURE`` places; None if they are more than two a node."""
    sketch = np.frombuffer(b"".join(cells), dtype=np.uint8).reshape(-1, ROWS * BANDS)
    left, right = (np.flatnonzero(side & bit) for bit in (1, 2))
    found: set[tuple[int, int]] = set()
    for at in left.tolist():
        other = right[root[right] != root[at]]
        near = node[other[np.count_nonzero(sketch[other] == sketch[at], axis=1) >= SURE]].tolist()
        own = int(node[at])
        found.update((min(own, b), max(own, b)) for b in near)
        if len(found) > 2 * len(node):
            return None
    return sorted(found)


def _joined(side, node, root, cells) -> list[tuple[int, int]]:
    """Links that join components, by the sets themselves: a spanning forest of the square's links."""
    sizes = np.array([len(c) for c in cells])
    _, at_shingle = np.unique(np.concatenate([np.array(c, dtype=np.int64) for c in cells]), return_inverse=True)
    ends = np.cumsum(sizes)
    left, right = (np.flatnonzero(side & bit) for bit in (1, 2))
    marked, out, comp = np.zeros(int(at_shingle.max()) + 1, dtype=np.int64), [], np.unique(root, return_inverse=True)[1]
    for at in left.tolist():
        other = right[(comp[right] != comp[at]) & (5 * np.minimum(sizes[right], sizes[at]) >= 4 * np.maximum(sizes[right], sizes[at]))]
        if not len(other):
            continue
        own = at_shingle[ends[at] - sizes[at]:ends[at]]
        marked[own] = 1
        seen = np.concatenate([[0], np.cumsum(marked[at_shingle])])
        marked[own] = 0
        common = seen[ends[other]] - seen[ends[other] - sizes[other]]
        for b in other[_alike(common, sizes[other], sizes[at])].tolist():
            if comp[b] != comp[at]:
                out.append((int(node[at]), int(node[b])))
                comp[comp == comp[b]] = comp[at]
    return out


def _squares(members: DataFrame, chunk: int) -> DataFrame:
    """The members of buckets with more than one root, once for each square (i <= j) they take part in; ``side``: 1 i, 2 j, 3 both."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("long").alias("k"))
    d = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "k")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("long")
    return d.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "node", "root")


def _still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root, leader's root ``last``) of the buckets that hold more than one component."""
    here = members.select("bucket", "node", "leader").join(roots, "node", "left").select("bucket", "node", "leader", F.coalesce("root", "node").alias("root"))
    mixed = here.groupBy("bucket").agg(F.max(F.when(F.col("node") == F.col("leader"), F.col("root"))).alias("last"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return here.select("bucket", "node", "root").join(mixed.select("bucket", "last"), "bucket")


def groups(docs: DataFrame, chunk: int = CHUNK, turns: int = TURNS, few: int = FEW, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """The rows (``k1``, ``k2``, ``doc_id``, ``node``) and the ``root`` of each node that has links.

    With ``bands`` 0 the links are those of SimHash alone.
    """
    rows = durable(_nodes(docs, bands))
    near = durable(_by_simhash(rows))
    dealt = rows.dropDuplicates(["node"]).select("node", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    open_ = durable(dealt.join(shared, "bucket").select("bucket", "node", F.col("node").alias("root"), F.lit(None).cast("long").alias("last")))
    compared = open_.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    named = rows.join(compared, "node").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"))
    sets = durable(_sets(docs, named.select("k.k1", "k.k2", "node")))
    links, size = durable(_confirmed(near, sets)), open_.count()
    roots = None if size and turns else components(links)
    for _ in range(turns if size else 0):
        led = durable(open_.join(_stars(open_), "bucket").select("bucket", "node", "root", "leader", "last", "n"))
        apart = led.join(led.where("node = leader").select("bucket", F.col("root").alias("there")), "bucket").where("root <> there")
        links = durable(links.unionByName(_confirmed(apart.select(F.col("node").alias("a"), F.col("leader").alias("b"), _parts("n").alias("parts")).distinct(), sets)))
        roots = components(links, roots)
        open_ = durable(_still_open(led, roots))
        was = size
        size, most = open_.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
        if not size or most <= few or 2 * size > was:
            break
    if size:
        squares = durable(_squares(open_, chunk))
        found = durable(_by_square(squares.join(sets.select("node", "sketch"), "node"), "sketch", _sketched))
        links = durable(links.unionByName(_confirmed(found.where("a is not null").select("a", "b", F.lit(1).cast("long").alias("parts")).distinct(), sets)))
        roots = components(links, roots)
        marked = found.where("a is null").select("bucket", "i", "j")
        if marked.limit(1).count():
            dense = squares.join(marked, ["bucket", "i", "j"]).drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            links = durable(links.unionByName(_by_square(dense.join(sets.select("node", "own"), "node"), "own", _joined).select("a", "b")))
            roots = components(links, roots)
    return rows.drop("buckets", "fp"), roots


def keep_one(docs: DataFrame, chunk: int = CHUNK, turns: int = TURNS, few: int = FEW, bands: int = BANDS) -> DataFrame:
    """The documents, exactly one row of each group."""
    rows, roots = groups(docs, chunk, turns, few, bands)
    placed = rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("row"))
    keep = placed.groupBy("root").agg(F.min("row").alias("row")).select("row.k1", "row.k2")
    return _keyed(docs).join(keep, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
