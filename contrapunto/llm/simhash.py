"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: A-Z is lower-cased, words are runs without ASCII white space, and every 3-word
shingle (repeats included; the whole sequence if there are fewer words) is hashed by XXH64; a bit
is set if it is set in over half of the hashes.  Texts without words, and nulls, have fingerprint 0.

Links: two fingerprints link at ``distance`` (2) or fewer differing bits.  Equal fingerprints are
one node.  Bits are dealt to distance + 1 bands, and the bits outside a band again to as many: two
linked fingerprints agree in one band and one band within the rest, so each fingerprint goes to
nine blocks of the index.  A block is sorted by Gray rank, so that neighbours differ in few bits;
fingerprints are leaves, and each upper node holds the bit pattern that all of its group share,
with a mask of those bits.  A search adds up differences from the top: below a node only bits that
its parent did not mask are compared, and a group whose sum passes the distance is dropped whole.
A block that has outgrown ``BLOCK`` is dealt out again by two more levels of bands, and so on: at
distance 2, four levels leave at most 14 free bits, so no block can hold more than 2**14 fingerprints.
Within a block only a spanning forest of the links is kept, so groups of copies yield as many
links as members.  All bits but the band's may lie anywhere: nothing is lost.

Component ids are least ``doc_id``; rows whose ``doc_id`` is null take part with a null id and
count as the largest.  Repeated rows have equal fingerprints and so share a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import durable, slices, wanted
from contrapunto.llm.components import components

BLOCK = 4096   # members of a block before it is dealt out again
DEEPEST = 6    # levels of bands at most; at distance 2, four leave at most 14 bits free
FAN = 8        # children of an upper node
SEED = 42
GREATEST = (1 << 63) - 1


def fingerprint(text: str, size: int = 3, seed: int = SEED) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * ones > len(hashes))[0].tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long), a row per document."""
    def run(batches):
        for b in slices(batches):
            fps = [fingerprint(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    source = wanted(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    """Bit numbers dealt to ``parts`` runs of nearly equal length."""
    return [[int(b) for b in x] for x in np.array_split(np.array(bits), parts)]


def _masks(levels: int, parts: int) -> list[int]:
    """Masks of the bits that a block's members share, one for each choice of bands over the levels."""
    found = [(0, list(range(64)))]
    for _ in range(levels):
        found = [(mask | sum(1 << b for b in band), [b for b in rest if b not in band]) for mask, rest in found for band in _bands(rest, parts)]
    return [mask for mask, _ in found]


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected binary Gray sequence."""
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Fingerprints by Gray rank, with upper nodes that hold the bits all of a group share."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        pattern, mask = self.fps, np.full(len(self.fps), ~np.uint64(0))
        self.levels = [(pattern, mask)]
        while len(pattern) > FAN:
            starts = np.arange(0, len(pattern), FAN)
            ones = np.bitwise_and.reduceat(pattern & mask, starts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
            pattern, mask = ones, ones | zeros
            self.levels.append((pattern, mask))

    def links(self, distance: int, rows: int = 256):
        """Pairs of positions (i < j) within ``distance``, in arrays, for ``rows`` queries at a time."""
        for at in range(0, len(self.fps), rows):
            query = np.arange(at, min(at + rows, len(self.fps)))
            top = len(self.levels) - 1
            q = np.repeat(query, len(self.levels[top][0]))
            node = np.tile(np.arange(len(self.levels[top][0])), len(query))
            far = np.zeros(len(q), dtype=np.int64)
            above = np.zeros(len(q), dtype=np.uint64)  # bits already compared
            for level in range(top, -1, -1):
                pattern, mask = self.levels[level]
                if level < top:
                    width = len(pattern)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, far, above = np.repeat(q, FAN), np.repeat(far, FAN), np.repeat(above, FAN)
                    real = node < width
                    node, q, far, above = node[real], q[real], far[real], above[real]
                far = far + np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node] & ~above)
                near = (far <= distance) & ((node + 1) * FAN ** level > q)  # the group reaches past the query
                node, q, far = node[near], q[near], far[near]
                above = mask[node]
            later = node > q
            yield q[later], node[later]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints."""
    if len(fps) == 2:
        return [(int(fps[0]), int(fps[1]))] if int(fps[0] ^ fps[1]).bit_count() <= distance else []
    index = GrayIndex(fps)
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in index.links(distance):
        for x, y in zip(a.tolist(), b.tolist()):
            i, j = root(x), root(y)
            if i != j:
                parent[max(i, j)] = min(i, j)
                out.append((int(index.fps[x]), int(index.fps[y])))
    return out


def _blocks(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """``fp`` once for each mask, with the mask's number and the masked bits as ``block`` and ``bits``."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    choices = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    return nodes.select("fp", F.explode(choices).alias("c")).select("fp", "c.block", "c.bits")


def _searched(blocks: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) found in each (block, bits) group; groups stream past, one in memory at a time."""
    def run(batches):
        key, held = None, []

        def done():
            return forest(np.array(held, dtype=np.int64).view(np.uint64), distance) if len(held) > 1 else []

        for b in batches:
            block, bits, fps = (b.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((block[1:] != block[:-1]) | (bits[1:] != bits[:-1])) + 1
            found = []
            starts = [0, *edges.tolist(), len(fps)]
            for s, e in zip(starts, starts[1:]):
                if s == e:
                    continue
                own = (block[s], bits[s])
                if own != key:
                    found += done()
                    key, held = own, []
                held.extend(fps[s:e].tolist())
            yield _pairs(found)
        yield _pairs(done())

    def _pairs(found):
        ab = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])

    ordered = blocks.select("block", "bits", "fp").repartition("block", "bits").sortWithinPartitions("block", "bits", "fp")
    return ordered.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, distance: int = 2, block: int = BLOCK) -> DataFrame:
    """A spanning set of the links (a, b) among the different ``fp`` of ``nodes``."""
    parts, levels = distance + 1, 2
    left, found = _blocks(nodes.select("fp"), _masks(levels, parts)), None
    while True:
        large = durable(left.groupBy("block", "bits").count().where(F.col("count") > block).select("block", "bits")) if levels < DEEPEST else None
        if large is None or large.isEmpty():
            part = _searched(left, distance)
            return part if found is None else found.unionByName(part)
        part = _searched(left.join(large, ["block", "bits"], "left_anti"), distance)
        found = part if found is None else found.unionByName(part)
        levels += 2
        left = _blocks(left.join(large, ["block", "bits"]).select("fp").distinct(), _masks(levels, parts))


def near_duplicates(docs: DataFrame, distance: int = 2, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` for every document."""
    prints = durable(fingerprints(docs))
    nodes = durable(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(GREATEST))).alias("least")))
    found = links(nodes, distance, block)
    # nodes are named by their least document, so the least node names the component
    name = nodes.select(F.col("fp").alias("a"), F.col("least").alias("x"))
    pairs = found.join(name, "a").join(nodes.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    roots = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    ids = nodes.join(roots, nodes["least"] == roots["node"], "left").select("fp", F.coalesce("root", "least").alias("root"))
    ids = ids.select("fp", F.when(F.col("root") != GREATEST, F.col("root")).alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The documents, one of each group: the one with the least ``doc_id`` (of equal ids, one row)."""
    groups = near_duplicates(docs, distance)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"])).select(docs["*"])
    return kept
