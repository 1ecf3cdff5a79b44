"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Texts are folded: A-Z to lower case, runs of other ASCII than letters and digits to one space, further
bytes as they are.  An item of m folded bytes may be found with up to m // ``RATE`` errors.  It is
split into one piece more than that, so an occurrence holds at least one piece unchanged.  One
pass over a text finds all pieces (Aho-Corasick); each hit names a diagonal, and the text around a
diagonal is verified with Myers' bit-parallel distance.

The benchmark is read in blocks of about ``BLOCK`` bytes by a hash of the item; each block is sent to
the tasks whole and searched in all documents, so neither side has a size limit.

Null and empty texts hold nothing; null and empty items match nothing.  Equal items and repeated
documents each give rows of their own.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import slices, wanted

RATE = 16
BLOCK = 4 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def folded(text: str | None) -> str:
    """Folded bytes, one character each."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()).decode("latin-1")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 consecutive pieces with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.item, self.errors = item, len(item) // RATE
        self.bits: dict[str, int] = {}
        for i, c in enumerate(item):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least distance to a part of ``text``, and the first end of such a part."""
        m = len(self.item)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        least, end = m, 0
        bits = self.bits
        for at, c in enumerate(text, 1):
            eq = bits.get(c, 0)
            cross = eq | minus
            zero = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (full & ~(zero | plus)), plus & zero
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full  # a part may begin anywhere: no cost above the first row
            down = down << 1 & full
            plus, minus = down | (full & ~(cross | up)), up & cross
            if score < least:
                least, end = score, at
        return least, end


class Searcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(i, Pattern(f)) for i, t in items if (f := folded(t))]
        self.backward: dict[int, Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, p) in enumerate(self.items):
            for offset, piece in pieces(p.item, p.errors):
                found.setdefault(piece, []).append((n, offset))
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item number to (distance, begin, end) of its best occurrence in a folded text."""
        best: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int]] = set()
        if not self.items:
            return best
        for last, (width, owners) in self.automaton.iter(text):
            for n, offset in owners:
                p = self.items[n][1]
                m, k = len(p.item), p.errors
                at = last + 1 - width - offset
                near = (n, at // (k + 1))
                if near in seen or best.get(n, (1,))[0] == 0:
                    continue
                seen.add(near)
                if text.startswith(p.item, max(at, 0)) and at >= 0:
                    best[n] = (0, at, at + m)
                    continue
                # any occurrence whose diagonal falls into this cell lies in the window
                low = max(0, near[1] * (k + 1) - k)
                distance, end = p.best(text[low:(near[1] + 1) * (k + 1) + m + k])
                if distance <= k and distance < best.get(n, (k + 1,))[0]:
                    back = self.backward.get(n) or self.backward.setdefault(n, Pattern(p.item[::-1]))
                    _, length = back.best(text[low:low + end][::-1])
                    best[n] = (distance, low + end - length, low + end)
        return best


def blocks(spark, benchmark: DataFrame, item: str = "item_id", size: int = BLOCK):
    """The benchmark as broadcast lists of (id, text) of bounded size."""
    items = wanted(benchmark, item, "text").where("text <> ''").toDF("id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // size + 1
    for i in range(parts):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == i).orderBy("id", "text").collect()
        yield spark.sparkContext.broadcast([(r["id"], r["text"]) for r in own])


_kept: dict[int, Searcher] = {}


def _searcher(sent) -> Searcher:
    """Built once per worker and block."""
    if sent.value is not _kept.get("list"):
        _kept["list"], _kept["searcher"] = sent.value, Searcher(sent.value)
    return _kept["searcher"]


def contaminations(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` and the place (``begin``, ``end`` in folded bytes) of each item found in a document."""
    source = wanted(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def search(sent):
        def run(batches):
            searcher = _searcher(sent)
            for b in slices(batches):
                rows = [(doc, searcher.items[n][0], d, s, e) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for n, (d, s, e) in sorted(searcher.matches(folded(text)).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["doc_id", "item_id", "distance", "begin", "end"])
        return run

    out = None
    for sent in blocks(docs.sparkSession, benchmark, size=size):
        part = source.mapInArrow(search(sent), "doc_id long, item_id long, distance long, begin long, end long")
        out = part if out is None else out.unionByName(part)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK) -> DataFrame:
    """The documents in which no item is found; all their columns."""
    def search(sent, at):
        def run(batches):
            searcher = _searcher(sent)
            for b in slices(batches):
                keep = [not searcher.matches(folded(t)) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))
        return run

    at = docs.columns.index("text")
    for sent in blocks(docs.sparkSession, benchmark, size=size):
        docs = docs.mapInArrow(search(sent, at), docs.schema)
    return docs
