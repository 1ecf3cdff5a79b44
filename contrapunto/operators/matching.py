"""Text similarity join of notes with the documents of their process.

A text is the set of its word windows (two words in a row, folded to lower case; a lone word is a window).  The
score of a note and a body (a document's name or its whole text) is the overlap of the two sets: common windows
over those of the smaller one, so 1 where the shorter text is quoted whole.

Pairs are never listed per process, and sets of windows are not written down: texts are read again instead, since the
windows take more room than the words.  Two sets of overlap t share one of the first n - ceil(t * n) + 1 of the n windows
of the smaller one, in any order of windows that both use; one more window in that head asks for one more in common.
Windows come by their number in a sample of the texts, so frequent phrases are met last; the sample steers the order
alone, never the result.  Only heads are dealt by (process, window), and of the other side the windows that a bitmap of the
heads lets pass.  Every candidate is then scored on the whole sets: nothing is capped or missed.  A bitmap of fixed size
may let too much pass, never too little.  Texts with equal sets in one process are one class, compared once.

A note needs its best document alone, so notes are first joined at overlap 1, where one window of each text is enough,
and those left over at the least overlap.  All pairs of a round's overlap or more are found, so the best of them
is the best of all.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrapunto.session import written

SAMPLE = 20_000           # texts looked at to learn which windows are frequent
FREQUENT = 1 << 17        # windows of the sample that are told apart, at most
BITS = 27                 # a bitmap has 2 ** BITS bits
CHUNK = 1 << 16           # bytes of a bitmap in one row
MORE = 2                  # windows more in a head, if they are rare
SETS = "process_id string, klass long, n int, wins array<long>"
ROWS = "head boolean, process_id string, klass long, n int, need int, w long"

_rng = np.random.default_rng(17)
_T = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0xD1B54A32D192ED03)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _small(batches, rows: int = 1024):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _windows(folded: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the different windows of each text, by owner and hash; words stand between single blanks."""
    offsets = np.frombuffer(folded.buffers()[1], np.int32)[folded.offset:folded.offset + len(folded) + 1].astype(np.int64)
    data = np.frombuffer(folded.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    blanks = np.flatnonzero(data == 32)
    start, end = np.sort(np.concatenate([offsets[:-1], blanks + 1])), np.sort(np.concatenate([offsets[1:], blanks]))
    owner = np.searchsorted(offsets, start, side="right") - 1
    follows = np.zeros(len(owner), dtype=bool)
    follows[1:] = owner[1:] == owner[:-1]
    last = np.append(~follows[1:], True)
    at = np.flatnonzero(~last | ~follows)                   # the last of several words begins no window
    stop = end[np.where(last[at], at, np.minimum(at + 1, len(end) - 1))]
    first, owner = start[at], owner[at]
    powers = np.multiply.accumulate(np.full(len(data), _B, dtype=np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_T[data] * powers)])
    back = np.multiply.accumulate(np.full(len(data), _INVERSE, dtype=np.uint64))
    h = _mixed(_mixed((prefix[stop] - prefix[first]) * back[first]) + (stop - first).astype(np.uint64))
    o = np.lexsort((h, owner))
    owner, h = owner[o], h[o]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def with_windows(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``wins`` (hashes of the different windows of ``text``, ascending), their number ``n`` and the
    ``klass`` that equal sets share; texts without words are left out."""
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        for b in _small(batches):
            owner, h = _windows(b.column("_folded"))
            n = np.bincount(owner, minlength=b.num_rows)
            bounds = np.concatenate([[0], np.cumsum(n)])
            klass = _mixed(np.add.reduceat(_mixed(h * _B), bounds[:-1]) + n.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64))),
                                              pa.array(n, pa.int32()), pa.array(klass.view(np.int64))], names=[*kept, "wins", "n", "klass"])

    schema = T.StructType([*[f for f in rows.schema if f.name != text], *T.StructType.fromDDL("wins array<long>, n int, klass long")])
    folded = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))
    return rows.select(*kept, folded.alias("_folded")).where("_folded <> ''").mapInArrow(run, schema)


def _classes(sets: DataFrame) -> DataFrame:
    """One row per process and set, with the key of the class."""
    return sets.select("process_id", "klass", "n", "wins").dropDuplicates(["process_id", "klass"])


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (process key, list) rows: owner and value of each list entry, and a hash of process and value."""
    lists = batch.column("wins")
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    value = lists.flatten().to_numpy(zero_copy_only=False)
    process = batch.column("p").to_numpy(zero_copy_only=False).view(np.uint64)
    return owner, value, _mixed(value.view(np.uint64) ^ (process * np.uint64(0x9E3779B97F4A7C15))[owner])


def _keyed(sets: DataFrame, *columns: str) -> DataFrame:
    return sets.where("process_id is not null").select(F.xxhash64("process_id").alias("p"), *columns)


class Bitmap:
    """A set of hashes by their first ``BITS`` bits; sent in compressed form."""

    def __init__(self, packed: bytes):
        self.bits = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)

    def __reduce__(self):
        return Bitmap, (zlib.compress(self.bits.tobytes(), 1),)

    def passes(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - BITS)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(lists: DataFrame) -> Bitmap:
    """Bits of all (process, value) of ``lists`` (``process_id``, ``wins``)."""
    def mark(batches):
        bits = np.zeros(1 << BITS - 3, dtype=np.uint8)
        for b in _small(batches):
            at = _opened(b)[2] >> np.uint64(64 - BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = bits.reshape(-1, CHUNK)
        for i in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "bits": pa.array([zlib.compress(parts[i].tobytes(), 1)], pa.binary())})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
                held[i] = held[i] | part if i in held else part
        for i, part in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "bits": pa.array([part.tobytes()], pa.binary())})

    out = np.zeros((1 << BITS - 3) // CHUNK * CHUNK, dtype=np.uint8).reshape(-1, CHUNK)
    marked = _keyed(lists, "wins").mapInArrow(mark, "chunk int, bits binary").repartition("chunk").mapInArrow(merge, "chunk int, bits binary")
    for r in marked.toArrow().to_pylist():
        out[r["chunk"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Bitmap(zlib.compress(out.tobytes(), 1))


def frequencies(sides: list[DataFrame], texts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and numbers of the (process, window) pairs that a bounded sample of the ``texts`` has more than once."""
    sets = reduce(DataFrame.unionByName, [_keyed(d, "klass", "wins") for d in sides])
    part = max(1, -(-(sets.count() if texts is None else texts) // SAMPLE))

    def run(batches):
        for b in _small(batches):
            yield pa.RecordBatch.from_pydict({"h": pa.array(_opened(b)[2].view(np.int64))})

    often = sets.where(F.pmod("klass", F.lit(part)) == 0).dropDuplicates(["p", "klass"]).mapInArrow(run, "h long").groupBy("h").count().where("count > 1")
    top = often.orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, count = top["h"].to_numpy().view(np.uint64), top["count"].to_numpy()
    o = np.argsort(h)
    return h[o], count[o]


def _rows(sets: DataFrame, ranks: tuple[np.ndarray, np.ndarray], least: float | None = None, shared: Bitmap | None = None, asked: Bitmap | None = None) -> DataFrame:
    """(head, process_id, klass, n, need, w): with ``least`` the head of each set, of those windows that ``shared`` lets pass,
    and how many of them a set of that overlap has at least; with ``asked`` the windows that it lets pass.

    Sets that cannot reach ``least`` with their shared windows have no head.
    """
    spark = sets.sparkSession
    held = spark.sparkContext.broadcast((ranks if least is not None else None, shared, asked))

    def some(b, mark, need, owner, value):
        at = owner
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), mark)), b.column("process_id").take(pa.array(at)), b.column("klass").take(pa.array(at)), b.column("n").take(pa.array(at)),
             pa.array(need.astype(np.int32)), pa.array(value)], names=["head", "process_id", "klass", "n", "need", "w"])

    def run(batches):
        ranks, shared, asked = held.value
        for b in _small(batches):
            owner, value, h = _opened(b)
            if asked is not None:
                pick = np.flatnonzero(asked.passes(h))
                yield some(b, False, np.zeros(len(pick)), owner[pick], value[pick])
            if least is None:
                continue
            n = np.bincount(owner, minlength=b.num_rows)
            if shared is not None:
                pick = np.flatnonzero(shared.passes(h))
                owner, value, h = owner[pick], value[pick], h[pick]
            common = np.ceil(least * n - 1e-9).astype(np.int64)      # windows of n that an overlap asks for
            m = np.bincount(owner, minlength=b.num_rows)
            spare = m - common                                       # of the shared ones, so many may differ
            pick = np.flatnonzero(spare[owner] >= 0)
            owner, value, h = owner[pick], value[pick], h[pick]
            rank, (known, times) = np.zeros(len(h), dtype=np.int64), ranks
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, times[at], 0)
            o = np.lexsort((h, rank, owner))
            owner, value, rank = owner[o], value[o], rank[o]
            first = np.searchsorted(owner, np.arange(b.num_rows))
            place = np.arange(len(owner)) - first[owner]
            more = np.minimum(MORE, np.maximum(common - 1, 0))
            rare = (place > spare[owner]) & (place <= (spare + more)[owner]) & (rank == 0)
            need = 1 + np.bincount(owner[rare], minlength=b.num_rows)
            pick = np.flatnonzero(place < (spare + need)[owner])
            yield some(b, True, need[owner[pick]], owner[pick], value[pick])

    return sets.where("process_id is not null").select(F.xxhash64("process_id").alias("p"), "process_id", "klass", "n", "wins").mapInArrow(run, ROWS)


def _of(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """A row per class of ``sets`` among ``keys`` (``process_id``, ``klass``); a bitmap of the keys keeps the others' windows from being dealt out."""
    held = sets.sparkSession.sparkContext.broadcast(_bitmap(keys.select("process_id", F.array("klass").alias("wins"))))

    def run(batches):
        for b in _small(batches):
            one = pa.RecordBatch.from_arrays([b.column("p"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32)), b.column("klass"))], names=["p", "wins"])
            yield b.filter(pa.array(held.value.passes(_opened(one)[2]))).select(["process_id", "klass", "n", "wins"])

    near = sets.where("process_id is not null").select(F.xxhash64("process_id").alias("p"), "process_id", "klass", "n", "wins").mapInArrow(run, SETS)
    return _classes(near)


def overlap_pairs(left: DataFrame, right: DataFrame, least: float, ranks: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(process_id, one, other, common, smaller) of all classes with overlap ``least`` or more.

    Both sides: ``process_id``, ``klass``, ``n`` and ``wins``; equal sets of a process may come more than once.
    """
    ranks = frequencies([left, right]) if ranks is None else ranks
    heads = written(_rows(left, ranks, least))
    opened = lambda d: d.where("head").select("process_id", F.array("w").alias("wins"))
    bodies = written(_rows(right, ranks, least, _bitmap(left), _bitmap(opened(heads))))
    notes = heads.unionByName(_rows(left, ranks, asked=_bitmap(opened(bodies))))

    def met(short: int) -> DataFrame:
        a, b = (notes, bodies) if short == 0 else (bodies, notes)
        dealt = lambda d: d.repartition("process_id", "w").distinct()  # noqa: E731  (copies go where their rows meet the others)
        a = dealt(a.where("head").select("process_id", "w", F.col("klass").alias("a"), F.col("n").alias("na"), "need"))
        b = dealt(b.where("not head").select("process_id", "w", F.col("klass").alias("b"), F.col("n").alias("nb")))
        fits = F.col("na") <= F.col("nb") if short == 0 else F.col("na") < F.col("nb")
        hits = a.join(b, ["process_id", "w"]).where(fits).groupBy("process_id", "a", "b", "na", "need").agg(F.count("*").alias("c"))
        return hits.where("c >= need").select("process_id", "a", "b", "na", F.lit(short).alias("short"))

    found = written(met(0).unionByName(met(1)))
    equal, others = found.where("a = b"), found.where("a <> b")
    sets = _of(reduce(DataFrame.unionByName, [d.select("process_id", "klass", "n", "wins") for d in (left, right)]),
               others.select("process_id", F.explode(F.array("a", "b")).alias("klass")))
    for k in ("a", "b"):
        others = others.join(sets.select("process_id", F.col("klass").alias(k), F.col("wins").alias(f"w_{k}")), ["process_id", k])
    scored = others.select("process_id", "a", "b", "short", F.size(F.array_intersect("w_a", "w_b")).alias("common"), F.col("na").alias("smaller"))
    scored = scored.unionByName(equal.select("process_id", "a", "b", "short", F.col("na").alias("common"), F.col("na").alias("smaller")))
    return scored.where(F.col("common") >= F.lit(least) * F.col("smaller")).select(
        "process_id", F.when(F.col("short") == 0, F.col("a")).otherwise(F.col("b")).alias("one"), F.when(F.col("short") == 0, F.col("b")).otherwise(F.col("a")).alias("other"), "common", "smaller")


def best_overlaps(notes: DataFrame, bodies: DataFrame, member: DataFrame, least: float, keys: DataFrame | None = None, texts: int | None = None) -> DataFrame:
    """(process_id, klass, best) of the classes of ``notes`` that have a body of overlap ``least``, in rounds.

    ``keys`` may give the classes of ``notes`` without their windows, ``texts`` the number of all texts.
    """
    found, ranks = [], frequencies([notes, bodies], texts)
    keys = notes if keys is None else keys
    rounds = sorted({1.0, least}, reverse=True)
    for reach in rounds:
        pairs = overlap_pairs(notes, bodies, reach, ranks)
        # the least document of a class stands for it
        best = written(pairs.join(member, ["process_id", "other"]).groupBy("process_id", F.col("one").alias("klass")).agg(F.min(F.struct(
            (-F.col("common") / F.col("smaller")).alias("s"), F.col("doc.doc_id").alias("doc_id"), F.col("doc.campo").alias("campo"), "common", "smaller")).alias("best")))
        found.append(best)
        if reach != rounds[-1]:
            keys = written(keys.select("process_id", "klass").distinct().join(best, ["process_id", "klass"], "left_anti"))
            notes = written(_of(notes, keys).join(keys, ["process_id", "klass"], "left_semi"))
    return reduce(DataFrame.unionByName, found)


def match_notes(notes: DataFrame, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The best document of its process for every note: ``doc_id``, the field that matched, and the overlap.

    ``notes``: ``note_id``, ``process_id``, ``text``; ``docs``: ``doc_id``, ``process_id``, ``nombre``, ``texto``.
    Ties go to the least document, then to the name; a note without a match of ``least`` keeps nulls.
    """
    own = with_windows(notes.select("note_id", "process_id", "text"), "text")
    fields = [docs.select("doc_id", "process_id", F.lit(f).alias("campo"), F.col(f).alias("text")) for f in ("nombre", "texto")]
    bodies = with_windows(fields[0].unionByName(fields[1]), "text")
    member = written(bodies.groupBy("process_id", F.col("klass").alias("other")).agg(F.min(F.struct("doc_id", "campo")).alias("doc")))
    keys = written(own.select("note_id", "process_id", "klass"))
    best = best_overlaps(own, bodies, member, least, keys, notes.count() + 2 * docs.count())
    hits = keys.join(best, ["process_id", "klass"]).select("note_id", "best")
    return notes.select("note_id", "process_id").join(hits, "note_id", "left").select(
        "note_id", "process_id", F.col("best.doc_id").alias("doc_id"), F.col("best.campo").alias("campo"),
        F.col("best.common").alias("comunes"), F.col("best.smaller").alias("menor"), F.round(-F.col("best.s") * 100, 1).alias("coincidencia"))
