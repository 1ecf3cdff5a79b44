"""Removal of repeated 100-byte strings by Burrows-Wheeler interval expansion.

Every byte is removed that lies in a string of ``size`` bytes which also starts earlier (in a
smaller ``doc_id``, or earlier in the same document); strings never cross documents and are judged
on the input.

1. Equal windows must meet.  A window's anchor is its least ``GRAM``-byte string by hash (grams
   found frequent in a sample rank last, which only spreads the load: any choice gives the same
   result); consecutive windows with one anchor form a run.  Equal windows have equal anchors.
2. Runs equal in whole are pre-aggregated to their earliest holder, first in the task that cuts
   them and then by anchor, so a copied passage reaches a reducer at most once a task.  An anchor
   with a single run has nothing more to compare.
3. The different runs of an anchor that may share a window (by hash) are concatenated, many anchors to a
   bounded block, and the block is searched: intervals of the suffix array are extended backward over the Burrows-Wheeler
   transform, breadth first, so that common prefixes come out by increasing value; expansion stops
   at ``size``.  Borders never set separate nothing: the windows between two set borders are
   equal, and all but the earliest are marked.
4. Marks are gathered by document and cut from the text.

Texts shorter than ``size`` keep everything; null reads as empty.  Rows that repeat both id and text
are one document for this purpose and get equal results; rows that repeat only the id are different
documents, ordered by a hash of the text.  A null id sorts first.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import durable, slices, wanted

GRAM = 16
PART = 1 << 20            # bytes hashed at a time; longer texts are cut with an overlap
BLOCK = 1 << 19           # bytes of runs in one transform
SAMPLE = 20_000           # documents looked at to learn which grams are frequent
FREQUENT = 4096           # grams that rank last, at most
LEAST = -(1 << 63)

_rng = np.random.default_rng(20)
_T1, _T2 = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    h, step, m = _T1[data], 1, _M
    while step < GRAM:
        h = h[:-step] * m + h[step:]
        with np.errstate(over="ignore"):
            m = m * m
        step *= 2
    return _mixed(h)


def runs(data: np.ndarray, ends: np.ndarray, size: int, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, run hash, first window and length in bytes of each run in joined texts.

    ``ends`` are the texts' ends within ``data``.
    """
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(data) < size:
        return none
    gram = _grams(data)
    order = gram >> np.uint64(1)
    if len(frequent):
        table = np.zeros(1 << 16, dtype=bool)
        table[frequent & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(table[gram & np.uint64(0xFFFF)])
        at = at[np.isin(gram[at], frequent)]
        order[at] |= np.uint64(1 << 63)
    # the 24 low bits give way to the place, so that of equal grams the leftmost is the anchor
    least = (order & ~np.uint64(0xFFFFFF)) | np.arange(len(order), dtype=np.uint64)
    span, width = size - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:width - span], least[span - width:])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)[:len(data) - size + 1]
    valid = np.ones(len(anchor), dtype=bool)
    for e in ends[:-1].tolist():  # windows that would cross into the next text
        valid[max(0, e - size + 1):e] = False
    place = np.flatnonzero(valid)
    if not len(place):
        return none
    own = anchor[place]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
    first = place[new]
    last = place[np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)]
    length = last - first + size
    powers = np.multiply.accumulate(np.full(len(data), _B, dtype=np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_T2[data] * powers)])
    back = np.multiply.accumulate(np.full(len(data), _INVERSE, dtype=np.uint64))
    whole = (prefix[first + length] - prefix[first]) * back[first]
    return gram[own[new]], _mixed(whole + length.astype(np.uint64) * _M), first, length


def _merged(keys: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one key joined; returns key, start, length."""
    if not len(start):
        return keys, start, length
    o = np.lexsort((start, keys))
    keys, start, end = keys[o], start[o], (start + length)[o]
    step = int(end.max()) + 1
    _, dense = np.unique(keys, return_inverse=True)
    far = np.maximum.accumulate(dense * step + end)  # ends never reach the next key's zero
    new = np.ones(len(start), dtype=bool)
    new[1:] = (dense * step + start)[1:] > far[:-1]
    new[1:] |= dense[1:] != dense[:-1]
    at = np.flatnonzero(new)
    stop = far[np.append(at[1:] - 1, len(start) - 1)] - dense[at] * step
    return keys[at], start[at], stop - start[at]


def _parts(batches, size: int):
    """Texts as lists of (doc, version, offset, bytes) of about ``PART`` bytes together."""
    held, total = [], 0
    for b in slices(batches):
        docs, versions = b.column(0).to_pylist(), b.column(1).to_pylist()
        for doc, version, text in zip(docs, versions, b.column(2).to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            if len(data) < size:
                continue
            for at in range(0, len(data) - size + 1, PART):
                piece = data[at:at + PART + size - 1]
                held.append((doc, version, at, piece))
                total += len(piece)
                if total >= PART:
                    yield held
                    held, total = [], 0
    if held:
        yield held


SPANS = "kind int, anchor long, run long, doc long, version long, start long, length long"


def _spans(kind: int, anchor, run, doc, version, start, length) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (anchor, run, doc, version, start, length)]],
        names=["kind", "anchor", "run", "doc", "version", "start", "length"])


def _cut(part: list, size: int, frequent: np.ndarray):
    data = np.frombuffer(b"".join(p[3] for p in part), dtype=np.uint8)
    ends = np.cumsum([len(p[3]) for p in part])
    anchor, run, first, length = runs(data, ends, size, frequent)
    text = np.searchsorted(ends, first, side="right")
    begin = np.concatenate([[0], ends[:-1]])
    doc, version, offset = (np.array([p[i] for p in part], dtype=np.int64)[text] for i in range(3))
    return anchor, run, doc, version, first - begin[text] + offset, length


def _earlier(batches, size: int, frequent: np.ndarray):
    """The earliest run of each kind in a part (kind 0), and what the part's later equals cover (kind 1)."""
    for part in _parts(batches, size):
        anchor, run, doc, version, start, length = _cut(part, size, frequent)
        o = np.lexsort((start, version, doc, run, anchor))
        anchor, run, doc, version, start, length = (x[o] for x in (anchor, run, doc, version, start, length))
        same = np.zeros(len(o), dtype=bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (run[1:] == run[:-1])
        holder = np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))
        itself = (doc == doc[holder]) & (version == version[holder]) & (start == start[holder])
        later = same & ~itself
        yield _spans(0, *(x[~same] for x in (anchor, run, doc, version, start, length)))
        if later.any():
            d, v, s, n = (x[later] for x in (doc, version, start, length))
            pair, which = np.unique(np.stack([d, v], axis=1), axis=0, return_inverse=True)
            which, s, n = _merged(which.ravel(), s, n)
            d, v = pair[which, 0], pair[which, 1]
            yield _spans(1, _mixed(d.view(np.uint64) + s.view(np.uint64)), np.zeros(len(d), np.int64), d, v, s, n)


def _by_anchor(batches):
    """Sorted runs in: marks of later equals (kind 1), and the runs whose anchor has another (kind 2)."""
    key = first = None      # (anchor, run) of the last row; the earliest row of the last run, with its anchor's state
    shared = False          # the held run's anchor has an earlier run
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        kind = cols[0]
        passed = kind == 1
        if passed.any():
            yield _spans(1, *(c[passed] for c in cols[1:]))
        anchor, run, doc, version, start, length = (c[~passed] for c in cols[1:])
        if not len(anchor):
            continue
        if first is not None:
            anchor, run, doc, version, start, length = (np.concatenate([[f], x]) for f, x in zip(first, (anchor, run, doc, version, start, length)))
        same = np.zeros(len(anchor), dtype=bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (run[1:] == run[:-1])
        holder = np.maximum.accumulate(np.where(same, 0, np.arange(len(anchor))))
        later = same & ~((doc == doc[holder]) & (version == version[holder]) & (start == start[holder]))
        if later.any():
            yield _spans(1, *(x[later] for x in (anchor, run, doc, version, start, length)))
        heads = np.flatnonzero(~same)
        joint = np.zeros(len(heads), dtype=bool)
        joint[1:] = anchor[heads][1:] == anchor[heads][:-1]
        joint[0] = shared
        want = joint.copy()
        want[:-1] |= joint[1:]
        out = heads[:-1][want[:-1]]
        if len(out):
            yield _spans(2, *(x[out] for x in (anchor, run, doc, version, start, length)))
        tail = heads[-1]
        first = tuple(x[tail] for x in (anchor, run, doc, version, start, length))
        shared = bool(joint[-1])
    if shared:
        yield _spans(2, *(np.array([x]) for x in first))


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``depth`` symbols (of 9 bits)."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = (key << 9) | padded[j:n + j]
    have = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        new = np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)]).cumsum()
        rank[order] = new + 1
        if have >= depth or new[-1] == n - 1:
            return order
        key = rank * (n + 2)
        key[:max(0, n - have)] += rank[have:]
        have *= 2


def equal_prefixes(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and, for each of its rows, whether the common prefix with the row before is under ``size``.

    Breadth-first over the intervals of strings of growing length: an interval is extended to the
    left by each symbol of the Burrows-Wheeler transform in it, the row after a new interval gets
    the present length as its common prefix if it has none yet, and only intervals that set one
    are extended further.
    """
    n = len(symbols)
    order = suffix_array(symbols, size)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    step = place[order - 1]            # the row of the suffix one symbol longer (closing to a ring at the start)
    head = symbols[order]
    border = np.zeros(n + 1, dtype=bool)
    border[0] = border[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(size):
        width = high - low
        total = int(width.sum())
        if not total:
            break
        rows = np.repeat(low - np.concatenate([[0], width.cumsum()[:-1]]), width) + np.arange(total)
        owner = np.repeat(np.arange(len(low)), width)
        to = step[rows]
        o = np.argsort(to)
        to, owner = to[o], owner[o]
        new = np.ones(total, dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (head[to[1:]] != head[to[:-1]]) | (to[1:] != to[:-1] + 1)
        begin = np.flatnonzero(new)
        low, high = to[begin], to[np.append(begin[1:] - 1, total - 1)] + 1
        fresh = ~border[high]
        border[high[fresh]] = True
        low, high = low[fresh], high[fresh]
    return order, border[:n]


def later_windows(pieces: list[tuple[int, int, int, bytes]], size: int) -> list[tuple[int, int, int, int]]:
    """(doc, version, start, length) of spans whose windows occur earlier among ``pieces`` (doc, version, start, bytes)."""
    symbols = np.concatenate([np.concatenate([np.frombuffer(p[3], np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]) for p in pieces])
    order, border = equal_prefixes(symbols, size)
    lengths = np.array([len(p[3]) + 1 for p in pieces])
    begin = np.cumsum(lengths) - lengths
    group = np.cumsum(border)
    piece = np.searchsorted(begin, order, side="right") - 1
    at = order - begin[piece]
    whole = at + size < lengths[piece]
    group, piece, at = group[whole], piece[whole], at[whole]
    many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    group, piece, at = group[many], piece[many], at[many]
    if not len(group):
        return []
    doc, version, start = (np.array([p[i] for p in pieces], dtype=np.int64) for i in range(3))
    d, v, s = doc[piece], version[piece], start[piece] + at
    o = np.lexsort((s, v, d, group))
    group, piece, at, d, v, s = (x[o] for x in (group, piece, at, d, v, s))
    head = np.ones(len(group), dtype=bool)
    head[1:] = group[1:] != group[:-1]
    holder = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    later = (d != d[holder]) | (v != v[holder]) | (s != s[holder])
    which, s, n = _merged(piece[later], s[later], np.full(int(later.sum()), size))
    return list(zip(doc[which].tolist(), version[which].tolist(), s.tolist(), n.tolist()))


def meeting(pieces: list[tuple[int, int, int, bytes]], size: int) -> list[tuple[int, int, int, bytes]]:
    """The pieces that hold a window whose hash comes more than once; the others hold no equal window."""
    data = np.frombuffer(b"".join(p[3] for p in pieces), dtype=np.uint8)
    lengths = np.array([len(p[3]) for p in pieces])
    windows = np.maximum(lengths - size + 1, 0)
    if windows.sum() < 2:
        return []
    owner = np.repeat(np.arange(len(pieces)), windows)
    at = np.arange(len(owner)) + np.repeat((np.cumsum(lengths) - lengths) - (np.cumsum(windows) - windows), windows)
    powers = np.multiply.accumulate(np.full(len(data), _B, dtype=np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_T2[data] * powers)])
    back = np.multiply.accumulate(np.full(len(data), _INVERSE, dtype=np.uint64))
    h = (prefix[at + size] - prefix[at]) * back[at]
    o = np.argsort(h)
    same = h[o][1:] == h[o][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[o[1:][same]] = twice[o[:-1][same]] = True
    return [pieces[i] for i in np.unique(owner[twice]).tolist()]


def _compare(batches, size: int, block: int):
    """Runs sorted by anchor in, marks out; whole anchors are compared, many in one block.

    Most runs share an anchor and no window; only those that may share one are transformed.
    """
    held, total, anchor = [], 0, None

    def done():
        found = []
        if total <= 8 * block:
            met = meeting(held, size)
            found = later_windows(met, size) if met else []
        else:  # equal windows have equal checksums, so an overgrown anchor is searched in parts
            parts = total // block + 1
            for i in range(parts):
                own = [(d, v, s + at, data[at:at + size]) for d, v, s, data in held for at in range(len(data) - size + 1) if zlib.crc32(data[at:at + size]) % parts == i]
                found += later_windows(own, size) if own else []
        d, v, s, n = (np.array(x, dtype=np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        zero = np.zeros(len(d), np.int64)
        return _spans(1, zero, zero, d, v, s, n)

    for b in slices(batches, 1024):
        for a, d, v, s, data in zip(*(b.column(i).to_pylist() for i in range(5))):
            if a != anchor and total >= block:
                yield done()
                held, total = [], 0
            anchor = a
            held.append((d, v, s, data))
            total += len(data)
    if held:
        yield done()


def _keyed(docs: DataFrame) -> DataFrame:
    source = wanted(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), "text")
    repeated = not source.groupBy("doc").count().where("count > 1").limit(1).isEmpty()
    version = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return source.select("doc", version.alias("version"), "text")


def _frequent(source: DataFrame, size: int) -> np.ndarray:
    """Anchors that many documents of a bounded sample share; they only steer which anchor a window takes."""
    rows = source.count()
    sample = source if rows <= SAMPLE else source.sample(SAMPLE / rows, seed=7)

    def run(batches):
        for part in _parts(batches, size):
            anchor, _, doc, version, _, _ = _cut(part, size, np.zeros(0, np.uint64))
            one = np.unique(np.stack([anchor.view(np.int64), doc, version], axis=1), axis=0)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(one))], names=["anchor"])

    common = sample.mapInArrow(run, "anchor long").groupBy("anchor").count().where(F.col("count") > max(20, min(rows, SAMPLE) // 500))
    top = common.orderBy(F.desc("count"), "anchor").limit(FREQUENT).collect()
    return np.sort(np.array([r["anchor"] for r in top], dtype=np.int64).view(np.uint64))


def repeated_spans(source: DataFrame, size: int = 100, block: int = BLOCK) -> DataFrame:
    """(doc, version, start, length) of spans to remove; they may overlap."""
    frequent = _frequent(source, size)
    cut = source.mapInArrow(lambda it: _earlier(it, size, frequent), SPANS)
    sorted_runs = cut.repartition("anchor").sortWithinPartitions("kind", "anchor", "run", "doc", "version", "start")
    judged = durable(sorted_runs.mapInArrow(_by_anchor, SPANS))
    asked = judged.where("kind = 2").groupBy("doc", "version").agg(F.collect_list(F.struct("anchor", "start", "length")).alias("asked"))

    def texts(batches):
        for b in slices(batches, 64):
            a, d, v, s, data = [], [], [], [], []
            for doc, version, text, asks in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for x in asks:
                    a.append(x["anchor"]), d.append(doc), v.append(version), s.append(x["start"])
                    data.append(raw[x["start"]:x["start"] + x["length"]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64()), pa.array(data, pa.binary())],
                                             names=["anchor", "doc", "version", "start", "data"])

    one = source.join(asked, ["doc", "version"]).select("doc", "version", "text", "asked")
    pieces = one.mapInArrow(texts, "anchor long, doc long, version long, start long, data binary")
    compared = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc", "version", "start").mapInArrow(lambda it: _compare(it, size, block), SPANS)
    return durable(compared.select("doc", "version", "start", "length")).unionByName(judged.where("kind = 1").select("doc", "version", "start", "length"))


def remove_repeats(docs: DataFrame, size: int = 100, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes), a row per document."""
    source = _keyed(docs)
    marks = repeated_spans(source, size, block).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "length")).alias("marks"))

    def run(batches):
        for b in slices(batches):
            total, gone, spans, kept = [], [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                at, out, n, removed = 0, [], 0, 0
                end = -1
                for s, e in sorted((m["start"], m["start"] + m["length"]) for m in found or []):
                    if s > end:
                        n += 1
                        out.append(raw[at:s])
                        end = s
                    if e > end:
                        removed += e - end
                        at = end = e
                out.append(raw[at:])
                total.append(len(raw)), gone.append(removed), spans.append(n), kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = source.join(marks, ["doc", "version"], "left").select("doc", "text", "marks")
    out = joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("doc") != LEAST, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digests(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` with the kept bytes as a digest."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
