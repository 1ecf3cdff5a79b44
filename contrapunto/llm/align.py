"""Alignment of two tokenizers' tokens by diagonal run skipping.

A text, with a space before it, is encoded by A (byte-level BPE) and by B (pieces with byte fallback, which adds
that space itself).  Both token sequences must give back exactly these bytes; where one does not (signs
that B folds or cannot write), the text has no tokens.  The ends of the tokens are byte offsets, and where
an A token and a B token end alike, both sequences are cut: the tokens between two cuts are a group.

``segments`` finds the groups by comparing the two arrays of ends at the current index shift.  The arrays are kept
as differences, a byte a token: behind a common cut, ends agree as long as the sizes do.  While they agree, it
probes 4, 8, 16, ... further entries at once and narrows the last probe, so a stretch of one-to-one tokens costs
a number of slice comparisons that grows with its logarithm.  Where they part, the ends are merged one by
one until they meet: an irregular group, after which the shift is another one.

Linked are all pairs of an A and a B token of one group.  The count of an id pair is the number of documents
that hold it linked (``translation``).  To look the counts up, documents are taken in chunks of about
``CHUNK`` bytes: a chunk lists its different pairs once, and only this list is joined with the counts, so a
pair that is in every document costs a row a chunk.  Chunk lists and documents meet again by a shuffle
on the chunk.

Null and empty texts have no tokens.  Equal texts count as documents of their own; null and repeated ids stay
as they are, one row out for each row in.  Empty tables give no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from contrapunto.llm.common import durable, slices

CHUNK = 4 << 20      # bytes of text a chunk holds, or one text
LONG = 1 << 20       # longer texts are not given to the fast encoder, whose pattern search has a limit
WIDE = 1 << 12       # links of a group from which on its pairs are counted, not listed
Segment = tuple[int, int, int, int, bool]


def _byte_of() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            text = f.read()
        spec, byte_of = json.loads(text), _byte_of()
        added = {t["content"] for t in spec.get("added_tokens", ()) if t.get("special")}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.text_a, self.slow_a = text, None
        # ids are in merge order, so they are the ranks
        self.fast_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.size_a, self.size_b = ([len(t) for t in own] for own in (self.bytes_a, self.bytes_b))
        if max(*self.size_a, *self.size_b) > 255:
            raise ValueError("a token of more than 255 bytes")
        self.name_a, self.name_b = ([str(i) for i in range(len(own))] for own in (self.bytes_a, self.bytes_b))

    @classmethod
    @functools.cache
    def of(cls, a_path: str, pattern: str, b_path: str) -> Pair:
        return cls(a_path, pattern, b_path)

    def _encode_a(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.fast_a.encode_ordinary(text)
        if self.slow_a is None:
            from tokenizers import Tokenizer

            self.slow_a = Tokenizer.from_str(self.text_a)
            self.slow_a.encode_special_tokens = True
        return self.slow_a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B; both empty where there are no tokens."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1) if texts else []):
            a, raw = self._encode_a(" " + text) if text else [], b" " + text.encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            out.append((a, b) if same else ([], []))
        return out

    def segments(self, a: list[int], b: list[int]) -> list[Segment]:
        return segments(bytes(map(self.size_a.__getitem__, a)), bytes(map(self.size_b.__getitem__, b)))


def segments(a: bytes, b: bytes) -> list[Segment]:
    """(from, to) in A, (from, to) in B, and whether it is a stretch of one-to-one groups or one group.

    ``a`` and ``b`` are the sizes of the tokens; both sum up to the same number of bytes.
    """
    out, i, j, n = [], 0, 0, len(a)
    while i < n:
        i0, j0, x, y = i, j, a[i], b[j]
        if x == y:
            i, j, step = i + 1, j + 1, 4
            while (ahead := a[i:i + step]) and ahead == b[j:j + step]:
                i, j, step = i + len(ahead), j + len(ahead), step * 2
            while step > 4:  # the probe that failed holds the end of the stretch
                step //= 2
                ahead = a[i:i + step]
                if len(ahead) == step and ahead == b[j:j + step]:
                    i, j = i + step, j + step
            while i < n and a[i] == b[j]:
                i, j = i + 1, j + 1
            out.append((i0, i, j0, j, True))
        else:
            while x != y:
                if x < y:
                    i += 1
                    x += a[i]
                else:
                    j += 1
                    y += b[j]
            i, j = i + 1, j + 1
            out.append((i0, i, j0, j, False))
    return out


def cuts(parts: list[Segment]) -> np.ndarray:
    """(a_from, a_to, b_from, b_to) of every group, a row each."""
    if not parts:
        return np.zeros((0, 4), dtype=np.int64)
    i, i2, j, j2, single = np.fromiter(chain.from_iterable(parts), dtype=np.int64, count=5 * len(parts)).reshape(-1, 5).T
    many = np.where(single == 1, i2 - i, 1)  # groups of a segment
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    one, first_a, first_b = np.repeat(single == 1, many), np.repeat(i, many) + at, np.repeat(j, many) + at
    return np.stack([first_a, np.where(one, first_a + 1, np.repeat(i2, many)), first_b, np.where(one, first_b + 1, np.repeat(j2, many))], axis=1)


def links(a: list[int], b: list[int], parts: list[Segment]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Different linked id pairs (a << 32 | b, ascending), how often each is linked, number of groups, number of links."""
    groups_ = cuts(parts)
    low_a, high_a, low_b, high_b = groups_.T
    size = (high_a - low_a) * (high_b - low_b)
    listed = size < WIDE
    n, wide_b = np.where(listed, size, 0), high_b - low_b
    # every pair of a group by its number in it
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, column = np.divmod(at, np.repeat(wide_b, n))
    ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    keys, count = np.unique((ids_a[np.repeat(low_a, n) + row] << 32) | ids_b[np.repeat(low_b, n) + column], return_counts=True)
    if not listed.all():
        total = Counter(dict(zip(keys.tolist(), count.tolist())))
        for i, i2, j, j2 in groups_[~listed].tolist():
            times = Counter(b[j:j2]).items()
            for x, m in Counter(a[i:i2]).items():
                for y, k in times:
                    total[x << 32 | y] += m * k
        keys = np.array(sorted(total), dtype=np.int64)
        count = np.array([total[k] for k in keys.tolist()], dtype=np.int64)
    return keys, count, len(groups_), int(size.sum())


def written(pair: Pair, a: list[int], b: list[int], parts: list[Segment]) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``."""
    x, y = list(map(pair.name_a.__getitem__, a)), list(map(pair.name_b.__getitem__, b))
    out = []
    for i, i2, j, j2, single in parts:
        if single:
            out += map("|".join, zip(x[i:i2], y[j:j2]))
        else:
            out.append(",".join(x[i:i2]) + "|" + ",".join(y[j:j2]))
    return ";".join(out)


def groups(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """``doc_id``, ``a`` and ``b`` (ids), and ``groups`` as (a_from, a_to, b_from, b_to), ends excluded."""
    cell = pa.struct([(n, pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to")])

    def run(batches):
        pair = Pair.of(a_path, pattern, b_path)
        for batch in slices(batches):
            own = pair.encode([t or "" for t in batch.column(1).to_pylist()])
            found = [cuts(pair.segments(a, b)).tolist() for a, b in own]
            ids = [pa.array([x[k] for x in own], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ids, pa.array([[dict(zip(("a_from", "a_to", "b_from", "b_to"), g)) for g in c] for c in found], pa.list_(cell))], names=["doc_id", "a", "b", "groups"])

    own = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    return own.mapInArrow(run, "doc_id long, a array<int>, b array<int>, groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>")


_PARTS = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("docs", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                    ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
_DDL = "chunk long, key long, pos int, docs long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in _PARTS], schema=_PARTS)


def _parts(docs: DataFrame, a_path: str, pattern: str, b_path: str, chunk_bytes: int) -> DataFrame:
    """Rows of two kinds: a chunk's different pairs (``pos`` set), and its documents, whose ``pairs`` (four bytes each) name positions in that list."""
    def run(batches):
        pair, task, number = Pair.of(a_path, pattern, b_path), TaskContext.get().partitionId(), 0
        rows, held = [], 0

        def done():
            chunk, sizes = (task << 32) | number, [len(r[6]) for r in rows]
            keys, at, n = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True, return_counts=True)
            yield _batch(len(keys), chunk=pa.array(np.full(len(keys), chunk)), key=pa.array(keys), pos=pa.array(np.arange(len(keys)), pa.int32()), docs=pa.array(n))
            cut = np.split(at.astype(np.int32), np.cumsum(sizes)[:-1])
            for s in range(0, len(rows), 256):
                own = rows[s:s + 256]
                plain = {name: pa.array([r[k] for r in own], _PARTS.field(name).type) for k, name in enumerate(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"))}
                yield _batch(len(own), chunk=pa.array(np.full(len(own), chunk)), **plain, pairs=pa.array([c.tobytes() for c in cut[s:s + 256]], pa.binary()), times=pa.array([r[7].tobytes() for r in own], pa.binary()))

        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, text, (a, b) in zip(batch.column(0).to_pylist(), texts, pair.encode(texts)):
                parts = pair.segments(a, b)
                keys, times, n_groups, n_links = links(a, b, parts)
                sha = hashlib.sha256(written(pair, a, b, parts).encode()).hexdigest() if a else ""
                rows.append((i, len(a), len(b), n_groups, n_links, sha, keys, times.astype(np.int32 if n_links < 1 << 31 else np.int64)))
                held += len(text)
                if held >= chunk_bytes:
                    yield from done()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield from done()

    own = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    return durable(own.mapInArrow(run, _DDL))


def _counted(parts: DataFrame) -> DataFrame:
    """``key``, ``n`` (documents that hold the pair linked) and ``best`` (no pair of its A id has more)."""
    n = durable(parts.where("pos is not null").groupBy("key").agg(F.sum("docs").alias("n")))
    a = F.shiftright("key", 32)
    top = n.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return n.join(top, a == F.col("a")).select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def translation(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """``a``, ``b`` (ids), ``n`` and ``best``, a row for each linked id pair of the corpus."""
    own = _counted(_parts(docs, a_path, pattern, b_path, CHUNK))
    return own.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n", "best")


def alignment(docs: DataFrame, a_path: str, pattern: str, b_path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Per document: its numbers of tokens, groups and links, of best links, and the sum of the links' counts."""
    parts = _parts(docs, a_path, pattern, b_path, chunk_bytes)
    looked = parts.where("pos is not null").select("chunk", "key", "pos").join(_counted(parts), "key").select("chunk", "pos", "n", "best")
    own = parts.where("pos is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        chunk, n, best = None, np.zeros(0, np.int64), np.zeros(0, bool)

        def room(size):  # the list of a chunk comes in any order
            nonlocal n, best
            if size > len(n):
                n, best = (np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)]) for x in (n, best))

        for b in batches:
            ids, pos = b.column(0).to_numpy(), b.column(1).fill_null(-1).to_numpy()
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | ((pos[1:] < 0) != (pos[:-1] < 0))) + 1).tolist(), len(ids)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if ids[low] != chunk:
                    chunk, n, best = ids[low], np.zeros(0, np.int64), np.zeros(0, bool)
                if pos[low] >= 0:
                    at = pos[low:high]
                    room(int(at.max()) + 1)
                    n[at] = b.column(2).slice(low, high - low).to_numpy()
                    best[at] = b.column(3).slice(low, high - low).to_numpy(zero_copy_only=False)
                    continue
                cells = b.slice(low, high - low)
                sums = [[], []]
                for links_, p, m in zip(cells.column(8).to_pylist(), cells.column(10).to_pylist(), cells.column(11).to_pylist()):
                    at, m = np.frombuffer(p, np.int32), np.frombuffer(m, np.int32 if links_ < 1 << 31 else np.int64).astype(np.int64)
                    sums[0].append(int(m[best[at]].sum()))
                    sums[1].append(int(m @ n[at]))
                more = [pa.array(v, pa.int64()) for v in sums]
                yield pa.RecordBatch.from_arrays([*cells.columns[4:9], *more, cells.column(9)], names=names)

    both = looked.unionByName(own, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("pos").isNull())
    return both.select("chunk", "pos", "n", "best", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
