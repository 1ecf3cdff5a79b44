"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly when each two neighbours are the
encoding of theirs.  So a nondeterministic machine that guesses token borders has as its state
only the last finished token and the bytes read since.  ``Transducer`` determinises it on
demand: a state is the set of surviving guesses, none longer than the longest token; tokens are
emitted as soon as one guess survives.  Moves are memoised in a table of bounded size, emptied
when full.  Most short pieces are met once, so that their moves would be made and never used again:
they follow the same machine's guesses depth first, the longest token first.  No two paths lead to
one place, so a place that was left without success is never entered again.

Decoding maps ids to bytes and runs them through an incremental UTF-8 state machine, which
holds back at most three bytes of an unfinished character between chunks.

Nulls encode as empty texts: no tokens.  Repeated rows and ties are rows like any other.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import slices, texts, wanted

MAX_STATES = 250_000   # moves of the determinised machine kept before the table is emptied
MAX_PAIRS = 500_000    # answers kept to whether one token may follow another
MAX_PIECES = 250_000   # encoded pieces kept per worker
MAX_PIECE_BYTES = 64   # longer pieces are encoded but not kept
#: The given pretokenizer pattern (fixed value), and the same choice with the most frequent class first and no
#: backtracking: the classes exclude each other, so their order does not matter.
GIVEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BY_CLASS = r""" ?+\p{L}++| ?+\p{N}++|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
#: The same over the first 256 code points, whose letters and numbers are listed, for texts that hold no others.
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
BY_LATIN_CLASS = rf""" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"""
#: What either engine treats differently: code points past 255 and the four information separators.
CONTROLS = re.compile("[\x1c-\x1f\u0100-\U0010ffff]")
INFINITE = float("inf")
CHUNK = 65_536         # ids decoded at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Transducer:
    """Bytes in, token ids out, left to right."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.width = {i: len(b) for b, i in ranks.items()}
        # a trie of the tokens' bytes: 256 * node + byte leads to (node or 0 if no token goes on, token or -1)
        number = {b"": 0}
        for b in ranks:
            for n in range(1, len(b)):
                number.setdefault(b[:n], len(number))
        self.trie = {256 * at + b[-1]: (number.get(b, 0), ranks.get(b, -1)) for b in {*ranks, *number} if b and (at := number.get(b[:-1])) is not None}
        # the longest token that each token begins with, itself left out (or -1)
        self.shorter = {i: next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1) for b, i in ranks.items()}
        self.max_states = max_states
        self.pairs: dict[tuple[int, int], bool] = {}
        self.heads: dict[int, list[tuple[bytes, float]]] = {}
        self.tails: dict[int, list[tuple[bytes, float]]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0),)
        self.number = {start: 0}
        self.states = [start]
        #: by 256 * state + byte: the next state, the token that ends here (or -1), whether one guess is left
        self.moves: dict[int, tuple[int, int, bool]] = {}

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """Parts at one edge of a token while it is merged, each with the rank that absorbs it.

        Empty if merging the token's bytes does not give the token.
        """
        data = self.token[token]
        parts = [data[i:i + 1] for i in range(len(data))]
        edge = []
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                return []
            rank, at = min(ranked)
            if at == (len(parts) - 2 if right else 0):
                edge.append((parts[-1] if right else parts[0], rank))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        edge.append((data, INFINITE))
        return edge

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding; ``left`` -1 is the start.

        Both tokens grow from bytes as their merges come due.  They stay apart if no pair of
        parts that meet at the border has a rank before either part is absorbed elsewhere
        (of equal ranks the left merge comes first).
        """
        b = self.heads.get(right)
        if b is None:
            b = self.heads[right] = self._edge(right, False)
        if left < 0 or not b:
            return bool(b)
        a = self.tails.get(left)
        if a is None:
            a = self.tails[left] = self._edge(left, True)
        i = j = 0
        while True:
            x, gone_x = a[i]
            y, gone_y = b[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < gone_x and rank <= gone_y:
                return False
            if gone_x is INFINITE and gone_y is INFINITE:
                return True
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> tuple[int, int, bool]:
        guesses, ended, step, fits = [], -1, self.trie.get, self.fits
        for last, node in self.states[state]:
            found = step(256 * node + byte)
            if found:
                node, token = found
                if token >= 0 and ended < 0 and fits(last, token):
                    guesses.append((token, 0))
                    ended = token
                if node:
                    guesses.append((last, node))
        if not guesses:
            raise ValueError(f"byte {byte} is in no token")
        target = tuple(guesses)
        number = self.number.get(target)
        if number is None:
            number = len(self.states)
            self.number[target] = number
            self.states.append(target)
        move = (number, ended, ended >= 0 and len(guesses) == 1)
        self.moves[256 * state + byte] = move
        return move

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece (the pretokenizer's match).

        Each prefix has one encoding, so the token that ends at a place leads back to the place
        where it begins.  That chain is emitted as soon as a single guess survives.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= MAX_PIECE_BYTES:
            return self._followed(data)
        return self._streamed(data)

    def _followed(self, data: bytes) -> list[int]:
        """Guesses followed depth first."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        size, path, at, last, left = len(data), [], 0, -1, set()
        step, known, width, shorter = self.trie.get, self.pairs.get, self.width, self.shorter
        while True:
            token, node = -1, 0
            for byte in data[at:]:
                found = step(256 * node + byte)
                if not found:
                    break
                node, ends = found
                if ends >= 0:
                    token = ends
                if not node:
                    break
            while True:
                while token < 0:  # no token leads on from here
                    if not path:
                        raise ValueError("no encoding: the vocabulary lacks a byte")
                    left.add(at)
                    token = path.pop()
                    at -= width[token]
                    last, token = path[-1] if path else -1, shorter[token]
                end = at + width[token]
                if end not in left:
                    fit = known((last, token))
                    if fit is None:
                        fit = self.pairs[last, token] = self.fits(last, token)
                    if fit:
                        break
                token = shorter[token]
            path.append(token)
            if end == size:
                return path
            at, last = end, token

    def _streamed(self, data: bytes) -> list[int]:
        """Guesses followed side by side by the determinised machine."""
        if len(self.moves) > self.max_states:
            self._reset()
        out: list[int] = []
        ended: list[int] = []  # since the last emission
        state, get = 0, self.moves.get
        for byte in data:
            state, token, sure = get(256 * state + byte) or self._move(state, byte)
            ended.append(token)
            if sure:
                out.extend(self._chain(ended))
                ended = []
        return out + self._chain(ended)

    def _chain(self, ended: list[int]) -> list[int]:
        at, back = len(ended), []
        while at > 0:
            token = ended[at - 1]
            if token < 0:
                raise ValueError("no encoding: the vocabulary lacks a byte")
            back.append(token)
            at -= self.width[token]
        return back[::-1]


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the finished characters, ``close`` what is left.

    Only the tail of a chunk can be unfinished, so the state machine runs over the bytes from
    its last lead byte on; malformed bytes become U+FFFD, as in a whole decode.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Number of trailing bytes (0 to 3) that begin a character and may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead < 0xC0:
                continue
            need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte's range depends on the lead
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


class Codec:
    """A rank file and a pretokenizer pattern; one per worker process."""

    _kept: dict[tuple[str, str], "Codec"] = {}

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self.pattern = regex.compile(BY_CLASS if pattern == GIVEN else pattern)
        self.latin = re.compile(BY_LATIN_CLASS) if pattern == GIVEN else None
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.decimal = {i: str(i) for i in self.machine.token}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def splitter(self, text: str):
        """The compiled pattern for this text; what it matches is the same for any choice."""
        if self.latin and not CONTROLS.search(text):
            return self.latin
        return self.pattern

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        if ids is None:
            data = text.encode("utf-8", "surrogatepass")
            ids = tuple(self.machine.encode(data))
            if len(data) <= MAX_PIECE_BYTES:
                if len(self.pieces) >= MAX_PIECES:
                    self.pieces.clear()
                self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        piece = self.piece
        return list(chain.from_iterable(map(piece, self.splitter(text).findall(text))))

    def offsets(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, ids) of each piece, in code points."""
        for m in self.splitter(text).finditer(text):
            yield m.start(), m.end(), self.piece(m[0])

    def decode(self, ids: Iterable[int]) -> str:
        stream, token = Utf8Stream(), self.machine.token
        ids = ids if isinstance(ids, list) else list(ids)
        out = [stream.feed(b"".join(map(token.__getitem__, ids[at:at + CHUNK]))) for at in range(0, len(ids), CHUNK)]
        return "".join(out) + stream.close()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``doc_id``) and ``ids`` array<int>, the whole text's tokens."""
    keep = keep or ["doc_id"]
    source = wanted(docs, *keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", ids array<int>"

    def run(batches):
        codec = Codec.of(path, pattern)
        for b in slices(batches):
            ids = [codec.encode(t) for t in texts(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``doc_id``) and ``text``; a null array decodes as empty."""
    keep = keep or ["doc_id"]
    source = wanted(tokens, *keep, ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", text string"

    def run(batches):
        codec = Codec.of(path, pattern)
        for b in slices(batches):
            out = [codec.decode(x or []) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(out, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes each whole text, decodes the ids again, and returns digests of both, one row per document."""
    def run(batches):
        codec = Codec.of(path, pattern)
        for b in slices(batches):
            n, a, d = [], [], []
            for t in texts(b.column(1)):
                ids = codec.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = wanted(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

