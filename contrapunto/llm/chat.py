"""Chat formatting with offset-aligned loss masks.

A turn is written ``### role: text </turn>`` and a line end.  In texts and roles a backslash goes before
each backslash, ``###`` and ``</turn>`` (in roles also before a colon), so marks are told from text and
everything can be read back.

Rows are range-partitioned by conversation and turn, so a conversation of any length is spread over tasks;
each task renders runs of turns (parts), encodes a part once with byte offsets and intersects the
sorted spans of the assistant's texts with the token spans by binary search.  A part begins at a turn's
mark, where the tokenizer always splits.  Reading back streams the parts in order.

A null text or role reads as empty, a null turn comes first; rows that tie on the turn are ordered by
role and text, and repeated rows are turns of their own.  Null conversation ids form one conversation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.bpe import Codec
from contrapunto.llm.common import slices, wanted

PART_TURNS, PART_CHARS = 64, 1 << 18
_CONTROL, _ROLE_CONTROL = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)


def escaped(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The formatted bytes of (role, text) turns and the byte spans of the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escaped(role, _ROLE_CONTROL)}: ".encode("utf-8", "surrogatepass"), escaped(text).encode("utf-8", "surrogatepass")
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, b" </turn>\n"]
        at += len(head) + len(body) + 9
    return b"".join(out), spans


def masked(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (by the byte where each ends) overlap one of the sorted spans."""
    mask = np.zeros(len(ends) + 1, dtype=np.int64)
    if spans:
        begin, end = np.array(spans).T
        np.add.at(mask, np.searchsorted(ends, begin, side="right"), 1)      # first token that ends after the span begins
        np.add.at(mask, np.searchsorted(ends, end, side="left") + 1, -1)    # one past the token that holds the span's last byte
    return mask.cumsum()[:-1] > 0


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted part."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


FORMAT = "conv_id long, part long, formatted string, ids array<int>, loss array<boolean>, spans array<struct<begin:long,end:long>>"


def formatted(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Parts of conversations with their text, token ids, loss mask and the assistant's byte spans."""
    source = wanted(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.spark_partition_id().alias("task"))

    def run(batches):
        codec, widths = Codec.of(path, pattern), None
        widths = codec.machine.width
        held, chars, conv, part, task = [], 0, None, 0, 0

        def done():
            data, spans = rendered(held)
            ids = codec.encode(data.decode("utf-8", "surrogatepass"))
            ends = np.cumsum([widths[i] for i in ids]) if ids else np.zeros(0, np.int64)
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "part": (task << 32) + part, "formatted": data.decode("utf-8", "surrogatepass"), "ids": ids,
                                                "loss": masked(ends, spans).tolist(), "spans": [{"begin": a, "end": b} for a, b in spans]}], schema=schema)

        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
                            ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
        for b in slices(batches):
            for c, role, text, task in zip(*(x.to_pylist() for x in b.columns)):
                if held and (c != conv or len(held) >= PART_TURNS or chars >= PART_CHARS):
                    yield done()
                    held, chars, part = [], 0, part + 1
                conv = c
                held.append((role, text))
                chars += len(text)
        if held:
            yield done()

    return dealt.mapInArrow(run, FORMAT)


def read_back(parts: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each conversation, from its formatted parts: turns, and the text under the loss mask.

    A digest of a whole conversation is sequential, so its parts stream through one task in order; only the
    running hashes are held.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        widths = Codec.of(path, pattern).machine.width
        conv, state, out = None, None, []

        def done():
            n, turns, chars, loss, total = state
            out.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total})

        for b in slices(batches, 64):
            for c, text, ids, mask, spans in zip(*(x.to_pylist() for x in b.columns)):
                if state is None or c != conv:
                    if state is not None:
                        done()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parsed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                data = text.encode("utf-8", "surrogatepass")
                ends = np.cumsum([widths[i] for i in ids])
                on = np.flatnonzero(np.array(mask, dtype=bool))
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                for s in spans:  # masked tokens of this span, cut to it
                    own = on[np.searchsorted(ends[on], s["begin"], side="right"):np.searchsorted(begins[on], s["end"], side="left")]
                    piece = b"".join(data[max(int(begins[i]), s["begin"]):min(int(ends[i]), s["end"])] for i in own.tolist())
                    plain = unescaped(piece.decode("utf-8", "surrogatepass"))
                    state[2] += len(plain)
                    state[3].update(plain.encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if state is not None:
            done()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "ids", "loss", "spans")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
