"""Short pieces are encoded without the determinised machine."""

import random

from contrapunto.llm import bpe
from contrapunto.llm.queries import tokenizer


def test_short_pieces_leave_no_moves():
    machine, rng = bpe.Codec(*tokenizer()).machine, random.Random(8)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 64))) for _ in range(300)] + [" erndedly".encode(), "é".encode() * 30, b"ab" * 32]
    got = [machine.encode(p) for p in pieces]
    assert not machine.moves and len(machine.pairs) > 300
    assert got == [[machine.ranks[p]] if p in machine.ranks else machine._streamed(p) for p in pieces]
