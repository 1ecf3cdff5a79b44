"""Components that go on from earlier ones, in fewer rounds."""

import random

from contrapunto.llm import components as C


def test_known_roots_are_gone_on_from(spark, monkeypatch):
    rng = random.Random(5)
    nodes = [rng.randrange(-10**12, 10**12) for _ in range(300)]
    first, more = list(zip(nodes[:200], nodes[1:201])), [(nodes[0], nodes[250]), (nodes[260], nodes[270])]
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    table, written = links(first), []
    known = C.components(table)
    durable = C.durable
    monkeypatch.setattr(C, "durable", lambda df: written.append(1) or durable(df))
    got = {r.node: r.root for r in C.components(links(first + more), known).collect()}
    rounds = (len(written) - 2) // 2
    chain, pair = nodes[:201] + [nodes[250]], [nodes[260], nodes[270]]
    assert got == {**{n: min(chain) for n in chain}, **{n: min(pair) for n in pair}}
    written.clear()
    assert {r.node: r.root for r in C.components(links(first + more)).collect()} == got
    assert rounds < (len(written) - 2) // 2
