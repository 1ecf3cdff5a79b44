"""The mix against plain targets and counts."""

import collections

import numpy as np
from pyspark.sql import functions as F

from contrapunto.llm import mix
from contrapunto.llm.queries import QUERIES


def plain_targets(rows):
    """Words of each source and its target, by water filling in floats."""
    size = collections.defaultdict(int)
    for _, source, text in rows:
        size[source] += len(mix.WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        share = {s: 3.0 * size[s] if s in capped else rest * weight[s] / free for s in names}
        new = {s for s in names if s not in capped and share[s] > 3 * size[s]}
        if not new:
            return size, share
        capped |= new


def compare(got, rows):
    size, share = plain_targets(rows)
    source = collections.defaultdict(list)
    for i, s, t in rows:
        source[i].append((s, len(mix.WORD.findall(t or ""))))
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _, _ in rows)
    sums = collections.defaultdict(int)
    for r in got:
        (own,) = {s for s, n in source[r["doc_id"]] if n == r["size"] and size[s] == r["source_size"]}
        assert abs(r["target"] - share[own]) < 1e-6 * max(1, share[own]) and 0 <= r["taken"] <= 3 * r["size"]
        sums[own] += r["taken"]
    assert all(abs(sums[s] - share[s]) <= 0.5 + 1e-6 for s in share)
    return sums


def triples(df):
    return [tuple(r) for r in df.select("doc_id", "source", "text").collect()]


def test_whole_table_and_reruns(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = QUERIES["op12_source_mix"](spark, data_dir).collect()
    compare(got, triples(docs))
    again = mix.taken(docs.repartition(7, "text")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    other = mix.taken(docs, seed=99).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, got))


def test_odd_rows(spark, docs, odd):
    rows = [(i, f"s{k % 3}" if k % 4 else None, t) for k, (i, t) in enumerate(odd)] + [(50, "\U0001f600", "a b"), (51, "￿", "c"), (52, "none", " \n "), (53, "none", None)]
    rows += [(None, "s0", "same words here")] * 9
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, source string, text string, row string, size int, s int")
    got = mix.taken(table)
    compare(got.collect(), rows)
    # code points, not UTF-16 units, order the sources
    _, share = plain_targets(rows)
    assert [s for s in sorted(share, key=lambda s: (s is None, s or ""))][-3:] == ["￿", "\U0001f600", None]
    assert mix.taken(docs([])).count() == 0 and mix.mixed(docs([])).count() == 0
    none = mix.taken(docs([(1, None), (2, " ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2


def test_draws_fill_the_shards(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    out = mix.mixed(docs, block=50, shard=80).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    per_shard, per_source = collections.Counter(r["shard"] for r in out), collections.defaultdict(collections.Counter)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and max(per_shard.values()) <= 80 and len(per_shard) > 20
    pieces = collections.defaultdict(dict)
    for r in out:
        per_source[texts[r["doc_id"]]["source"]][r["doc_id"], r["block"]] += 1
        pieces[r["doc_id"], r["round"]][r["block"]] = r["text"]
        assert len(mix.WORD.findall(r["text"])) == r["words"] <= 50
    for r in {(r["shard"]) for r in out}:
        assert sorted(x["place"] for x in out if x["shard"] == r) == list(range(per_shard[r]))
    # a block is drawn as often as any other of its source, or once more; whole rounds give whole texts
    for own in per_source.values():
        assert max(own.values()) - min(own.values()) <= 1
    whole = [(i, p) for (i, turn), p in pieces.items() if len(p) == -(-len(mix.WORD.findall(texts[i]["text"])) // 50)]
    exact = sum("".join(p[k] for k in sorted(p)) == texts[i]["text"] for i, p in whole)
    assert exact >= len(whole) - len(per_source) and whole
    # every source is spread over the shards in proportion
    big = max(per_source, key=lambda s: sum(per_source[s].values()))
    own = collections.Counter(r["shard"] for r in out if r["source"] == big)
    mean = sum(own.values()) / len(per_shard)
    assert all(abs(own[s] - mean) < 6 * mean ** 0.5 for s in per_shard)


def test_tree_is_exact_and_alike_in_parts():
    tree = mix.Tree.of([1000, 3, 0, 77_777], shard=512)
    source = np.repeat([0, 1, 3], [1000, 3, 77_777])
    item = np.concatenate([np.arange(n) for n in (1000, 3, 77_777)])
    shard = tree.place(source, item)
    assert np.bincount(shard).tolist() == [tree.start(k + 1) - tree.start(k) for k in range(tree.shards)]
    some = np.random.default_rng(1).permutation(len(item))[:500]
    assert (tree.place(source[some], item[some]) == shard[some]).all()
    for s in (0, 1, 3):  # a source's order is cut into consecutive runs
        assert (np.diff(shard[source == s]) >= 0).all()


def test_large_populations(monkeypatch):
    rng = np.random.default_rng(5)
    want = [rng.hypergeometric(30_000, 70_000, 50_000) for _ in range(3000)]
    monkeypatch.setattr(mix, "EXACT", 10)
    got = [mix._hypergeometric(rng, 30_000, 70_000, 50_000) for _ in range(3000)]
    assert abs(np.mean(got) - np.mean(want)) < 8 and 0.9 < np.std(got) / np.std(want) < 1.1
    assert all(mix._hypergeometric(rng, g, b, n) == k for g, b, n, k in ((0, 9, 5, 0), (9, 0, 5, 5), (4, 4, 8, 4), (4, 4, 0, 0)))
    left = mix.split(np.array([10 ** 12, 5, 0, 10 ** 10]), 10 ** 11, (0, 8))
    assert left.sum() == 10 ** 11 and left[2] == 0 and left[1] <= 5


def test_targets():
    assert mix.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert [float(t) for t in mix.targets([100, 1, 1], [1, 2, 3])] == [96, 3, 3]
    assert mix.targets([0, 0], [1, 2]) == [0, 0] and mix.targets([], []) == []
    assert mix.targets([0, 6], [1, 2]) == [0, 6]
