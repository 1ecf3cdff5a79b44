"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import collections
import random

import numpy as np

import corpus_pipeline
from contrapunto.llm import near, simhash


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) <= 5 else (b" ".join(w[i:i + 5]) for i in range(len(w) - 4)))


def brute_kept(rows):
    """Least id (nulls last) of each group of texts linked by five-word similarity 0.8 or more."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return sorted((rows[r][0] for r in set(root)), key=lambda i: (i is None, i or 0))


def kept_ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i or 0))


def edited_copies():
    """A chain of copies, each with other words changed, and a text just under the similarity."""
    words = [f"w{i}" for i in range(200)]
    change = lambda at: " ".join("x" + w if i in at else w for i, w in enumerate(words))
    return [(100, " ".join(words)), *[(101 + k, change({20 * k + 5, 20 * k + 12})) for k in range(8)], (120, change({5, 40, 75, 110, 145, 180})),
            *[(130 + k, change({3 + k, 60 + k, 140 + k})) for k in range(12)]]


def test_near_copies_odd_rows(spark, docs, odd):
    rows = list(odd) + edited_copies() + [(None, "no id"), (None, "another text"), (7, "other text of the same id")]
    want = brute_kept(rows)
    for chunk in (near.CHUNK, 3):  # the small one also deals a bucket to squares
        got = near.keep_one(docs(rows), chunk)
        assert got.columns == docs(rows).columns and kept_ids(got) == want
    assert collections.Counter(want)[7] == 2 and 9 in want  # one row of the repeated one, both texts of one id
    assert near.keep_one(docs([])).count() == 0


def test_near_copies_recall(spark, data_dir):
    folder = data_dir.replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute_kept([tuple(r) for r in table.select("doc_id", "text").collect()])
    assert kept_ids(corpus_pipeline.drop_near_copies(spark, table, folder)) == want


def test_dense_groups_and_leaders(spark, docs):
    """A hub with many copies, and copies whose hub is missing: most of their pairs are no links."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(150)]
    spoilt = lambda n: " ".join("q" + str(rng.random()) if i in own else w for own in [set(rng.sample(range(150), n))] for i, w in enumerate(words))
    other = [w + "z" for w in words]
    rows = [(k, spoilt(2)) for k in range(60)] + [(70, " ".join(words))]
    rows += [(100 + k, t.replace("v", "w")) for k, t in enumerate([spoilt(3) for _ in range(60)])] + [(200, " ".join(other))]
    want = brute_kept(rows)
    assert 2 < len(want) < 120
    table = docs(rows).withColumnRenamed("fp", "k1").withColumnRenamed("key", "node")
    for chunk, turns, few in ((near.CHUNK, near.TURNS, near.FEW), (16, 3, 2), (16, 0, 0)):
        got = near.keep_one(table, chunk, turns, few)
        assert got.columns == table.columns and kept_ids(got) == want
    # a task gives no more links than it has nodes
    sets, at = [near.shingles(t) for _, t in rows], np.arange(len(rows))
    own = near._joined(np.full(len(rows), 3), at, at, [s.view(np.int64).tolist() for s in sets])
    assert len(own) == len(rows) - len(want)
    assert near._sketched(np.full(len(rows), 3), at, at, [near._sketch(s) for s in sets]) is None


def test_simhash_links_alone(spark, docs):
    """Without MinHash bands the SimHash index finds the copies within its distance, and only the similar ones of them."""
    words = [f"s{i}" for i in range(900)]
    near_by = [(k, " ".join("x" + w if i == 40 * k else w for i, w in enumerate(words))) for k in range(1, 6)]
    rows = [(0, " ".join(words)), *near_by, (20, "a b c"), (21, "d e f"), (30, None), (31, " ")]
    prints = {i: simhash.fingerprint(t or "") for i, t in rows}
    linked = {i for i in range(1, 6) if (prints[i] ^ prints[0]).bit_count() <= 2}
    assert linked
    kept = kept_ids(near.keep_one(docs(rows), bands=0))
    assert not linked & set(kept) and {0, 20, 21, 30} <= set(kept) and 31 not in kept
    # fingerprints within the distance, texts that are not alike: nothing is dropped
    often = " ".join(words[:200] * 60)
    rows = [(0, often), (1, often + " " + " ".join(words[300:500]))]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() <= 2
    assert kept_ids(near.keep_one(docs(rows), bands=0)) == brute_kept(rows) == [0, 1]
