"""Fingerprints, groups, repeats, classifiers and the pipeline against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contrapunto.llm import components, multiset, quality, simhash, substrings, toxicity
from contrapunto.llm.queries import QUERIES


def test_edited_texts_and_likeness(spark, docs, odd):
    rows = [r for r in odd if r[0] is not None] + [(20, "b.\na."), (21, "a.\nb.")]
    got = multiset.against_next(docs(rows)).collect()
    ids = sorted({i for i, _ in rows})
    text = {i: t or "" for i, t in rows}
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    prints = collections.defaultdict(set)
    for r in got:
        own, after = text[r["doc_id"]], text[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[:len(own) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[own].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and prints["b.\na."] == prints["a.\nb."]  # order does not matter
    assert next(r["near_next"] for r in got if r["doc_id"] == 1) == 1.0
    assert multiset.against_next(docs([(None, None)])).first()["near_next"] == 1.0
    assert multiset.against_next(docs([])).count() == 0


def test_fingerprints_add_up(spark):
    rows = [(1, "x y.\nz.\nw."), (2, "z."), (3, "x y.\nw.")]
    fp = multiset.fingerprints(spark.createDataFrame(rows, "k long, text string"), ["k"]).select("k", F.struct("n", "flags", "sums").alias("fp"))
    a, b, c = (fp.where(f"k = {k}").select(F.col("fp").alias(n)) for k, n in ((1, "a"), (2, "b"), (3, "c")))
    both = a.join(b).join(c).select(F.struct(*multiset.combined("a", "b", -1)).alias("less"), F.struct(*multiset.combined("c", "b")).alias("more"), "a", "c").first()
    assert both["less"] == both["c"] and both["more"] == both["a"]


def test_likeness_of_very_often_repeated_lines(spark):
    rows = [(1, "same line\n" * 40_000), (2, "same line\n" * 20_000)]
    fp = multiset.fingerprints(spark.createDataFrame(rows, "k long, text string"), ["k"]).select("k", F.struct("n", "flags", "sums").alias("fp"))
    a, b = (fp.where(f"k = {k}").select(F.col("fp").alias(n)) for k, n in ((1, "a"), (2, "b")))
    assert a.join(b).select(multiset.likeness("a", "b").alias("near")).first()["near"] > 0.999


def brute_groups(fps, distance):
    ids = sorted(fps, key=lambda i: (i is None, i or 0))
    parent = list(range(len(ids)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= distance and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {ids[n]: ids[root(n)] for n in range(len(ids))}


def test_index_finds_all_links():
    rng = np.random.default_rng(0)
    for n, distance in ((3, 2), (9, 2), (100, 2), (1500, 2), (400, 4)):
        f = rng.integers(0, 1 << 63, max(1, n // 20), dtype=np.uint64)[rng.integers(0, max(1, n // 20), n)]
        for _ in range(distance + 1):
            m = rng.random(n) < 0.5
            f[m] ^= np.uint64(1) << rng.integers(0, 64, m.sum()).astype(np.uint64)
        f = np.unique(f)
        index = simhash.GrayIndex(f)
        got = {tuple(sorted((int(index.fps[a]), int(index.fps[b])))) for x, y in index.links(distance) for a, b in zip(x, y)}
        assert got == {tuple(sorted((int(f[i]), int(f[j])))) for i in range(len(f)) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= distance}


@pytest.mark.parametrize("distance,block", [(2, 4096), (2, 3), (4, 5)])
def test_groups_of_planted_fingerprints(spark, distance, block):
    rng, fps = random.Random(distance + block), {}
    for i in range(300):
        fps[i] = fps[rng.randrange(i)] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if i and rng.random() < 0.6 else rng.getrandbits(64)
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    nodes = spark.createDataFrame([(f,) for f in set(signed.values())], "fp long")
    links = simhash.links(nodes, distance, block)
    back = {f: i for i, f in sorted(signed.items(), reverse=True)}
    pairs = [(back[r["a"]], back[r["b"]]) for r in links.collect()]
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()} if pairs else {}
    want = brute_groups(fps, distance)
    assert {i: roots.get(back[signed[i]], back[signed[i]]) for i in fps} == want


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(200)] + [(500, 501), (600, 600)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_near_duplicates_odd_rows(spark, docs, odd):
    got = simhash.near_duplicates(docs(odd)).collect()
    fps = {i: simhash.fingerprint(t or "") for i, t in odd}
    want = brute_groups(fps, 2)
    assert collections.Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == collections.Counter((i, fps[i], want[i]) for i, _ in odd)
    assert fps[3] == fps[8] == 0
    assert simhash.near_duplicates(docs([])).count() == 0
    kept = simhash.keep_one(docs(odd))
    assert kept.columns == docs(odd).columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def brute_repeats(rows, size=100):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if b[p:p + size] in seen:
                gone[p:p + size] = b"\1" * size
            seen.add(b[p:p + size])
        kept = bytes(x for x, r in zip(b, gone) if not r)
        out[i] = (len(b), sum(gone), sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs, odd):
    rng = random.Random(1)
    part = lambda: rng.choice(["ab" * 70, "x" * 150, "hello world this is a common line ", "\u00e9" * 60, "q" + str(rng.random()), "ab"])
    rows = list(odd) + [(100 + i, "".join(part() for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(900, "a" * 5000), (901, "a" * 99), (902, "a" * 100)]
    want = brute_repeats(rows)
    for block in (substrings.BLOCK, 60):  # the small block also searches an overgrown anchor in parts
        got = substrings.remove_repeats(docs(rows), block=block).withColumn("sha", F.sha2("kept", 256)).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in got} == want
    assert substrings.digests(docs([])).count() == 0


def test_repeats_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op10_repeated_substrings"](spark, data_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows)


def test_equal_prefixes():
    rng = random.Random(8)
    s = np.array([rng.choice([1, 2, 2, 3]) for _ in range(400)] + [0], dtype=np.int16)
    order, border = substrings.equal_prefixes(s, 5)
    rows = [tuple(s[i:i + 5].tolist()) for i in order]
    for k in range(1, len(rows)):
        if len(rows[k]) == len(rows[k - 1]) == 5 and 0 not in rows[k] + rows[k - 1]:
            assert border[k] == (rows[k] != rows[k - 1])


def auc(s, y):
    r = np.argsort(np.argsort(s, kind="stable"))
    return (r[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def planted(n=700):
    rng = random.Random(6)
    out, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        ws = ["".join(rng.choice(["on", "er", "th", "an", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        if bad:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["nasty", "vile"]) if i % 2 else "krumm" + rng.choice("aeioustnr"))
        out.append((i, " ".join(ws)))
        labels.append((i, int(not bad), int(bad)))
    return out, labels


def test_toxicity_on_held_out(spark, docs, odd):
    rows, labels = planted()
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    more = [(10_000 + i if i is not None else None, t) for i, t in odd]
    got = toxicity.classify(docs(rows + more), marks).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    own = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert auc(np.array([r["score"] for r in own]), np.array([truth[r["doc_id"]] for r in own])) > 0.97
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs(rows), marks).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"] == 0} & set(truth)
    none = toxicity.classify(docs(odd), marks.limit(0)).collect()
    assert len(none) == len(odd) and {r["score"] for r in none} == {0.0}
    assert toxicity.classify(docs([]), marks).count() == 0


def test_quality_on_held_out(spark, docs, odd, data_dir):
    got = QUERIES["op5_quality"](spark, data_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(data_dir.replace("sf0.001", "sf0.01") + "/labels.parquet").select("doc_id", "quality")
    own = got.join(labels, "doc_id").where("held_out").collect()
    assert auc(np.array([r["score"] for r in own]), np.array([r["quality"] for r in own])) > 0.75
    assert {r["score"] for r in quality.classify(docs(odd), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs(odd), labels).count() == len(odd)
    assert quality.classify(docs([]), labels).count() == 0


def test_all_unlabelled_documents_teach(spark, docs, odd):
    """The sums over the tasks are those over all rows at once, and every sure row is in them."""
    rows = [(i, "word " * (i % 40) + ("Fine line.\n" if i % 2 else "## 12 |")) for i in range(700)] + list(odd)
    features = quality._featured(docs(rows).repartition(5))
    table = features.select("doc_id", "a", "b").toArrow().combine_chunks().to_batches()[0]
    x, y = quality.views(table, 1), np.arange(table.num_rows) % 2
    models = [quality.Ridge(*quality.sums(v, y.astype(float))) for v in x]
    z = [m.logit(v) for m, v in zip(models, x)]
    cuts = [(float(np.quantile(v, 0.3)), float(np.quantile(v, 0.6))) for v in z]
    for k, (g, t) in enumerate(quality.taught(features, models, cuts)):
        sure = (z[1 - k] <= cuts[1 - k][0]) | (z[1 - k] >= cuts[1 - k][1])
        want = quality.sums(x[k][sure], (z[1 - k][sure] >= cuts[1 - k][1]).astype(float))
        assert g[0, 0] == sure.sum() > 400 and np.allclose(g, want[0]) and np.allclose(t, want[1])
    # least squares from the sums is least squares on the rows
    rng = np.random.default_rng(2)
    points, flags = rng.normal(size=(300, 4)) * [1, 5, 0.1, 2] + 3, rng.integers(0, 2, 300).astype(float)
    own = quality.Ridge(*quality.sums(points, flags)).logit(points)
    plain = np.column_stack([np.ones(300), points])
    assert np.corrcoef(own, plain @ np.linalg.lstsq(plain, 2 * flags - 1, rcond=None)[0])[0, 1] > 0.999


def brute_pipeline(spark, docs, labels, items):
    """{id: kept text} after the first three stages, the near copies by brute-force Jaccard."""
    from contrapunto.llm.decontaminate import Searcher, folded
    from test_near import brute_kept
    rows = [(r["doc_id"], r["text"]) for r in toxicity.without_toxic(docs, labels).collect()]
    kept = collections.Counter(brute_kept(rows))
    search, out = Searcher(items), []
    for i, n in kept.items():
        own = sorted({t or "" for j, t in rows if j == i})
        out += [(i, t) for t in own[:n] if not search.matches(folded(t))]
    return out


def test_pipeline(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data_dir).collect()}
    # the same stages, one after the other, by brute force over what the one before kept
    rows = dict(brute_pipeline(spark, docs, labels, [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()]))
    assert set(out) == set(rows) and 0 < len(out) < docs.count()
    from contrapunto.llm.bpe import Codec
    from contrapunto.llm.queries import tokenizer
    codec = Codec.of(*tokenizer())
    for i, r in out.items():
        assert r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(codec.decode(r["ids"]))


def test_pipeline_odd_rows_and_clashing_columns(spark, docs, odd, data_dir, tmp_path):
    rows = list(odd) + [(40, "write to ann@example.org or call +1 (826) 555-4081"), (41, None), (42, "")]
    clash = ["k1", "node", "found", "fresh", "ids"]
    own = docs(rows).drop("n_chars").select("*", *[F.lit(c.upper()).alias(c) for c in clash], F.lit(7).alias("n_tokens"))
    for folder, table, copy in ((tmp_path / "odd", own, False), (tmp_path / "none", own.limit(0), True)):
        table.write.parquet(f"{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            other = spark.read.parquet(f"{data_dir}/{name}.parquet")
            (other.limit(0) if copy else other).write.parquet(f"{folder}/{name}.parquet")
        seen = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = stage(spark, seen, str(folder))
            assert seen.columns == table.columns, name
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == [c for c in table.columns if c != "text"] + ["ids_", "n_tokens_"]
        got = out.collect()
        if copy:
            assert got == []
            continue
        want = brute_pipeline(spark, table, spark.read.parquet(f"{folder}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()])
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in want)
        assert all(r[c] == c.upper() for r in got for c in clash) and all(r["n_tokens"] == 7 and r["n_tokens_"] == len(r["ids_"]) for r in got)
