"""Whitening against exact covariance and a dense eigenvalue solver."""

import collections
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrapunto.llm import whiten
from contrapunto.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def table(spark, rows, kind="float"):
    rows = [(i, v if v is None else [c if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA.replace("float", kind))


def usable(rows):
    return [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows):
    """n, S, eigenvalues and vectors of the exact covariance over the different vectors."""
    x = sorted({tuple(v) for _, v in rows})
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(v, s)] for v in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n ** 3)) for j in range(len(s))] for i in range(len(s))])
    values, vectors = np.linalg.eigh(cov)
    return n, s, values[::-1], vectors[:, ::-1]


def compare(got, rows, components):
    n, s, values, vectors = brute(rows)
    out = collections.defaultdict(list)
    for r in got:
        out[r["component"]].append(r)
    assert sorted(out) == list(range(1, components + 1))
    want = collections.Counter((i, sum((n * a - b) ** 2 for a, b in zip(v, s))) for i, v in rows)
    dev = np.array([[a - b / n for a, b in zip(v, s)] for _, v in rows])
    for k, own in out.items():
        assert collections.Counter((r["vec_id"], r["deviation"]) for r in own) == want
        assert {r["n"] for r in own} == {n} and all(r["identity_error"] < 1e-6 for r in own)
        assert all(abs(r["explained"] / (values[k - 1] / values.sum()) - 1) < 1e-6 for r in own)
        plain = sorted((dev @ vectors[:, k - 1] / math.sqrt(values[k - 1])).tolist())
        mine = sorted(r["whitened"] for r in own)
        turned = sorted(-m for m in mine)
        assert min(np.abs(np.array(a) - plain).max() for a in (mine, turned)) < 1e-5


def test_whole_table(spark, data_dir):
    rows = usable([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").select("vec_id", "embedding").collect()])
    compare(QUERIES["op11_embedding_whitening"](spark, data_dir).collect(), rows, 16)


def test_odd_rows_and_hot_vector(spark):
    rng = np.random.default_rng(3)
    plain = [(i, rng.normal(0, 1 + i % 3, 5).tolist()) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] + [0.0] * 4), (104, [float("inf")] + [0.0] * 4), (105, [1e300] + [0.0] * 4), (None, [0.5] * 5), (7, [0.25] * 5)]
    rows = plain + odd + [(200 + i, [3.0, 1, -2, 0, 9]) for i in range(30)]
    got = whiten.whitened(table(spark, rows, "double")).collect()
    compare(got, usable([r for r in rows if r[0] != 105]), 5)
    assert whiten.whitened(table(spark, [])).count() == 0
    assert whiten.whitened(table(spark, [(1, [1.0, 2.0])] * 4)).count() == 0
    assert whiten.whitened(table(spark, odd[:5])).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        whiten.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0])])).collect()


def test_badly_scaled_and_dependent_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (80, 4)) * [3e4, 1e3, 30, 2] + [1e8, 0, 5, -7]
    # a constant, a repeated and a summed dimension: rank 4 of 7
    full = np.floor(base * 64) / 64
    full = np.column_stack([full, np.full(80, 0.5), full[:, 1], full[:, 0] + full[:, 1]])
    rows = [(i, v.tolist()) for i, v in enumerate(full)]
    got = whiten.whitened(table(spark, rows, "double")).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}
    compare(got, usable(rows), 4)


def test_exact_sums_past_a_long(spark):
    centre = whiten.Centre(3, [3 * (1 << 61)] * 2)
    x = np.array([[1 << 61, (1 << 61) + 5]])
    assert centre.spread(x) == [225] and centre.rows(x).tolist() == [[0.0, 5.0]]
    far = whiten.Centre(10, [0, 0])
    assert far.spread(np.array([[1 << 60, 1]])) == [(10 << 60) ** 2 + 100]
    rows = [(i, [v, float(i)]) for i, v in enumerate((2.0 ** 54, -2.0 ** 54, 0.0))]
    got = whiten.whitened(table(spark, rows, "double")).where("component = 1").orderBy("vec_id").collect()
    assert [r["deviation"] is None for r in got] == [True, True, False]
    fit = whiten.fit_list(table(spark, rows, "double"))
    assert whiten.sums(fit) == (3, [3_000_000, 3_000_192])
    assert whiten.sums(fit.where(F.lit(False))) == (0, [])
