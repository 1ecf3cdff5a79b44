"""Quality: co-training of a text view and a metadata view.

The text view holds shares of character classes, word and line statistics; the metadata view holds language,
source (hashed), length, and which lengths a source has.  Every document is reduced to its two views once, in the
tasks, and the views are written; all passes run over them.

Each view has a linear classifier, fitted by ridge least squares from sums alone (weights, outer products, products
with the label), so rows stay where they are.  Over ``ROUNDS`` rounds every unlabelled document is scored by both;
the surest ones at either end, cut at approximate quantiles over all of them, get a pseudo-label, and the
other classifier learns from these too.  The pseudo-labelled documents weigh a fixed share of the labelled
ones, so results are alike at every size.  Both views are then calibrated on labelled documents kept apart,
and a document's score adds up their log odds, weighted by a logistic fit on the same part.

At most ``LABELLED`` labelled documents train (the first by a hash of the id); only their views reach the driver.
All unlabelled documents take part.  Labels of held-out documents (crc32 of the id divisible by 5) are never used.

Null and empty texts have zero shares; unknown sources and languages share the bucket of nulls.  Without
labels of both kinds every score is one half.  A document labelled twice counts as good if one label says so;
rows that repeat an id share its label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import durable, slices, wanted
from contrapunto.llm.toxicity import held_out

LABELLED, ROUNDS, SURE, STEPS = 4000, 4, 0.05, 300
SHARE, RIDGE, ACCURACY = 0.5, 1e-2, 1e-3  # weight of pseudo-labels; penalty; of the quantiles
SOURCES, LANGS, LENGTHS, CROSSED = 64, 16, 12, 256
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()/\\=+", b"-_:;'\""]
_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _c in enumerate(_CLASSES):
    _OF[list(_c)] = _i


def text_view(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    shares = np.bincount(_OF, np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=len(_CLASSES) + 1) / n
    ws = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    different = len(set(ws)) / max(1, len(ws))
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines))
    return [*np.sqrt(shares).tolist(), len(data) / max(1, len(ws)) / 10, different, different * np.log1p(len(ws)) / 8,
            len(set(lines)) / max(1, len(lines)), len(lines) / max(1, len(ws)) * 5, ends, float(ends == 0), np.log1p(len(ws)) / 8]


def meta_view(lang: str | None, source: str | None, chars: int) -> list[int]:
    """The places of the ones in the metadata view, of ``META`` in all."""
    size = min(LENGTHS - 1, int(np.log2(chars + 1)) // 2)
    fine = f"{source or ''}|{lang or ''}|{int(2 * np.log2(chars + 1))}"
    return [xxhash.xxh32_intdigest(lang or "") % LANGS, LANGS + xxhash.xxh32_intdigest(source or "") % SOURCES,
            LANGS + SOURCES + size, LANGS + SOURCES + LENGTHS + xxhash.xxh32_intdigest(fine) % CROSSED]


TEXT, META = len(_CLASSES) + 1 + 8, LANGS + SOURCES + LENGTHS + CROSSED


class Logistic:
    """Ridge logistic regression on standardised features, by gradient steps with momentum."""

    def __init__(self, width: int):
        self.mean, self.scale, self.w, self.c = np.zeros(width), np.ones(width), np.zeros(width), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Logistic":
        weight = np.ones(len(y)) if weight is None else weight
        weight = weight / weight.sum()
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(y))])
        w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
        rate = 4 / (np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + 1e-9)
        for _ in range(STEPS):
            g = z.T @ ((1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y) * weight) + 1e-3 * np.append(w[:-1], 0)
            v = 0.9 * v - 0.3 * rate * g
            w = w + v
        self.w, self.c = w[:-1], float(w[-1])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w + self.c


class Ridge:
    """Least squares on labels -1 and 1, from the sums of (1, x) (1, x)' and of (1, x) y."""

    def __init__(self, gram: np.ndarray, target: np.ndarray):
        n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
        scale = np.sqrt(np.maximum(np.diag(gram)[1:] / n - mean ** 2, 0)) + 1e-3
        own = (gram[1:, 1:] / n - np.outer(mean, mean)) / np.outer(scale, scale)
        y = (target[1:] / n - mean * target[0] / n) / scale
        self.w = np.linalg.solve(own + RIDGE * np.eye(len(y)), y) / scale
        self.c = float(target[0] / n - mean @ self.w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.c


def sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums that ``Ridge`` takes, for rows with labels 0 and 1."""
    z = np.column_stack([np.ones(len(x)), x])
    return z.T @ z, z.T @ (2.0 * y - 1)


def views(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch as matrices; ``at`` is the column of the first."""
    text = batch.column(at).flatten().to_numpy().reshape(-1, TEXT)
    meta = np.zeros((batch.num_rows, META))
    ones = batch.column(at + 1).flatten().to_numpy().reshape(-1, 4)
    meta[np.arange(len(ones))[:, None], ones] = 1.0
    return text, meta


def _featured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the two views of every row, written once."""
    def run(batches):
        for b in slices(batches):
            texts, langs, sources = (b.column(i).to_pylist() for i in (1, 2, 3))
            a = np.array([text_view(t) for t in texts]).reshape(-1, TEXT)
            m = np.array([meta_view(g, s, len(t or "")) for g, s, t in zip(langs, sources, texts)], dtype=np.int32).reshape(-1, 4)
            ends = lambda n: pa.array(np.arange(len(texts) + 1) * n, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends(TEXT), pa.array(a.ravel())), pa.ListArray.from_arrays(ends(4), pa.array(m.ravel()))], names=["doc_id", "a", "b"])

    own = wanted(docs, "doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id").cast("long"))
    return durable(own.mapInArrow(run, "doc_id long, a array<double>, b array<int>"))


def taught(rest: DataFrame, models: list[Ridge], cuts: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the sums over the documents whose label the other view is sure of; one partial sum a task."""
    def run(batches):
        held = [[np.zeros((d + 1, d + 1)), np.zeros(d + 1)] for d in (TEXT, META)]
        for b in batches:
            x = views(b, 1)
            for k in (0, 1):
                z = models[1 - k].logit(x[1 - k])
                sure = np.flatnonzero((z <= cuts[1 - k][0]) | (z >= cuts[1 - k][1]))
                for total, own in zip(held[k], sums(x[k][sure], (z[sure] >= cuts[1 - k][1]).astype(float))):
                    total += own
        for k, (g, t) in enumerate(held):
            flat = np.concatenate([g.ravel(), t])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at), pa.array(flat[at])], names=["k", "at", "v"])

    cells = rest.select("doc_id", "a", "b").mapInArrow(run, "k int, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).toArrow()
    k, at, v = (cells.column(c).to_numpy() for c in ("k", "at", "v"))
    out = []
    for view, d in enumerate((TEXT, META)):
        flat = np.zeros((d + 1) * (d + 2))
        flat[at[k == view]] = v[k == view]
        out.append((flat[:(d + 1) ** 2].reshape(d + 1, d + 1), flat[(d + 1) ** 2:]))
    return out


def cotrain(x: list[np.ndarray], y: np.ndarray, rest: DataFrame) -> list[Ridge]:
    """The classifiers of two views, which hand each other their surest labels of all unlabelled documents."""
    known = [sums(v, y) for v in x]
    models = [Ridge(*s) for s in known]
    positive = float(y.mean())

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(m.logit(v)) for m, v in zip(models, views(b, 1))], names=["za", "zb"])

    for r in range(ROUNDS):
        share = SURE * (r + 1)
        ends = [2 * share * (1 - positive), 1 - 2 * share * positive]
        cuts = rest.select("doc_id", "a", "b").mapInArrow(run, "za double, zb double").approxQuantile(["za", "zb"], ends, ACCURACY)
        if not cuts[0]:
            break  # nothing is unlabelled
        weight = SHARE * 2 * share * len(y)
        more = taught(rest, models, [tuple(c) for c in cuts])
        models = [Ridge(*[own + weight / max(1.0, new[0][0, 0]) * extra for own, extra in zip(base, new)]) for base, new in zip(known, more)]
    return models


def fit(features: DataFrame, labels: DataFrame) -> tuple | None:
    """(text classifier, metadata classifier, their calibrations, combination); None without labels of both kinds."""
    marked = wanted(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    some = marked.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    found = features.join(F.broadcast(some), "doc_id").orderBy("doc_id").limit(2 * LABELLED).select("doc_id", "a", "b", "y").toArrow()  # at most LABELLED ids
    y = found.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    x = list(views(found.combine_chunks().to_batches()[0], 1))
    part = np.random.default_rng(1).random(len(y)) < 0.25
    train = ~part
    if len(set(y[part].tolist())) < 2 or len(set(y[train].tolist())) < 2:
        part = train = np.ones(len(y), dtype=bool)
    rest = durable(features.join(marked.select("doc_id"), "doc_id", "left_anti"))
    models = cotrain([v[train] for v in x], y[train].astype(float), rest)
    z = np.column_stack([m.logit(v[part]) for m, v in zip(models, x)])
    alone = [Logistic(1).fit(z[:, [k]], y[part].astype(float)) for k in (0, 1)]
    odds = np.column_stack([c.logit(z[:, [k]]) for k, c in enumerate(alone)])
    return *models, *alone, Logistic(2).fit(odds, y[part].astype(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (1: good), ``text_score``, ``meta_score`` and ``predicted`` for every document."""
    features = _featured(docs)
    model = fit(features, labels)

    def run(batches):
        for b in batches:
            if model is None:
                s = [np.full(b.num_rows, 0.5)] * 3
            else:
                odds = [c.logit(m.logit(v)[:, None]) for m, c, v in zip(model[:2], model[2:4], views(b, 1))]
                s = [1 / (1 + np.exp(-np.clip(v, -60, 60))) for v in (model[4].logit(np.column_stack(odds)), *odds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v) for v in s]], names=["doc_id", "score", "text_score", "meta_score"])

    out = features.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
