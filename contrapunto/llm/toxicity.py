"""Toxicity: a convolutional text classifier in numpy, calibrated by language.

Words are ASCII-folded byte runs; a word's embedding is the sum of the rows that the word and its first
``STEM`` bytes hash to, so that inflected forms share a row.  Filters of widths 1, 2 and 3 slide over the
words, each filter keeps its maximum over the text, and a logistic layer turns the maxima into a
score.  Whole texts are scored: the maxima are taken over all words.

Training uses at most ``POSITIVES`` and ``NEGATIVES`` labelled documents (the first by a hash of the
id), held on the driver; nothing else there grows with the data.  A fifth of them, never trained on,
sets the threshold of each language at its best F1 for the classes' true shares.  The language is
guessed from the text by its function words (no column but the text enters a score); a language with few
labels takes the common threshold.  The score is a logistic curve that is one half at the threshold.

Null and empty texts are scored like texts whose filters never fire.  Without labels of both kinds
every score is 0.  Repeated rows get equal scores; a document labelled twice counts as toxic if one
label says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import slices, wanted

POSITIVES, NEGATIVES = 2000, 4000
BUCKETS, DEPTH, FILTERS, WIDTHS = 1 << 17, 8, 4, (1, 2, 3)
EPOCHS, BATCH, RATE = 4, 48, 0.02
MIN_LANGUAGE = 60          # validation documents a language needs for a threshold of its own
STEM = 4
CACHE = 200_000            # words whose bucket a worker remembers
LANGUAGES = {  # function words that tell the language of a text
    "en": "the and of to in is that for with this was are it as by be at from on or an",
    "fr": "le la de et les des une un du que qui dans pour au par est en sur avec",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als",
    "es": "el los las y por se con para una su al lo como del es no en un",
}
#: Letters to lower case; ASCII that is no letter to a space; other bytes as they are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _row(word: bytes) -> int:
    """Embedding row of a word or stem; row 0 is padding."""
    return 1 + xxhash.xxh32_intdigest(word, 11) % (BUCKETS - 1)


class Buckets(dict):
    """Word to its rows, as one number: word row times BUCKETS plus stem row."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        rows = self[word] = _row(word) * BUCKETS + _row(word[:STEM] + b"*")
        return rows


def _votes() -> np.ndarray:
    """Language that a row's function word speaks for; words of several languages and all others speak for none."""
    owner = np.full(BUCKETS, len(LANGUAGES), dtype=np.int64)
    words = [w for x in LANGUAGES.values() for w in x.split()]
    for i, x in enumerate(LANGUAGES.values()):
        for w in x.split():
            if words.count(w) == 1:
                owner[_row(w.encode())] = i
    return owner


def joined(texts: list[str | None], rows: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words (word rows, stem rows), two of padding after each text, and where each text begins."""
    ids, starts = [], []
    for t in texts:
        starts.append(len(ids))
        ids.extend([rows[w] for w in (t or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()])
        ids += (0, 0)
    ids = np.array(ids, dtype=np.int64)
    return np.stack([ids // BUCKETS, ids % BUCKETS]), np.array(starts, dtype=np.int64)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.02, (BUCKETS, DEPTH)).astype(np.float32)
        self.e[0] = 0
        self.w = [rng.normal(0, 0.1, (k, DEPTH, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.w:  # the first embedding column will hold the evidence of the word
            w[:, 0] = abs(w[:, 0]) + 1 / len(w)
        self.b = [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS]
        self.u = np.full(len(WIDTHS) * FILTERS, 1 / len(WIDTHS) / FILTERS, np.float32)
        self.c = np.zeros(1, np.float32)

    def tables(self) -> list[list[np.ndarray]]:
        """What each embedding row adds to each filter at each offset: embeddings times weights, once for all words."""
        return [[np.ascontiguousarray((self.e @ w[j]).T) for j in range(len(w))] for w in self.w]

    def evidence(self, docs: list[np.ndarray], toxic: np.ndarray) -> None:
        """First embedding column: log odds of the row's documents less their error, so that rare words weigh little."""
        n = np.zeros((2, BUCKETS))
        for ids, y in zip(docs, toxic):
            n[int(y), np.unique(ids)] += 1
        odds = [np.log((n[y] + 0.5) / (max(1, (toxic == y).sum()) - n[y] + 0.5)) for y in (0, 1)]
        sure = odds[1] - odds[0] - 1.5 * np.sqrt(1 / (n[0] + 0.5) + 1 / (n[1] + 0.5))
        self.e[:, 0] = np.clip(sure - 0.5, 0, 4) / 2
        self.e[0] = 0

    def _slide(self, ids: np.ndarray, tables: list[np.ndarray], b: np.ndarray) -> np.ndarray:
        """Filters by places."""
        out = tables[0][:, ids[0]]
        out += tables[0][:, ids[1]]
        for j in range(1, len(tables)):
            for rows in ids:
                out[:, :-j] += tables[j][:, rows[j:]]
        out += b[:, None]
        return out

    def maxima(self, ids: np.ndarray, starts: np.ndarray, tables) -> np.ndarray:
        return np.concatenate([np.maximum(np.maximum.reduceat(self._slide(ids, t, b), starts, axis=1), 0) for t, b in zip(tables, self.b)]).T

    def logits(self, ids: np.ndarray, starts: np.ndarray, tables) -> np.ndarray:
        return self.maxima(ids, starts, tables) @ self.u + self.c[0]

    def train(self, docs: list[np.ndarray], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        self.evidence(docs, toxic)
        weight = np.where(toxic == 1, len(toxic) / max(1, 2 * toxic.sum()), len(toxic) / max(1, 2 * (1 - toxic).sum()))
        params = [self.e, *self.w, *self.b, self.u, self.c]
        seen = [np.full_like(p, 0.1) for p in params]

        def step(i: int, at, grad: np.ndarray) -> None:  # Adagrad
            seen[i][at] += grad * grad
            params[i][at] -= RATE * grad / np.sqrt(seen[i][at])

        for _ in range(epochs):
            deal = rng.permutation(len(docs))
            for at in range(0, len(deal), BATCH):
                own = deal[at:at + BATCH]
                ids = np.concatenate([docs[i] for i in own], axis=1)
                ends = np.cumsum([docs[i].shape[1] for i in own])
                starts = np.concatenate([[0], ends[:-1]])
                used, small = np.unique(ids, return_inverse=True)
                small = small.reshape(ids.shape)
                best, value = [], []
                for w, b in zip(self.w, self.b):
                    z = self._slide(small, [(self.e[used] @ w[j]).T for j in range(len(w))], b)
                    where = np.stack([z[:, s:e].argmax(axis=1) + s for s, e in zip(starts, ends)])
                    best.append(where)
                    value.append(np.take_along_axis(z, where.T, axis=1).T)
                h = np.maximum(np.concatenate(value, axis=1), 0)
                p = 1 / (1 + np.exp(-(h @ self.u + self.c[0])))
                d = ((p - toxic[own]) * weight[own] / len(own)).astype(np.float32)
                dh = d[:, None] * self.u * (h > 0)
                du, dc = h.T @ d, d.sum(keepdims=True)
                de = np.zeros((len(used), DEPTH), np.float32)
                for k, (w, where) in enumerate(zip(self.w, best)):
                    g = dh[:, k * FILTERS:(k + 1) * FILTERS]
                    dw = np.zeros_like(w)
                    for j in range(len(w)):
                        place = np.minimum(where + j, ids.shape[1] - 1)
                        dw[j] = np.einsum("nf,nfd->df", g, self.e[ids[0][place]] + self.e[ids[1][place]])
                        for rows in small:
                            np.add.at(de, rows[place].ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, DEPTH))
                    step(1 + k, slice(None), dw)
                    step(1 + len(WIDTHS) + k, slice(None), g.sum(axis=0))
                if used[0] == 0:
                    de[0] = 0
                step(0, used, de)
                step(len(params) - 2, slice(None), du)
                step(len(params) - 1, slice(None), dc)


class Model:
    """The network with its thresholds; what a scoring task receives."""

    def __init__(self, network: Network | None, cut: np.ndarray, slope: float):
        self.network, self.cut, self.slope = network, cut, slope
        self.tables = network.tables() if network else None
        self.rows, self.votes = Buckets(), _votes()

    def __getstate__(self):
        return {"network": self.network, "cut": self.cut, "slope": self.slope}

    def __setstate__(self, state):
        self.__init__(**state)

    def languages(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Number of the likeliest language, the last number if no function word occurs."""
        kinds = len(LANGUAGES) + 1
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, ids.shape[1])))
        votes = np.bincount(owner * kinds + self.votes[ids[0]], minlength=len(starts) * kinds).reshape(-1, kinds)[:, :-1]
        return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(LANGUAGES))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.network or not texts:
            return np.zeros(len(texts))
        ids, starts = joined(texts, self.rows)
        logit = self.network.logits(ids, starts, self.tables).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * (logit - self.cut[self.languages(ids, starts)]), -60, 60)))


def _threshold(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """Midway cut of the best weighted F1."""
    o = np.argsort(-logit, kind="stable")
    hit, false = np.cumsum(toxic[o] * weight[o]), np.cumsum((1 - toxic[o]) * weight[o])
    f1 = 2 * hit / (hit + false + hit[-1])
    best = int(f1.argmax())
    return float((logit[o][best] + logit[o][min(best + 1, len(o) - 1)]) / 2)


def fit(texts: list[str], toxic: list[int], share: float) -> Model:
    """A model of labelled texts; ``share`` is the true share of toxic ones."""
    toxic = np.array(toxic, dtype=np.float64)
    rows = Buckets()
    docs = [joined([t], rows)[0].astype(np.int32) for t in texts]
    one = np.concatenate([np.flatnonzero(toxic == y)[distinct([docs[i] for i in np.flatnonzero(toxic == y)])] for y in (0, 1)]).astype(np.int64)
    one.sort()
    texts, docs, toxic = [texts[i] for i in one], [docs[i] for i in one], toxic[one]
    del rows  # the words' rows and the texts' are the driver's largest objects: held once, and not longer than needed
    if len(set(toxic.tolist())) < 2:
        return Model(None, np.zeros(len(LANGUAGES) + 1), 1.0)
    part = np.random.default_rng(3).permutation(len(texts)) % 5 == 0
    if len(set(toxic[part].tolist())) < 2 or len(set(toxic[~part].tolist())) < 2:
        part = np.zeros(len(texts), bool)
    network = Network()
    network.train([d for d, p in zip(docs, part) if not p], toxic[~part])
    del docs
    model = Model(network, np.zeros(len(LANGUAGES) + 1), 1.0)
    check = part if part.any() else ~part
    ids, starts = joined([t for t, p in zip(texts, check) if p], model.rows)
    logit, truth, language = network.logits(ids, starts, model.tables).astype(np.float64), toxic[check], model.languages(ids, starts)
    weight = np.where(truth == 1, share / truth.mean(), (1 - share) / (1 - truth.mean()))
    cut = np.full(len(LANGUAGES) + 1, _threshold(logit, truth, weight))
    for i in range(len(LANGUAGES)):
        own = language == i
        if own.sum() >= MIN_LANGUAGE and 10 <= truth[own].sum() < own.sum():
            cut[i] = _threshold(logit[own], truth[own], weight[own])
    return Model(network, cut, 1.0)


def distinct(docs: list[np.ndarray]) -> np.ndarray:
    """Positions of one document of each group of copies: else the words of a popular text would pass for evidence.

    Copies agree in one of four pairs of least hashes of their 5-word shingles.
    """
    seen: set[tuple] = set()
    keep = []
    with np.errstate(over="ignore"):
        for i, ids in enumerate(docs):
            h = ids[0].astype(np.uint64)
            for _ in range(2):  # padding is part of short texts, so every text has a shingle or is empty
                h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
                h ^= h >> np.uint64(29)
            shingle = sum(h[j:len(h) - 4 + j] * np.uint64(2 * j * j + 3) for j in range(5)) if len(h) >= 5 else h
            least = [int((shingle * np.uint64(m) ^ (shingle >> np.uint64(31))).min()) if len(shingle) else 0 for m in (3, 5, 0x1F3B, 0x5BD1E995, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x85EBCA6B)]
            pairs = [(k, least[2 * k], least[2 * k + 1]) for k in range(4)]
            if not any(q in seen for q in pairs):
                keep.append(i)
            seen.update(pairs)
    return np.array(keep, dtype=np.int64)


def held_out() -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[str], list[int], float]:
    """A bounded sample of labelled texts and the share of positive labels."""
    marked = wanted(labels, "doc_id", label).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max(label).alias("y")).where(~held_out())
    count = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = marked.where("y = 1").orderBy(*order).limit(POSITIVES).unionByName(marked.where("y = 0").orderBy(*order).limit(NEGATIVES))
    few = few.select(F.col("doc_id").alias("id"), "y")
    texts = wanted(docs, "doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("id"))  # at most POSITIVES + NEGATIVES rows
    rows = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").orderBy("doc_id", "text").limit(2 * (POSITIVES + NEGATIVES)).collect()
    total = count.get(0, 0) + count.get(1, 0)
    return [r["text"] for r in rows], [int(r["y"]) for r in rows], count.get(1, 0) / max(1, total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: embeddings and filters

    def run(batches):
        for b in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return wanted(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every document."""
    model = fit(*sample(docs, labels))
    return score(docs, model).select(F.col("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic; all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels)))
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches, 128):
            yield b.filter(pa.array(sent.value.scores(b.column(at).to_pylist()) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
