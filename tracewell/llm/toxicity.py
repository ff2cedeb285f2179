"""Operator 3: toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its hashed character n-grams; word vectors are averages of
n-gram vectors, document vectors averages of word vectors, and a linear softmax
scores them.  Embeddings and softmax are trained together in numpy, so a
misspelling never seen shares the n-grams of what it was made from.

The fit uses a bounded sample of labelled rows (``SAMPLE``); scoring covers every
whole text.  As averaging is linear, the trained model comes down to one number
per n-gram bucket, which is what tasks receive: ``BUCKETS`` floats, however large
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, blocks, map_texts, read, texts

BUCKETS = 1 << 17
DIM = 4
GRAMS = (3, 4, 5, 6)
#: At most so many labelled rows of each class are collected for the fit.
SAMPLE = 1500
EPOCHS = 6
STEPS = 200
BATCH = 64
RATE = 0.05
#: Standard errors by which a log-odds must differ from zero to count at the start.
CERTAIN = 2.75
DECAY = 1e-7
EPSILON = 1e-6
#: Words without meaning that every document is padded with, so that a short text is not judged by one word.
PAD = 20
#: An n-gram counts from so many sampled documents on.
LEAST_DOCS = 5
#: A row is predicted toxic from this score on.
CUT = 0.7
CACHE = 200_000
BLOCK_DOCS = 500


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and of every n-gram of it (in "<" and ">"), and the index of its word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64) + 2
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # characters up to the word's end
    buckets, owners = [], []
    for n in GRAMS:
        h = np.full(len(code), n, np.uint64)
        for k in range(n):
            h = (h ^ np.roll(code, -k)) * np.uint64(0x100000001B3)
        inside = left >= n
        h = h[inside]
        buckets.append(((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[inside])
    start = np.cumsum(length) - length
    whole = np.add.reduceat(code * (np.arange(len(code), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64) + np.uint64(77)) ** np.uint64(5), start)
    buckets.append(((whole ^ (whole >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS)
    owners.append(np.arange(len(words)))
    b, o = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def tokens(text: str) -> list[str]:
    return text.lower().split()


class Model:
    """scores: one number per bucket; the logit of a document is the mean over its words of the mean over their n-grams, plus bias."""

    def __init__(self, scores: np.ndarray, bias: float):
        self.scores, self.bias = scores, bias
        self.known = Memo(CACHE)

    def learn(self, words: set[str]) -> dict[str, float]:
        new = list(self.known.missing(words))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            b, o = grams(part)
            value = np.bincount(o, self.scores[b], len(part)) / np.maximum(np.bincount(o, minlength=len(part)), 1)
            self.known.now.update(zip(part, value.tolist(), strict=True))
        return self.known.now

    def score(self, block: list[str]) -> list[float]:
        cut = [tokens(t) for t in block]
        known = self.learn({w for ws in cut for w in ws})
        logit = np.array([sum([known[w] for w in ws]) / (len(ws) + PAD) for ws in cut]) + self.bias
        return (1 / (1 + np.exp(-np.clip(logit, -60, 60)))).tolist()


def bags(block: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of documents (lists of words): buckets, their weights, and where each row starts.

    A bucket's weight is what its n-grams add to the document vector: the mean
    over words of the mean over a word's n-grams.
    """
    index: dict[str, int] = {}
    rows = [np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, len(ws)) for ws in block]
    b, o = grams(list(index))
    starts = np.searchsorted(o, np.arange(len(index) + 1))
    size = np.maximum(np.diff(starts), 1)
    buckets, weights, ends = [], [], [0]
    for row in rows:
        words, times = np.unique(row, return_counts=True)
        n = starts[words + 1] - starts[words]
        at = np.repeat(starts[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        used, where = np.unique(b[at], return_inverse=True)
        buckets.append(used)
        weights.append(np.bincount(where, np.repeat(times / size[words], n), len(used)) / (len(row) + PAD))
        ends.append(ends[-1] + len(used))
    return np.concatenate(buckets), np.concatenate(weights), np.array(ends)


def bags_of(texts_: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text, as ``bags`` has them; at most BUCKETS of each."""
    out = []
    for at in range(0, len(texts_), BATCH):
        bucket, value, ends = bags([tokens(t) for t in texts_[at : at + BATCH]])
        out += [(bucket[i:j].astype(np.int32), value[i:j].astype(np.float32)) for i, j in zip(ends, ends[1:], strict=False)]
    return out


def gradients(vector: np.ndarray, weight: np.ndarray, bias: np.ndarray, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss of a batch of bags (doc, bucket, value) with labels y, and its gradients by n-gram vectors, softmax weights and biases.

    The loss is the mean over documents of ``share`` times the negative logarithm of the label's probability.
    """
    n, dim = len(y), len(vector)
    docs = np.stack([np.bincount(doc, vector[d, bucket] * value, n) for d in range(dim)], 1)
    logit = docs @ weight.T + bias
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = float(-(share * np.log(np.maximum(p[np.arange(n), y], 1e-300))).mean())
    p[np.arange(n), y] -= 1
    g = p * share[:, None] / n
    back = g @ weight
    return loss, [np.stack([np.bincount(bucket, back[doc, d] * value, vector.shape[1]) for d in range(dim)]), g.T @ docs, g.sum(0)]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """Joint training of n-gram vectors and softmax by momentum on mini-batches of bags, classes weighted alike.

    Steps are scaled by running norms of each entry.  N-grams start from what is
    certain of their log-odds, so that few labelled rows go far; README has both
    parts alone.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, int)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    bucket, value = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    ends = np.concatenate([[0], np.cumsum([len(b) for b, _ in rows])])
    share = np.array([len(y) / (2 * (y == c).sum()) for c in (0, 1)])
    # Start: the first coordinate of an n-gram is what is certain of its log-odds, scaled to unit variance over documents.
    doc = np.repeat(np.arange(len(y)), np.diff(ends))
    has = [np.bincount(bucket[y[doc] == c], minlength=BUCKETS) + 0.5 for c in (0, 1)]
    value = np.where((has[0] + has[1])[bucket] > LEAST_DOCS, value, 0)
    odds = np.log(has[1] / ((y == 1).sum() + 1)) - np.log(has[0] / ((y == 0).sum() + 1))
    sure = np.sign(odds) * np.maximum(0, np.abs(odds) - CERTAIN * np.sqrt(1 / has[0] + 1 / has[1]))
    vector = rng.normal(0, 0.01, (DIM, BUCKETS))
    spread = np.bincount(doc, sure[bucket] * value, len(y)).std()
    vector[0] += sure / spread if spread > 0 else 0
    weight, bias = np.stack([-np.ones(DIM), np.ones(DIM)]) / 2, np.zeros(2)
    first, second, step = [[np.zeros_like(x) for x in (vector, weight, bias)] for _ in range(2)] + [0]
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            ids = order[at : at + BATCH]
            step += 1
            size = ends[ids + 1] - ends[ids]
            where = np.repeat(ends[ids] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            doc, b, v = np.repeat(np.arange(len(ids)), size), bucket[where], value[where]
            grads = gradients(vector, weight, bias, doc, b, v, y[ids], share[y[ids]])[1]
            grads[0] += DECAY * vector
            for i, param in enumerate((vector, weight, bias)):
                first[i] = 0.9 * first[i] + 0.1 * grads[i]
                second[i] = 0.99 * second[i] + 0.01 * grads[i] ** 2
                param -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + EPSILON)
    return Model(((weight[1] - weight[0]) @ vector).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` rows of each class, those with the least hash of their id, whatever their texts' length.

    Only rows outside the held-out third are taken (crc32 of the id as text,
    modulo 3, is 1 for the held-out); labels other than 0 and 1 are left out.  Of rows
    that share an id, the least text is taken; of labels that do, the greater.  Tasks
    turn whole texts into bags, and bags of at most BUCKETS entries come to the driver.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).withColumn("rank", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("toxic") == c).orderBy("rank").limit(sample) for c in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "toxic"))  # at most 2 * sample rows
    rows = docs.join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def make():
        def run(block: list[str]) -> list:
            got = bags_of(block)
            return [pa.array([b.tobytes() for b, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())]

        return run

    found = map_texts(rows, make, "buckets binary, weights binary", BATCH).toArrow().sort_by("doc_id")
    parts = [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)) for b, w in zip(found["buckets"].to_pylist(), found["weights"].to_pylist(), strict=True)]
    return fit(parts, [int(x) for x in found["toxic"].to_pylist()])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null counts as empty; a text without words gets the score of the bias alone.
    Without labelled rows of both classes every document gets the smoothed share
    of toxic labels.  Rows repeat as in the input; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    model = train(rows, labels, sample)
    held = docs.sparkSession.sparkContext.broadcast((model.scores, model.bias))  # BUCKETS floats

    def make():
        mine = Model(*held.value)
        return lambda block: [pa.array(mine.score(block), pa.float64())]

    scored = map_texts(rows, make, "score double", BLOCK_DOCS)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` not predicted toxic, with all their columns; the model is fitted on ``train_docs``.

    A null text counts as empty.  Rows keep their columns as they are, names that
    operators use elsewhere included.
    """
    model = train(texts(train_docs), labels)
    held = docs.sparkSession.sparkContext.broadcast((model.scores, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(*held.value)
        for batch in batches:
            for part in blocks(batch, BLOCK_DOCS):
                yield part.filter(pa.array(np.array(mine.score([t or "" for t in part.column("text").to_pylist()])) < CUT))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
