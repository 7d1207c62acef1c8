"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed words, word pairs and character n-grams (3 and 4
bytes, never across a word end); a pair of equal words shares one bucket with
all such pairs.  Each hash bucket has a learned vector; the average over the
text goes through a softmax layer.  Both are trained by plain stochastic
gradient descent in numpy on at most ``LABELLED_ROWS`` labelled documents, taken
in the order of a hash of their id; the rest of the work is one map over whole
texts.  Only the text is an input of a score.

Defined results: a null or empty text has the zero vector and gets the score of
the bias; labels other than 0 and 1 are ignored; without labels of both classes
every score is the share of label 1 (0.5 without any); a null id is never held
out; repeated rows each keep their row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import SPACE, map_rows, mix, pick, prefix_hash, word_spans

LABELLED_ROWS = 4000
BUCKET_BITS = 17
DIMENSIONS = 10
EPOCHS = 12
RATE = 20.0
CUTOFF = 0.3


def buckets_of(text: str | None) -> np.ndarray:
    """Bucket numbers of all words and n-grams of a text, repeats included."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    shift = np.uint64(64 - BUCKET_BITS)
    sums, inverse = prefix_hash(data)
    starts, ends = word_spans(data)
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    pairs[words[:-1] == words[1:]] = 1
    found = [words >> shift, pairs >> shift]
    blank = SPACE[data]
    for n in (3, 4):
        if len(data) < n:
            continue
        count = len(data) - n + 1
        inside = ~blank[1 : 1 + count]
        for k in range(2, n - 1):
            inside &= ~blank[k : k + count]
        at = np.flatnonzero(inside)
        found.append(mix((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n)) >> shift)
    return np.concatenate(found).astype(np.int64)


class Model:
    """Vectors per bucket, softmax weights and biases."""

    def __init__(self, vectors, weights, bias):
        self.vectors, self.weights, self.bias = vectors, weights, bias

    def line(self) -> tuple[np.ndarray, float]:
        """Per bucket, and as a constant, the logit of label 1 against label 0.

        The average and the softmax layer are linear up to the logit, so a score
        needs one number per bucket.
        """
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(bags: list[tuple[np.ndarray, np.ndarray, int, int]]) -> Model:
    """Stochastic gradient descent over (buckets, counts, all counts, label), in a fixed random order."""
    rng = np.random.default_rng(17)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS))
    weights, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    share = np.mean([b[3] for b in bags]) if bags else 0.5
    if len({b[3] for b in bags}) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(vectors * 0, weights, np.log(np.array([1 - share, share])))
    weights += rng.normal(0, 0.1, weights.shape)
    bias += np.log(np.array([1 - share, share]))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(bags)):
            at, counts, size, y = bags[i]
            w = counts / max(size, 1)
            rows = vectors[at]
            hidden = w @ rows
            logits = weights @ hidden + bias
            e = np.exp(logits - logits.max())
            grad = e / e.sum()
            grad[y] -= 1
            back = grad @ weights
            weights -= 0.02 * rate * np.outer(grad, hidden)
            bias -= 0.002 * rate * grad
            vectors[at] = rows - rate * np.outer(w, back)
    return Model(vectors, weights, bias)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, text, quality of at most ``rows`` labelled documents that are not held out."""
    chosen = (
        pick(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    )
    return pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows go out


class _Bags:
    """Buckets and counts of a labelled text, as bytes: at most 8 for each of the buckets, however long the text."""

    def __call__(self, rows):
        for doc_id, text, quality in rows:
            idx = buckets_of(text)
            at, counts = np.unique(idx, return_counts=True)
            yield doc_id, int(quality), len(idx), at.astype("<u4").tobytes(), counts.astype("<u4").tobytes()


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """The model of the labelled rows; texts stay in the tasks, the driver gets their bucket counts."""
    bags = map_rows(training_rows(docs, labels, rows).select("doc_id", "text", "quality"), "doc_id long, quality int, size long, at binary, counts binary", _Bags())
    held = sorted((tuple(r) for r in bags.toLocalIterator()), key=lambda b: b[:3])
    ends = np.cumsum([len(b[3]) // 4 for b in held])[:-1] if held else []
    at, counts = (np.split(np.frombuffer(b"".join(b[k] for b in held), dtype="<u4"), ends) if held else [] for k in (3, 4))
    sizes = [b[1:3] for b in held]
    del held
    return train([(a, c, size, y) for a, c, (y, size) in zip(at, counts, sizes)])


class _Score:
    def __init__(self, model):
        self.per_bucket, self.constant = model.line()

    def score(self, text):
        idx = buckets_of(text)
        logit = self.constant + (float(self.per_bucket[idx].mean(dtype=np.float64)) if len(idx) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


class _DocScore(_Score):
    def __call__(self, rows):
        for doc_id, out, text in rows:
            score = self.score(text)
            yield doc_id, out, score, int(score >= CUTOFF)


class _Keep(_Score):
    """Whole document rows whose text is accepted."""

    def __init__(self, model, at):
        super().__init__(model)
        self.at = at

    def __call__(self, rows):
        return (row for row in rows if self.score(row[self.at]) >= CUTOFF)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    narrow = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(narrow, "doc_id long, held_out boolean, score double, predicted int", _DocScore(model))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, that the classifier does not reject."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, schema, _Keep(model, docs.columns.index("text")))
