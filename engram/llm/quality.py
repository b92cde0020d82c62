"""Quality classifier by supervised subword embeddings.

A document is the mean of learned vectors: one per hashed word and per hashed character n-gram of its words. A softmax layer on the
mean gives the class. Vectors and layer are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled
documents. A word that only repeats the one before it is read as a repeat mark, whose vector is learned like any other.

Because layer and mean are linear, each word adds a fixed amount to the logit: scoring needs one number per bucket, and each word is
worked out once per Python worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress
from math import exp
from operator import ne
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.common import remembered

BUCKETS = 1 << 17
GRAMS = (3, 4)
DIM = 12
SAMPLE = 1500              # labelled documents per class that the training may read
REMEMBERED = 300_000       # words kept per Python worker
REPEAT = "\x02repeat"


def buckets_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its character n-grams, with marks for its ends."""
    if word == REPEAT:
        return [crc32(b"\x02repeat") % BUCKETS]
    raw = f"<{word}>".encode("utf-8", "surrogatepass")
    out = [crc32(raw) % BUCKETS]
    for n in GRAMS:
        out += [crc32(raw[i:i + n]) % BUCKETS for i in range(len(raw) - n + 1)]
    return out


def word_counts(text: str) -> dict[str, int]:
    """Counts of the words of a whole text; a word equal to the one before it counts as the repeat mark."""
    words = text.split()
    fresh = Counter(compress(words, map(ne, words, [None, *words])))
    repeats = len(words) - fresh.total()
    if repeats:
        fresh[REPEAT] = repeats
    return fresh


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, weights that sum to 1) of a text; both empty for a text without words."""
    total: Counter = Counter()
    for word, n in word_counts(text).items():
        for b in buckets_of(word):
            total[b] += n
    idx = np.fromiter(total.keys(), np.int32, len(total))
    val = np.fromiter(total.values(), np.float64, len(total))
    return idx, (val / val.sum() if len(val) else val)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 0.6, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logit contribution of each bucket, and bias, after plain SGD with a falling rate over shuffled examples.

    Classes weigh alike whatever their counts. Without examples of both classes the model is neutral (the share of class 1).
    """
    rng = np.random.default_rng(seed)
    y = np.array([e[2] for e in examples], dtype=int)
    counts = np.bincount(y, minlength=2) if len(y) else np.zeros(2, int)
    if counts.min() == 0:
        share = (counts[1] + 1) / (counts.sum() + 2)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    weight = counts.sum() / (2.0 * counts)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM))
    layer = np.zeros((DIM, 2))
    bias = np.zeros(2)
    steps, t = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            idx, val, label = examples[k]
            lr = rate * (1 - t / steps)
            t += 1
            if not len(idx):
                continue
            mean = val @ vectors[idx]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            err = p
            err[label] -= 1.0
            err *= weight[label]
            back = layer @ err
            layer -= lr * np.outer(mean, err)
            bias -= lr * err
            # the mean spreads a gradient over thousands of buckets; scaled back by the largest weight each step stays of one size
            vectors[idx] -= np.outer(lr * val / val.max(), back) * 0.5
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Model of a bounded sample (doc_id, text, y). Features are made where the texts are; one task, whose input SAMPLE bounds, trains on
    them, and the driver gets the finished logits of BUCKETS buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32())), batch.column(2)], names=["doc_id", "idx", "val", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(i.values.to_numpy(), v.values.to_numpy().astype(float), y) for batch in batches for i, v, y in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist())]
        logits, bias = train(examples)
        yield pa.RecordBatch.from_arrays([pa.array([logits], pa.list_(pa.float64())), pa.array([bias], pa.float64())], names=["logits", "bias"])

    made = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, idx array<int>, val array<float>, y int")
    model = made.repartition(1).sortWithinPartitions("doc_id", "y").mapInArrow(learn, "logits array<double>, bias double").toArrow()
    return (model["logits"].combine_chunks().flatten().to_numpy(), model["bias"][0].as_py()) if model.num_rows else train([])


def scorer(table: np.ndarray, bias: float):
    """Function from text to the probability of class 1; remembers words across the tasks of a Python worker."""
    values, words = remembered("quality", float(table.sum()) + bias, lambda: (table.tolist(), {}))

    def score(text: str) -> float:
        total, features_seen = 0.0, 0
        for word, n in word_counts(text).items():
            got = words.get(word)
            if got is None:
                b = buckets_of(word)
                got = (sum([values[i] for i in b]), len(b))
                if len(word) <= 64:
                    if len(words) >= REMEMBERED:
                        words.clear()
                    words[word] = got
            total += n * got[0]
            features_seen += n * got[1]
        z = bias + (total / features_seen if features_seen else 0.0)
        return 1 / (1 + exp(-z)) if z > -700 else 0.0
    return score


def score(docs: DataFrame, id_col: str, text_col: str, model: tuple[np.ndarray, float]) -> DataFrame:
    """(id, score) of every whole text, score being the probability of class 1.

    A null or empty text, or one of white space only, has no features and gets the score of the bias. Null ids and repeated rows keep
    their rows, other columns are not read, an empty table gives an empty one. The broadcast model has BUCKETS numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = scorer(*shared.value)
        for batch in batches:
            out = [f(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[id_col, "score"])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def kept(docs: DataFrame, text_col: str, model: tuple[np.ndarray, float], least: float) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores `least` or more. Rows are judged one by one where they stand, so
    nulls, repeated ids and clashing names need no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([f(t.as_py() or "") >= least for t in batch.column(at)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
