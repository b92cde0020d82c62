"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed words, their stems (first letters), pairs of neighbours and pairs with one word between them, each
counted once. Training visits a
bounded sample of labelled texts; every coordinate has its own learning rate and an L1 threshold, so few weights differ from 0 and the
model is a short list of (bucket, weight).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.common import remembered

BITS = 20
SAMPLE = 3000              # labelled documents per class that the training may read
REMEMBERED = 300_000       # word hashes kept per Python worker
WORD = re.compile(r"\w+")
NEXT, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FALSE_ALARMS = 0.005       # share of clean documents that may score 0.7 or more
STEMS = (4, 5, 6)          # letters of the stems; a word no longer than a stem has none


def word_hashes(text: str) -> np.ndarray:
    """A row per word: its hash and those of its stems (0: none)."""
    out, known = [], remembered("toxicity", "words", dict)
    for w in WORD.findall(text.lower()):
        h = known.get(w)
        if h is None:
            if len(known) >= REMEMBERED:
                known.clear()
            h = tuple(crc32(x.encode("utf-8", "surrogatepass")) if x else 0 for x in (w, *(f"{w[:k]}-" if len(w) > k else "" for k in STEMS)))
            if len(w) <= 64:
                known[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64).reshape(-1, 1 + len(STEMS))


def buckets(text: str) -> np.ndarray:
    """Hashed words, stems, neighbour pairs and one-gap pairs of a whole text, with repeats."""
    rows = word_hashes(text)
    h, stems = rows[:, 0], rows[:, 1:].ravel()
    stems = stems[stems != 0]
    shift = np.uint64(64 - BITS)
    mix = lambda x: (x * NEXT) >> shift
    with np.errstate(over="ignore"):
        return np.concatenate([mix(h + np.uint64(1)), mix(stems + np.uint64(2)), mix(h[:-1] * SKIP + h[1:]), mix((h[:-2] + np.uint64(7)) * SKIP + h[2:] * np.uint64(3))]).astype(np.int32)


def train(examples: list[tuple[np.ndarray, int]], epochs: int = 5, alpha: float = 0.4, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias). z and n are the proximal state; a weight is 0 until its summed gradient passes l1.

    Classes weigh alike. Without examples of both classes there are no weights and the bias is the share of class 1.
    """
    y = np.array([e[1] for e in examples], dtype=int)
    counts = np.bincount(y, minlength=2) if len(y) else np.zeros(2, int)
    if counts.min() == 0:
        share = (counts[1] + 1) / (counts.sum() + 2)
        return np.zeros(0, np.int32), np.zeros(0), float(np.log(share / (1 - share)))
    share = counts.sum() / (2.0 * counts)
    size = (1 << BITS) + 1                        # the last coordinate is the bias, which has no L1 threshold
    z, n = np.zeros(size), np.zeros(size)
    threshold = np.full(size, l1)
    threshold[-1] = 0.0

    def weights(at):
        s = z[at]
        return np.where(np.abs(s) <= threshold[at], 0.0, -(s - np.sign(s) * threshold[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            idx, label = examples[k]
            at = np.append(idx, size - 1)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * share[label]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    keep = np.flatnonzero(w[:-1])
    return keep.astype(np.int32), w[keep], float(w[-1])


def calibrated(examples: list[tuple[np.ndarray, int]], at: float = 0.7, folds: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """``train`` with the bias raised until a share of FALSE_ALARMS of unseen clean examples scores ``at`` or more.

    Weights fit their own examples almost perfectly and are shy of new ones. So each fold is scored by weights of the others, and the
    cut that lets the given share of clean examples pass is put where the caller cuts. The bias is never lowered; fewer than `folds`
    examples of a class leave it alone."""
    keep, w, bias = train(examples)
    y = np.array([e[1] for e in examples], dtype=int)
    if not len(y) or np.bincount(y, minlength=2).min() < folds:
        return keep, w, bias
    # dealt per class in order, so that every fold has both
    fold = np.empty(len(y), int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % folds
    seen = np.empty(len(y))
    for k in range(folds):
        part, v, b = train([e for e, f in zip(examples, fold) if f != k])
        dense = np.zeros(1 << BITS)
        dense[part] = v
        seen[fold == k] = [b + dense[examples[i][0]].sum() for i in np.flatnonzero(fold == k)]
    clean = np.sort(seen[y == 0])[::-1]
    cut = clean[int(FALSE_ALARMS * len(clean))] + 1e-6
    return keep, w, bias + max(0.0, log(at / (1 - at)) - cut)


def fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Model of a bounded sample (doc_id, text, y). Features are made where the texts are; one task, whose input SAMPLE bounds, trains on
    them, and the driver gets the weights that are not zero, at most 2^BITS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(buckets(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "idx", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = calibrated([(i.values.to_numpy(), y) for batch in batches for i, y in zip(batch.column(1), batch.column(2).to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.list_(pa.int32())), pa.array([w], pa.list_(pa.float64())), pa.array([bias], pa.float64())], names=["at", "w", "bias"])

    made = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, idx array<int>, y int")
    model = made.repartition(1).sortWithinPartitions("doc_id", "y").mapInArrow(learn, "at array<int>, w array<double>, bias double").toArrow()
    return (model["at"].combine_chunks().flatten().to_numpy(), model["w"].combine_chunks().flatten().to_numpy(), model["bias"][0].as_py()) if model.num_rows else train([])


def score(docs: DataFrame, id_col: str, text_col: str, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(id, score, n_features) of every whole text: probability of class 1 and the number of its features that carry weight.

    A null or empty text has no features and gets the score of the bias. Null ids and repeated rows keep their rows, other columns
    are not read, an empty table gives an empty one. The broadcast model holds the non-zero weights only, at most 2^BITS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        carries = dense != 0
        for batch in batches:
            scores, hits = [], []
            for t in batch.column(1):
                b = buckets(t.as_py() or "")
                b = np.unique(b[carries[b]])
                v = bias + float(dense[b].sum())
                scores.append(1 / (1 + exp(-v)) if v > -700 else 0.0)
                hits.append(len(b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int32())], names=[id_col, "score", "n_features"])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, n_features int")
