"""Maximal periodic runs in the words of every document, by internal pattern matching.

Blocks of 2^k words at multiples of 2^k ask where they occur again in the windows that follow. A run of period q with
2^(k+1) - 1 <= q <= 2^(k+2) - 2 is at least 2q words long, so its part without the last q words holds a whole block of that level, and this
block occurs again q words later. Those starts fill two windows of 2^k starts each; occurrences of a block inside such a window form one
arithmetic progression, so the first, the second and the last one (range successors and predecessors in a wavelet tree over the suffix
array) give all of them. Every member is a candidate period; how far it reaches is read off the names of the dyadic blocks.

Suffix array and names come from one doubling: names of length 2^(k+1) are pairs of names of length 2^k, and a name is the place in the
suffix array where its class begins. Only places whose name still has a second bearer are named anew. Documents are put end to end for it, but
a word's first name is made of document and word, so nothing ever matches across documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20      # bytes of text that are put end to end; a longer document is a batch of its own
MIN_WORDS = 12


class Names:
    """Names of all dyadic blocks and the suffix array of integer words."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        order = np.argsort(words, kind="stable")
        new = np.r_[True, words[order][1:] != words[order][:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        name = np.empty(n, np.int32)
        name[order] = start
        sizes = np.diff(np.r_[np.flatnonzero(new), n])
        self.levels, self.sizes = [name], [self._by_start(start[new], sizes)]
        active = order[np.repeat(sizes, sizes) > 1]
        step = 1
        while len(active):
            name = self.levels[-1]
            ahead = active + step
            second = np.where(ahead < n, name[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
            key = name[active].astype(np.int64) * (n + 1) + second
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            at = np.arange(len(active))
            old = name[active]
            new = np.r_[True, key[1:] != key[:-1]]
            first_old = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
            first_new = np.maximum.accumulate(np.where(new, at, 0))
            name = name.copy()
            name[active] = old + (first_new - first_old)
            sizes = np.diff(np.r_[np.flatnonzero(new), len(active)])
            self.levels.append(name)
            self.sizes.append(self._by_start(name[active[new]], sizes))
            active = active[np.repeat(sizes, sizes) > 1]
            step *= 2
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[self.levels[-1]] = np.arange(n, dtype=np.int32)

    def _by_start(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.ones(self.n, np.int32)       # a name that is not listed has one bearer
        out[starts] = sizes
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal (i < j)."""
        i, j = i.copy(), j.copy()
        begin = j.copy()
        for k in range(len(self.levels) - 2, -1, -1):     # names of the last level are all different
            name, step = self.levels[k], 1 << k
            same = (j < self.n) & (name[i] == name[np.minimum(j, self.n - 1)])
            i += same * step
            j += same * step
        return j - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal (i < j)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 2, -1, -1):
            name, step = self.levels[k], 1 << k
            same = (i >= step) & (name[np.maximum(i - step, 0)] == name[j - step])
            i -= same * step
            j -= same * step
        return begin - i


class WaveletTree:
    """Counts and order statistics of values in any range of a permutation of 0..n-1, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []      # number of 0 bits before each place, top bit first
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit & 1) == 0
            self.zeros.append(np.r_[0, np.cumsum(low, dtype=np.int32)])
            values = np.concatenate([values[low], values[~low]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places lo..hi-1 are less than x."""
        out = np.where(x >= 1 << self.bits, hi - lo, 0)
        x = np.minimum(x, (1 << self.bits) - 1)
        over = out > 0
        for d, zeros in enumerate(self.zeros):
            a, b, one = zeros[lo], zeros[hi], (x >> (self.bits - 1 - d) & 1) == 1
            out = out + np.where(one & ~over, b - a, 0)
            lo, hi = np.where(one, lo - a + zeros[-1], a), np.where(one, hi - b + zeros[-1], b)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of places lo..hi-1."""
        out = np.zeros(len(lo), np.int64)
        for d, zeros in enumerate(self.zeros):
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out |= np.where(one, 1 << (self.bits - 1 - d), 0)
            lo, hi = np.where(one, lo - a + zeros[-1], a), np.where(one, hi - b + zeros[-1], b)
        return out


def _progressions(tree: WaveletTree, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of every place in begin..end-1 that the range lo..hi-1 of the suffix array holds."""
    before = tree.below(lo, hi, begin)
    many = tree.below(lo, hi, end) - before
    some = np.flatnonzero(many > 0)
    before, many, lo, hi = before[some], many[some], lo[some], hi[some]
    first = tree.smallest(lo, hi, before)
    step = np.zeros(len(some), np.int64)
    more = np.flatnonzero(many > 1)
    step[more] = tree.smallest(lo[more], hi[more], before[more] + 1) - first[more]
    last = first.copy()
    last[more] = tree.smallest(lo[more], hi[more], before[more] + many[more] - 1)
    if not np.array_equal(first + (many - 1) * step, last):
        raise AssertionError("occurrences in a window of one block length form a progression")
    which = np.repeat(np.arange(len(some)), many)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return some[which], first[which] + nth * step[which]


def periodic_runs(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of integer words, by start, then period; period is the smallest one of the run,
    length >= max(min_words, 2 * period), end exclusive."""
    none = np.zeros(0, np.int64)
    if len(words) < 2:
        return none, none, none
    names = Names(words)
    tree = WaveletTree(names.suffixes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(len(names.levels)):
        size = 1 << k
        if 2 * size - 1 > names.n // 2:
            break
        block = np.arange(0, names.n - size + 1, size)
        lo = names.levels[k][block]
        many = names.sizes[k][lo]
        keep = many > 1                              # the others occur nowhere else
        block, lo, hi = block[keep], lo[keep], (lo + many)[keep]
        for window in (2 * size - 1, 3 * size - 1):
            begin = block + window
            query, place = _progressions(tree, lo, hi, np.minimum(begin, names.n), np.minimum(begin + size, names.n))
            found.append((block[query], place - block[query]))
    at, period = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    start = at - names.behind(at, at + period)
    end = at + period + names.ahead(at, at + period)
    keep = end - start >= np.maximum(min_words, 2 * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))         # multiples of the smallest period cover the same words
    start, end, period = start[order], end[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words per text, all words) at ASCII white space."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    return np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(texts)), flat.filter(real)


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Rows in a row of together at most ``limit`` bytes, or one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def runs(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, repeat: tuple[Column, Column, Column] | None = None,
         keep_text: bool = True, digests: bool = False) -> DataFrame:
    """(id, n_words, runs array<struct<start,length,period>>[, collapsed][, runs_sha256, collapsed_sha256]) of every whole text.

    A run is a longest stretch of words `[^\\x20\\x09-\\x0D]+` with smallest period q and at least max(min_words, 2q) words; runs come by start,
    then period. `collapsed` keeps of every run its first q words. A null or empty text has no words and no runs; null and repeated ids
    give a row each; other columns are not read; an empty table gives an empty one. `repeat` names three integer columns (a, p, on) that plant
    periodic tails for a test: where `on`, word i >= a becomes word a + (i - a) % p, with a taken modulo the number of words n and p counted as
    1 + floor((n - a) / p). Memory of a task: some 150 bytes a word of BATCH_BYTES or of the longest document.
    """
    schema = (f"`{id_col}` {dict(df.dtypes)[id_col]}, n_words long, runs array<struct<start: long, length: long, period: long>>"
              + ", collapsed string" * keep_text + ", runs_sha256 string, collapsed_sha256 string" * digests)
    plant = [F.lit(None).cast("long")] * 3 if repeat is None else [c.cast("long") for c in repeat]
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = [id_col, "n_words", "runs"] + ["collapsed"] * keep_text + ["runs_sha256", "collapsed_sha256"] * digests

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, flat = _split(batch.column(1))
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(len(count)), count)
        take = np.arange(len(row))
        a, p, on = (pc.fill_null(batch.column(k), 0).to_numpy() for k in (2, 3, 4))
        if on.any():
            a = a % np.maximum(count, 1)
            p = 1 + (count - a) // np.maximum(p, 1)
            i, a, p = take - first[row], a[row], p[row]
            take = np.where((on[row] > 0) & (i >= a), first[row] + a + (i - a) % p, take)
        coded = flat.dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)[take]
        start, end, period = periodic_runs(row * (len(coded.dictionary) + 1) + word, min_words)
        mark = np.zeros(len(row) + 1, np.int64)
        np.add.at(mark, start + period, 1)
        np.add.at(mark, end, -1)
        kept = np.cumsum(mark[:-1]) == 0
        doc = row[start] if len(start) else start
        per_doc = np.bincount(doc, minlength=len(count))
        inside, length = start - first[doc], end - start
        cuts = pa.array(np.r_[0, np.cumsum(per_doc)], pa.int32())
        cols = [batch.column(0), pa.array(count, pa.int64()),
                pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(inside), pa.array(length), pa.array(period)], fields=list(struct)))]
        left = flat.take(pa.array(take[kept]))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[kept], minlength=len(count)))], pa.int32()), left), " ")
        if keep_text:
            cols.append(text)
        if digests:
            lines = [f"{s},{n},{q}\n" for s, n, q in zip(inside.tolist(), length.tolist(), period.tolist())]
            at = cuts.to_pylist()
            cols += [pa.array([hashlib.sha256("".join(lines[b:e]).encode()).hexdigest() for b, e in zip(at, at[1:])], pa.string()),
                     pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in text], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), BATCH_BYTES):
                yield part(batch.slice(start, stop - start))

    return df.select(id_col, text_col, *[c.alias(f"__plant{k}") for k, c in enumerate(plant)]).mapInArrow(run, schema)
