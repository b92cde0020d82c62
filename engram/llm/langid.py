"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a language by rank. A document's own most frequent n-grams are compared with
each profile: every n-gram adds the difference of its two ranks, or the greatest difference if the profile lacks it. The language with
the smallest sum wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.llm.common import broadcast_below

PROFILE = 400              # n-grams of a language profile
OWN = 300                  # n-grams of a document
GRAMS = (1, 2, 3)
SAMPLE = 4000              # documents per language, about, that the profiles are learned from
REMEMBERED = 200_000       # words kept per Python worker
WORD = re.compile(r"[^\W\d_]+")      # letters, and numbers like fractions and Roman numerals, which words_of takes out


def grams_of(word: str) -> list[str]:
    marked = f"_{word}_"
    out = list(word)
    for n in GRAMS:
        if n > 1:
            out += [marked[i:i + n] for i in range(len(marked) - n + 1)]
    return out


def words_of(text: str) -> Counter:
    """Counts of the runs of letters in a whole text."""
    counts = Counter(WORD.findall(text.lower()))
    for odd in [w for w in counts if not w.isalpha()]:
        n = counts.pop(odd)
        for word in "".join(c if c.isalpha() else " " for c in odd).split():
            counts[word] += n
    return counts


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bound: int = SAMPLE) -> DataFrame:
    """About `bound` documents of each language (all, if it has fewer), chosen by a hash of the id.

    Only counts per language are gathered for it; no language is sorted or held in one task."""
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    sizes = known.groupBy(lang_col).agg(F.count("*").alias("__n"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(23)), F.lit(1 << 30))
    # a row per language; beyond 10,000 languages the join would shuffle
    return known.join(broadcast_below(sizes, 10_000), lang_col).filter(draw < F.lit(float(1 << 30)) * bound / F.col("__n")).select(id_col, text_col, lang_col)


def learn(docs: DataFrame, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """(language, n-grams by rank) per language; equal counts are ordered by the n-gram.

    Every task counts the n-grams of its texts per language and hands on its counts, which Spark sums. Null languages and null texts
    teach nothing. What reaches the driver is PROFILE rows per language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        def flush():
            rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                words.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            for lang, c in words.items():
                own = counts.setdefault(lang, Counter())
                for w, n in c.items():
                    for g in grams_of(w):
                        own[g] += n
            if sum(map(len, counts.values())) > 300_000:
                yield flush()
        yield flush()

    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    grams = known.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = grams.withColumn("r", rank).filter(F.col("r") <= PROFILE).orderBy("lang", "r").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return sorted(out.items())


class Ranker:
    """Distances of texts to fixed profiles. N-grams get numbers on first sight; a word's numbers are remembered per Python worker."""

    def __init__(self, profiles: list[tuple[str, list[str]]]):
        self.langs = [lang for lang, _ in profiles]
        self.number: dict[str, int] = {}
        self.words: dict[str, np.ndarray] = {}
        ranks = [{g: r for r, g in enumerate(grams)} for _, grams in profiles]
        for g in sorted({g for r in ranks for g in r}):
            self.number[g] = len(self.number)
        self.known = len(self.number)     # beyond these no profile has the n-gram
        self.rank = np.full((len(self.langs), self.known + 1), -1, dtype=np.int32)
        for k, r in enumerate(ranks):
            for g, at in r.items():
                self.rank[k, self.number[g]] = at

    def numbers(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None:
            number = self.number
            got = np.array([number.setdefault(g, len(number)) for g in grams_of(word)], dtype=np.int32)
            if len(word) <= 64:
                self.words[word] = got
        return got

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score); the score is 1 less the distance as a share of the greatest possible one."""
        counts = words_of(text)
        if not counts or not self.langs:
            return "und", 0.0
        if len(self.words) >= REMEMBERED or len(self.number) >= 4 * REMEMBERED:   # between texts only: numbers hold within a text
            self.words.clear()
            for g in [g for g, i in self.number.items() if i >= self.known]:
                del self.number[g]
        parts = [self.numbers(w) for w in counts]
        flat = np.concatenate(parts)
        total = np.bincount(flat, weights=np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), [len(p) for p in parts]))
        seen = np.flatnonzero(total)
        # by falling count; equal counts put n-grams of the profiles first, in their fixed order, then the others in order of sight
        order = seen[np.argsort(-total[seen], kind="stable")][:OWN]
        ranks = self.rank[:, np.minimum(order, self.known)]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(order))))
        sums = away.sum(axis=1)
        best = int(np.argmin(sums))
        return self.langs[best], 1.0 - float(sums[best]) / (PROFILE * len(order))


def predict(docs: DataFrame, id_col: str, text_col: str, profiles: list[tuple[str, list[str]]]) -> DataFrame:
    """(id, lang_pred, score) of every whole text. A text that is null or has no letter is `und` with score 0; ties go to the first
    language by name. Null ids and repeated rows keep their rows, other columns are not read, an empty table gives an empty one; without
    any profile every text is `und`. The broadcast profiles have PROFILE entries per language."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Ranker(shared.value)
        for batch in batches:
            made = [r.predict(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[id_col, "lang_pred", "score"])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
