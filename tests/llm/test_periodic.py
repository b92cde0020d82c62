"""Periodic runs against a direct comparison of every period."""

import hashlib
import random
import re
import zlib

import numpy as np

from engram.llm import periodic, queries


def brute(words, least=12):
    """[(start, length, period)] of all maximal runs."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 6]), rng.randint(0, 130)
    words = []
    while len(words) < n:
        words += [rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 5)
        if rng.random() < .3:
            a = rng.randrange(len(words))
            words += words[a:a + rng.randint(1, 30)]
    return words[:n]


def test_runs_equal_the_direct_search():
    rng = random.Random(8)
    for _ in range(1500):
        words, least = random_words(rng), rng.choice([2, 5, 12])
        start, end, period = periodic.periodic_runs(np.array(words, np.int64), least)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == brute(words, least), words


def test_known_words():
    fib = [0]
    a, b = [0], [0, 1]
    while len(b) < 800:
        a, b = b, b + a
    for words in (b, [1] * 3000, [0, 1] * 700, list(range(500)) * 2, [0] * 40 + [1] + [0] * 40 + [1] + [0] * 40):
        start, end, period = periodic.periodic_runs(np.array(words, np.int64))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == brute(words)


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    values = rng.permutation(1000)
    tree = periodic.WaveletTree(values)
    lo = rng.integers(0, 999, 300)
    hi = lo + 1 + rng.integers(0, 1000 - lo)
    x = rng.integers(0, 1200, 300)
    assert tree.below(lo, hi, x).tolist() == [(values[a:b] < y).sum() for a, b, y in zip(lo, hi, x)]
    k = rng.integers(0, hi - lo)
    assert tree.smallest(lo, hi, k).tolist() == [np.sort(values[a:b])[i] for a, b, i in zip(lo, hi, k)]


def split(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def expected(doc, text):
    words, h = split(text), zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_the_direct_version(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a", "a b " * 6, "a b " * 5 + "a", "x y " * 12, "word " * 3000, " a\x0b" * 15, "é " * 12 + "z", ". . , , " * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, " ".join(map(str, random_words(rng)))) for i in range(20, 200)] + [(3, "a"), (None, "b " * 20), (None, None)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, n_words string, runs int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in queries.op12(spark, str(tmp_path)).collect()], key=str)
    assert got == sorted([(i, *expected(i, t)) for i, t in rows], key=str)


def test_operator_keeps_texts_and_small_batches_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b " * 10 + "c"), (1, "q"), (2, "a b " * 10)], "k int, t string")
    want = [(1, 1, [], "q"), (1, 21, [(0, 20, 2)], "a b c"), (2, 20, [(0, 20, 2)], "a b")]
    for size in (1 << 20, 1):
        monkeypatch.setattr(periodic, "BATCH_BYTES", size)
        got = sorted((r["k"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.runs(df, "k", "t").collect())
        assert got == want
    assert periodic.runs(df.limit(0), "k", "t").count() == 0


def test_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12(spark, "/root/testdata/sf0.001").collect()}
    short = [r for r in docs if len(split(r["text"])) <= 700]
    assert len(got) == len(docs) and len(short) > 150
    assert all(got[r["doc_id"]] == expected(r["doc_id"], r["text"]) for r in short)
