"""Components against all pairs, on groups of near copies of every similarity."""

import random

import numpy as np
import pytest

from engram.llm import hyperminhash as H


def brute(rows, width, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    sets = {i: grams(t) for i, t in rows}
    parent = {i: i for i in sets}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12, copies=14, size=90):
    rng, rows, n = random.Random(seed), [], 0
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 8, size]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_all_pairs(spark, width):
    rows = corpus(width) + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One"), (9005, "oNE"), (9006, "É one"), (9007, "é one")]
    got = {r["doc_id"]: r for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", width, 80).collect()}
    want = brute(rows, width, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_tiles_and_open_pairs(spark, monkeypatch):
    # a chain of texts, each like its neighbours only: hubs cannot close it, tiles of four rows must
    monkeypatch.setattr(H, "TILE", 4)
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6:i * 6 + 100])) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 1, 80).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 1, 80).items()}
    assert len(set(got.values())) == 1


def test_edges(spark):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (None, "a b c", 2), (2, "A B\tC ", 3), (3, "z " * 20000 + "y", 4), (None, None, 5), (None, "q r s", 6), (None, "Q r s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in H.near_duplicates(df, "doc_id", "text", 2).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 3, True), (None, 2, 1, False), (None, 0, None, True), (None, 2, None, True), (None, 2, None, True)]
    assert got == sorted(want, key=str)
    assert H.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_rows_that_share_an_id_lose_no_link(spark):
    rows = [(1, "a b c d"), (1, "x y z w"), (2, "x y z w"), (3, "a b c d"), (None, "a b c d")]
    got = H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2, 80).collect()
    assert sorted([(r["doc_id"], r["component_id"], r["kept"]) for r in got], key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False)], key=str)
    assert sorted(r["doc_id"] for r in got if r["first"]) == [1, 1]


def test_registers_keep_order_and_estimates_are_centred():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 2 ** 64, 3000, dtype=np.uint64))
    reg = H.registers(h)
    # a register is smaller if the bucket's smallest hash is
    first = {int(b): int(x) for x in h[::-1] for b in [x >> np.uint64(57)]}
    order = sorted(first, key=lambda b: first[b] & ((1 << 57) - 1))
    assert all(reg[a] <= reg[b] for a, b in zip(order, order[1:]))
    errors = []
    for _ in range(200):
        x = rng.integers(0, 2 ** 64, 1000, dtype=np.uint64)
        a, b = np.unique(x[:900]), np.unique(x[100:])
        ra, rb = H.registers(a), H.registers(b)
        errors.append(float(H.estimate(np.array([(ra == rb).sum()]), np.array([128]), np.array([900.0]), np.array([900.0]))[0]) - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
