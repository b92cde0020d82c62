"""Hilbert shards, M-tree search and line dedup against direct versions."""

import math
import random

import pytest

from pyspark.sql import functions as F

from engram.llm import hilbert, line_dedup, mtree


# -- Hilbert curve --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_steps_to_neighbours(spark, dims, bits):
    side = 1 << bits
    df = spark.range(side ** dims).select(*[((F.col("id") / side ** k).cast("long") % side).cast("int").alias(f"c{k}") for k in range(dims)])
    rows = sorted(hilbert.curve_index(df, [f"c{k}" for k in range(dims)], bits, "h").collect(), key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(side ** dims))
    assert all(sum(abs(a[f"c{k}"] - b[f"c{k}"]) for k in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    rng = random.Random(2)
    rows = [(rng.choice([i, i, 5, None]), rng.choice(["x", "x", "x", "y", None]), rng.randrange(1, 3000), "keep") for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, kind string, size long, shard_name string")
    out = hilbert.shards(df, {"kind": hilbert.label_cell(F.col("kind"), 4), "size": hilbert.log_cell(F.col("size"), 4)}, ["id", "size"], "size", 16, law=law, bits=4).collect()
    assert len(out) == len(rows) and all(r["shard_name"] == "keep" for r in out)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(16))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        share = sum(r["size"] for r in out) / 16
        assert all(abs(sum(r["size"] for r in part) - share) <= 3000 for part in by.values())
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert all(a["curve"] <= b["curve"] for a, b in zip(ordered, ordered[1:]))


def test_shards_of_nothing_and_files(spark, tmp_path):
    df = spark.createDataFrame([], "id long, size long")
    assert hilbert.shards(df, {"size": hilbert.log_cell(F.col("size"), 4)}, ["id"], "size", 16).count() == 0
    some = hilbert.shards(spark.range(100).withColumn("size", F.col("id") + 1), {"size": hilbert.log_cell(F.col("size"), 4)}, ["id"], "size", 4)
    hilbert.write_shards(some, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_shards_keep_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(i, 10 + i % 7, f"s{i}", f"t{i}", i) for i in range(60)], "id long, slot long, shard string, curve string, __x long")
    out = hilbert.shards(df, {"size": hilbert.log_cell(F.col("slot"), 4)}, ["id", "curve"], "slot", 4, bits=4)
    assert out.columns.count("shard") == 1 and {r["id"]: (r["slot_in"], r["shard_in"], r["curve_in"], r["__x"]) for r in out.collect()} == {i: (10 + i % 7, f"s{i}", f"t{i}", i) for i in range(60)}
    assert {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()} == dict.fromkeys(range(4), 15)


def plain_index(cells, bits):
    """Hilbert index by walking down the cube: each step turns the axes as the curve does inside the sub-cube."""
    x, n = list(cells), len(cells)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        if x[n - 1] & q:
            t ^= q - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + ((v ^ t) >> b & 1)
    return out


def test_query_equals_a_plain_version(spark):
    """op8 on the small documents: cells as the engine names them, everything behind them worked out in Python."""
    import zlib
    from engram.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))) + 1)
    cells = docs.select("doc_id", "text", "size", hilbert.label_cell(F.col("lang"), 6).alias("a"), hilbert.label_cell(F.col("source"), 6).alias("b"), hilbert.log_cell(F.col("size"), 6).alias("c")).collect()
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in cells)
    rows = sorted((plain_index((r["a"], r["b"], r["c"]), 6), r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["size"]) for r in cells)
    n, want, slots = len(rows), {}, {}
    for rank, (curve, doc, crc, size) in enumerate(rows):
        shard = rank * 16 // n
        want[doc] = (size, crc, "rows", shard, slots.setdefault(shard, 0), None, curve)
        slots[shard] += 1
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op8_hilbert_shards"](spark, sf).collect()}
    assert got == want


# -- M-tree ---------------------------------------------------------------------------------------------------------------------
def direct(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
            out |= {(q, r + 1, i, -s_) for r, (s_, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("page", [7, 1024])
def test_top_k_equals_direct_search(spark, monkeypatch, page):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "BLOCK", 3)
    rng = random.Random(page)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]                              # a third of all rows is one vector
    rows += [(500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6), (505, [0.0] * 6), (506, [100.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    import numpy as np
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {tuple(r) for r in mtree.top_k(df, "vec_id", "embedding", lambda i: i % 10 == 0).collect()}
    assert got == direct(exact, 5, 10)


def test_descent_leaves_out_no_ball_in_reach():
    import numpy as np
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 5)) * 30
    x = np.concatenate([c + rng.normal(size=(40, 5)) for c in centres])
    norm = float((x * x).sum(axis=1).max())
    routes = x[rng.permutation(len(x))[:60]]
    lift = lambda v: np.concatenate([v, np.sqrt(np.maximum(norm - (v * v).sum(axis=1), 0))[:, None]], axis=1)
    away = np.sqrt(((lift(x)[:, None] - lift(routes)[None]) ** 2).sum(axis=2))
    parent = away.argmin(axis=1)
    radius = np.array([away[parent == r, r].max(initial=-1.0) for r in range(len(routes))])
    upper = mtree.Upper(routes, radius, norm)
    q = np.concatenate([x[:30], rng.normal(size=(10, 5)) * 40])
    dist = np.sqrt(((np.c_[q, np.zeros(len(q))][:, None] - lift(x)[None]) ** 2).sum(axis=2))
    reach = np.sort(dist, axis=1)[:, 5]
    query, route, d = upper.descend(q, reach, 1)
    got = set(zip(query.tolist(), route.tolist()))
    assert {(i, int(parent[j])) for i, j in zip(*np.nonzero(dist <= reach[:, None]))} <= got and len(got) < 0.7 * len(q) * len(routes)
    query, route, d = upper.descend(q, np.full(len(q), np.inf), 3)
    assert np.bincount(query).tolist() == [3] * len(q) and all(a <= b for a, b, i, j in zip(d, d[1:], query, query[1:]) if i == j)


def test_top_k_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, -0.2])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in mtree.top_k(df, "vec_id", "embedding", lambda i: i % 50 == 0).collect()} == {(0, 1, 1, 25 * 76 + 51 * -52)}
    assert mtree.top_k(df.limit(0), "vec_id", "embedding", lambda i: i % 50 == 0).count() == 0


def test_products_beyond_doubles():
    import numpy as np
    a = np.array([[2.0 ** 30, 3.0]])
    assert mtree.products(a, a).tolist() == [[2 ** 60 + 9]]


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (50, [1.0, 1.0]), (51, [2.0, 1.0]), (52, [0.5, 4.0]), (53, []), (50, [0.0, 3.0]), (54, [1.0, 1.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"], r["score"]) for r in mtree.top_k(df.filter("vec_id <> 50 OR embedding[0] = 1"), "vec_id", "embedding", lambda i: i % 50 == 0).collect()}
    good = [r for r in rows if r != (50, [0.0, 3.0]) and r[1]]
    want = {(q, i, int(sum(256 * x * 256 * y for x, y in zip(a, b)))) for q, a in good if q % 50 == 0 for i, b in good if i != q}
    assert got - {x for x in got if x[1] == 53} == want
    assert mtree.top_k(df, "vec_id", "embedding", lambda i: i % 50 == 0).count() > 0


# -- line dedup -----------------------------------------------------------------------------------------------------------------
def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return min(2, sum(x != y for x, y in zip(a, b)))
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return 1 if any(long[:i] + long[i + 1:] == short for i in range(len(long))) else 2


def brute_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            long = len(line.strip(" ")) >= line_dedup.MIN_CHARS
            if not (long and any(edits(line, s) <= 1 for s in seen)):
                keep.append(line)
            if long:
                seen.append(line)
        out[i] = "\n".join(keep)
    return out


def test_lines_equal_direct_version(spark):
    rng = random.Random(6)
    bases = ["".join(rng.choice("abé🙂 ") for _ in range(rng.choice([12, 13, 17, 40]))) for _ in range(25)]
    def edited(s):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(s) + 1)
            s = rng.choice([s[:p] + "z" + s[p:], s[:p] + s[p + 1:], s[:p] + "y" + s[p + 1:]])
        return s
    rows = [(i, "\n".join([edited(rng.choice(bases)) for _ in range(rng.randrange(0, 6))] + rng.choice([[], ["short"], [""]]))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)


def test_line_edges(spark):
    long = "a line that is long enough"
    rows = [(1, long, 0), (1, long, 0), (2, f"{long}\n{long}!\nshort\nshort", 0), (3, None, 0), (None, long, 0), (4, "", 0), (5, "x" * 60000, 0), (6, "x" * 59999, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int")
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "first", "__lines", "__dropped"}
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[1] == long and text[2] == "short\nshort" and text[3] is None and text[None] == long and text[4] == "" and text[6] == ""
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
