"""Pairs from packed items: slabs, thresholds in the task, null items."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import pairs as X
from engram.operators import pairs as P


@pytest.mark.parametrize("held", [1 << 23, 12])
def test_products_of_packed_items(spark, monkeypatch, held):
    monkeypatch.setattr(X, "HELD", held)
    rng = np.random.default_rng(3)
    m = np.where(rng.random((7, 40)) < 0.5, rng.integers(1, 5, (7, 40)), 0).astype(float)
    rows = [("s", f"c{c}", b, float(m[c, b])) for c in range(7) for b in range(40) if m[c, b]] + [("s", None, b, 1.0) for b in range(5)]
    df = spark.createDataFrame(rows, "s string, cell string, bin bigint, v double")
    hit = m > 0
    for tiles in (None, 3):
        out = X.pair_products(df, None, ["s"], "cell", "bin", "v", coord_block=8, tiles=tiles, sizes=True)
        got = {(r["a"], r["b"]): (r["n"], r["sxy"], r["n_a"], r["n_b"]) for r in out.collect()}
        assert got == {(f"c{a}", f"c{b}"): ((hit[a] & hit[b]).sum(), m[a] @ m[b], hit[a].sum(), hit[b].sum()) for a, b in itertools.combinations(range(7), 2)}
        some = {(r["a"], r["b"]) for r in X.pair_products(df, None, ["s"], "cell", "bin", "v", coord_block=8, tiles=tiles, sums=False, least=0.55).collect()}
        assert some == {k for k, v in got.items() if v[0] / min(v[2:]) >= 0.55} and 0 < len(some) < len(got)
    left, right = df.filter("cell < 'c4'"), df.filter("cell > 'c1'")
    for ordered in (False, True):
        got = {(r["a"], r["b"]): r["n"] for r in X.pair_products(left, right, ["s"], "cell", "bin", "v", coord_block=8, tiles=2, ordered=ordered).collect()}
        assert got == {(f"c{a}", f"c{b}"): (hit[a] & hit[b]).sum() for a in range(4) for b in range(2, 7) if (a < b if ordered else a != b)}


def test_an_item_is_sent_as_one_row(spark):
    """A row per pixel and tile filled the disk (components, corr_degree and all other queries of pairs)."""
    df = spark.range(600).select((F.col("id") % 6).alias("cell_id"), F.col("id").alias("x"), F.lit(0).alias("y"))
    for out in (P.overlap_pixels(df, [], "cell_id", 64, tiles=3), P.pearson_above(df.withColumn("v", F.lit(1.0)), [], "cell_id", "x", "v", 600, 0.5)):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        sent = text[text.index("explode(sequence") if "explode(sequence" in text else text.index("explode("):]
        assert "collect_list" in sent       # items are packed below the copies for their tiles
    assert P.overlap_pixels(df, [], "cell_id", 64).count() == 0


def test_tiles_widen_and_tasks_write_strips(spark, monkeypatch):
    """44 copies of every cell filled the disk (90,000 cells of F2-F4, F8-F11; 60,000 of F6, F7, F12, F13)."""
    assert [X.tile_count(k, 1 << 17) for k in (1, 2048, 2049, 15_000, 90_000, 540_000)] == [1, 1, 2, 8, 8, 33]
    assert X.tile_count(60_000, 7_000) == 9 and X.tile_count(10_000, 100) == 100
    monkeypatch.setattr(X, "NARROW", 2)
    monkeypatch.setattr(X, "FEW", 2)
    monkeypatch.setattr(X, "ENTRIES", 400)
    monkeypatch.setattr(X, "HELD", 64)      # a batch and a strip hold few pairs
    monkeypatch.setattr(X, "STRIP", 3)
    monkeypatch.setattr(P, "STRIP", 3)
    rng = np.random.default_rng(5)
    m = np.where(rng.random((23, 90)) < 0.4, rng.integers(1, 5, (23, 90)), 0).astype(float)
    df = spark.createDataFrame([(c, b, float(m[c, b])) for c in range(23) for b in range(90) if m[c, b]], "cell bigint, bin bigint, v double")
    out = X.pair_products(df, None, [], "cell", "bin", "v", coord_block=128, sizes=True).collect()
    hit = m > 0
    assert len(out) == 23 * 22 // 2
    assert {(r["a"], r["b"]): (r["n"], r["sxy"], r["n_a"]) for r in out} == {(a, b): ((hit[a] & hit[b]).sum(), m[a] @ m[b], hit[a].sum()) for a, b in itertools.combinations(range(23), 2)}
    r = np.corrcoef(m)
    got = P.pearson_above(df, [], "cell", "bin", "v", 90, 0.05)
    assert "EvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()      # p is made where r is
    want = {(a, b): r[a, b] for a, b in itertools.combinations(range(23), 2) if r[a, b] >= 0.05}
    assert {(g["a"], g["b"]): g["r"] for g in got.collect()} == pytest.approx(want)


def test_a_crowded_square_is_met_in_pieces(spark, monkeypatch):
    """All cells around one place were joined in one task (F28, centroid_distance)."""
    from engram.operators import joins as J
    monkeypatch.setattr(J, "CROWD", 5)
    rng = np.random.default_rng(1)
    at = [(c, float(x), float(y)) for c, (x, y) in enumerate(np.vstack([rng.random((25, 2)), 10 * rng.random((15, 2))]))]
    out = J.centroid_distance(spark.createDataFrame(at, "cell int, x double, y double"), [], "cell", 1.2)
    assert "_p#" in out._jdf.queryExecution().optimizedPlan().toString()      # the piece is part of the join key
    want = {(a, b): np.hypot(ax - bx, ay - by) for (a, ax, ay), (b, bx, by) in itertools.combinations(at, 2) if np.hypot(ax - bx, ay - by) <= 1.2}
    assert {(r["a"], r["b"]): r["distance"] for r in out.collect()} == pytest.approx(want) and len(want) > 100


def test_all_correlations_without_a_join(spark):
    rng = np.random.default_rng(8)
    m = np.where(rng.random((9, 12)) < 0.5, rng.random((9, 12)), 0.0)
    m[0, 6:], m[1, :6] = 0.0, 0.0      # these two share no bin
    rows = [(c, int(10**10 * b), float(m[c, b])) for c in range(9) for b in range(12) if m[c, b]]
    df = spark.createDataFrame(rows + [(None, 0, 1.0), (0, 5, 0.0), (0, 5, None)], "cell bigint, bin bigint, v double")
    out = P.pearson_pairs(df, [], "cell", "bin", "v", 12, tiles=2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]): r["r"] for r in out.collect()}
    assert got.keys() == {(a, b) for b in range(9) for a in range(b)}
    assert all(abs(v - np.corrcoef(m[a], m[b])[0, 1]) < 1e-9 for (a, b), v in got.items())


def test_a_batch_ends_with_its_strip(spark):
    """3,000 cells of a tile are multiplied in strips that no number of whole batches fills; the batch after the last one named cells of the next strip."""
    cells = spark.range(3000).select(F.col("id").alias("cell"), F.floor(F.col("id") / 2).alias("bin"), (F.col("id") % 7 + 1.0).alias("v"))
    got = {(r["a"], r["b"]): (r["n"], r["sxy"]) for r in X.pair_products(cells, None, [], "cell", "bin", "v", tiles=1).collect()}
    assert got == {(a, a + 1): (1, (a % 7 + 1.0) * ((a + 1) % 7 + 1.0)) for a in range(0, 3000, 2)}
    every = P.pearson_pairs(cells, [], "cell", "bin", "v", 1500, tiles=1).agg(F.count("r"), F.countDistinct("a"), F.sum((F.col("r") > 0.999).cast("int")), F.sum((F.col("b") > F.col("a")).cast("int"))).first()
    assert tuple(every) == (3000 * 2999 // 2, 2999, 1500, 3000 * 2999 // 2)


def test_all_distances(spark):
    """centroid_distance kept the pairs within 1.2 only and left out all others."""
    from engram.operators import joins as J
    from engram.plans.catalog import ORACLE
    rng = np.random.default_rng(2)
    at = [(c, float(x), float(y)) for c, (x, y) in enumerate(60 * rng.random((30, 2)))]
    out = J.centroid_distance(spark.createDataFrame(at + [(99, None, 1.0), (None, 2.0, 2.0)], "cell int, x double, y double"), [], "cell").collect()
    assert {(r["a"], r["b"]): r["distance"] for r in out if r["b"] < 99} == pytest.approx({(a, b): np.hypot(ax - bx, ay - by) for (a, ax, ay), (b, bx, by) in itertools.combinations(at, 2)})
    assert len(out) == 31 * 30 // 2 and all(r["distance"] is None for r in out if r["b"] == 99)
    assert "1.2" not in ORACLE["centroid_distance"]


def test_near_cells_are_correlated_in_tiles(spark):
    """A row per near pair, session and vector met for every correlation (candidate_pairs_center)."""
    rng = np.random.default_rng(4)
    m = np.where(rng.random((2, 12, 30)) < 0.5, rng.random((2, 12, 30)), 0.0)
    m[0, 3] = 0.0
    rows = [(f"s{s}", c, b, float(m[s, c, b])) for s in range(2) for c in range(12) for b in range(30) if m[s, c, b]]
    act = spark.createDataFrame(rows + [(None, 1, 0, 1.0), (None, 2, 0, 1.0), ("s0", None, 0, 1.0)], "s string, cell bigint, bin bigint, v double")
    dist = spark.createDataFrame([(a, b, float(b - a)) for b in range(12) for a in range(b)], "a bigint, b bigint, distance double")
    out = P.candidate_pairs_center(dist, act, ["s"], "cell", "bin", "v", 30, 4.0, 0.1)
    assert "_xy" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {(f"s{s}", a, b) for s in range(2) for b in range(12) for a in range(max(b - 4, 0), b) if m[s, a].any() and m[s, b].any() and np.corrcoef(m[s, a], m[s, b])[0, 1] >= 0.1}
    assert {tuple(r) for r in out.collect()} == want and len(want) > 10
    kept = P.pearson_pairs(act, ["s"], "cell", "bin", "v", 30, tiles=3, r_min=0.1).collect()
    every = P.pearson_pairs(act, ["s"], "cell", "bin", "v", 30).filter("r >= 0.1").collect()
    assert {(r["s"], r["a"], r["b"]) for r in kept} == {(r["s"], r["a"], r["b"]) for r in every} and len(kept) == len(every)
