"""Closed-form cases, invariants and brute force on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import kernels as K
from engram.functions.blocks import frame_block, run_bounds, sequence
from engram.functions.pvalue import pearson_p
from engram.functions.quantiles import exact_quantile
from engram.operators import decode as E, fields as D, filters as FI, graph as H, joins as J, maps as M, nulls as N, occupancy as O, pairs as P, sequences as Q, signal as G
from engram.sources import files as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_speed_closed_forms(spark):
    t = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(50)], "s string, frame bigint, x double, y double")
    v = Q.speed(t, ["s"], "frame", "x", "y", 0.5)
    assert {r["speed"] for r in v.collect()} == {2.0}
    circle = spark.createDataFrame([("a", i, 28 * math.cos(i / 50), 28 * math.sin(i / 50)) for i in range(100)], "s string, frame bigint, x double, y double")
    got = [r["speed"] for r in Q.speed(circle, ["s"], "frame", "x", "y").collect()]
    assert np.std(got) < 1e-9 and abs(np.mean(got) - 2 * 28 * math.sin(0.01)) < 1e-9


def test_moving_average_repeats_ends(spark):
    t = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 6, 3])], "s string, frame bigint, v double")
    got = [r["m"] for r in Q.moving_average(t, ["s"], "frame", "v", 3, "m").orderBy("frame").collect()]
    assert np.allclose(got, [4 / 3, 3, 11 / 3, 4])


@pytest.mark.parametrize("size", [1, 3, 100])
def test_blocks_do_not_change_sequences(spark, size):
    rng = np.random.default_rng(1)
    vals = [None if x < 0.3 else float(round(x, 2)) for x in rng.random(40)]
    df = spark.createDataFrame([("a", i, vals[i]) for i in range(40)], "k string, frame bigint, v double")
    got = sequence(df, ["k"], ["frame"], frame_block("frame", size), number="n", lag={"lag": "v"}, lead={"lead": "v"},
                   cumsum={"cum": F.coalesce("v", F.lit(0.0))}, ffill={"ff": "v"}, bfill={"bf": "v"}).orderBy("frame").collect()
    last = None
    for i, r in enumerate(got):
        last = vals[i] if vals[i] is not None else last
        nxt = next((v for v in vals[i:] if v is not None), None)
        assert r["n"] == i and r["ff"] == last and r["bf"] == nxt
        assert r["lag"] == (vals[i - 1] if i else None) and r["lead"] == (vals[i + 1] if i < 39 else None)
        assert abs(r["cum"] - sum(v or 0 for v in vals[: i + 1])) < 1e-9


@pytest.mark.parametrize("size", [1, 4, 100])
def test_runs_cross_blocks(spark, size):
    s = [0, 1, 1, 1, 0, 0, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(s)], "k string, frame bigint, v int")
    got = run_bounds(df, ["k"], ["frame"], frame_block("frame", size), F.col("v") == 1, "frame").orderBy("frame").collect()
    at = 0
    for v, g in itertools.groupby(s):
        n = len(list(g))
        for j in range(n):
            r = got[at + j]
            assert (r["run_start"], r["run_end"], r["state"], r["is_start"]) == (at, at + n - 1, v == 1, j == 0)
        at += n


def test_binarize_runs_shift_and_ends(spark):
    s = [1, 1, 0, 1, 1, 1, 0, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(s)], "k string, frame bigint, v int")
    got = [r["bin"] for r in Q.binarize_runs(df, ["k"], "frame", F.col("v") == 1, 2).orderBy("frame").collect()]
    assert got == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, p):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=501), "b": np.r_[np.zeros(300), rng.random(41)], "c": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    got = dict(rows(exact_quantile(df, ["k"], "v", p, accuracy=50)))
    for k, vs in data.items():
        assert abs(got[k] - np.quantile(vs, p)) < 1e-12


def test_convolve_matches_numpy_across_blocks(spark):
    x = np.random.default_rng(0).normal(size=97)
    w = K.gaussian(2.0)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, frame bigint, v double")
    got = [r["o"] for r in K.convolve(df, ["k"], "frame", "v", w, "o", size=20).orderBy("frame").collect()]
    assert np.allclose(got, np.convolve(x, w, "same"))


def test_pearson_p_known_values():
    # r = 0.5 over 3 points: p = 2/3; r = 0 gives 1; two-sided t tables: t = 2.228 at 10 df is p = 0.05.
    r = 2.228138852 / math.sqrt(10 + 2.228138852 ** 2)
    assert np.allclose(pearson_p(np.array([0.5, 0.0, r, -r, np.nan]), np.array([3, 20, 12, 12, 9])), [2 / 3, 1, 0.05, 0.05, 1], atol=1e-7)


@pytest.mark.parametrize("tiles", [1, 3])
def test_pearson_pairs_brute_force(spark, tiles):
    rng = np.random.default_rng(5)
    m = np.where(rng.random((7, 30)) < 0.3, rng.random((7, 30)), 0.0)
    m[5] = m[4]
    m[6] = 0.0
    m[6, 3] = 1.0
    df = spark.createDataFrame([(c, b, float(m[c, b])) for c in range(7) for b in range(30) if m[c, b]], "cell int, bin bigint, v double")
    got = {(r["a"], r["b"]): r["r"] for r in P.pearson_pairs(df, [], "cell", "bin", "v", 30, tiles=tiles).collect()}
    assert len(got) == 21
    for (a, b), v in got.items():
        assert abs(v - np.corrcoef(m[a], m[b])[0, 1]) < 1e-9
    few = P.pearson_pairs(df, [], "cell", "bin", "v", 30, min_bursts=2, tiles=tiles).filter("b = 6").collect()
    assert all(r["r"] is None for r in few)


def test_constant_and_opposite_cells(spark):
    df = spark.createDataFrame([(0, b, float(b + 1)) for b in range(6)] + [(1, b, float(6 - b)) for b in range(6)] + [(2, b, 2.0) for b in range(6)],
                               "cell int, bin bigint, v double")
    got = {(r["a"], r["b"]): (r["r"], r["p"]) for r in P.pearson_pairs(df, [], "cell", "bin", "v", 6, tiles=1, with_p=True).collect()}
    assert abs(got[0, 1][0] + 1) < 1e-9 and got[0, 2] == (None, 1.0)


@pytest.mark.parametrize("held", [1 << 23, 60])
def test_pairs_above_a_threshold_and_pairs_of_candidates(spark, monkeypatch, held):
    monkeypatch.setattr(P, "HELD", held)
    monkeypatch.setattr(P, "VECTOR", 7)
    rng = np.random.default_rng(5)
    rows, r = [], {}
    for session, n in (("x", 30), ("y", 11)):
        m = np.where(rng.random((9, n)) < 0.4, rng.integers(1, 4, (9, n)), 0).astype(float)
        m[3], m[4], m[5] = m[2] * 2, 1.0, 0.0
        rows += [(session, f"c{c}", b, float(m[c, b]), n) for c in range(9) for b in range(n) if m[c, b]]
        for a, b in itertools.combinations(range(9), 2):
            if m[a].std() and m[b].std():
                r[session, f"c{a}", f"c{b}"] = np.corrcoef(m[a], m[b])[0, 1]
    df = spark.createDataFrame(rows, "s string, cell string, bin int, v double, n int")
    for least in (0.2, 0.99, -1.0):
        got = {(x["s"], x["a"], x["b"]): x for x in P.pearson_above(df, ["s"], "cell", "bin", "v", F.col("n"), least).collect()}
        assert got.keys() == {k for k, v in r.items() if v >= least - 1e-12}
        assert all(abs(got[k]["r"] - r[k]) < 1e-9 and got[k]["n"] == (30 if k[0] == "x" else 11) and 0 <= got[k]["p"] <= 1 for k in got)
    some = [k for i, k in enumerate(sorted(r)) if i % 3 == 0] + [("x", "c0", "c4")]
    pairs = spark.createDataFrame(some, "s string, a string, b string")
    got = {(x["s"], x["a"], x["b"]): x["r"] for x in P.pearson_of(pairs, df.filter("s = 'x'"), ["s"], "cell", "bin", "v", 30).collect()}
    assert got.keys() == {k for k in some if k[0] == "x"} and got.pop(("x", "c0", "c4")) is None
    assert all(abs(got[k] - r[k]) < 1e-9 for k in got)


def test_no_plan_of_a_threshold_holds_all_pairs(spark):
    from engram.plans.catalog import QUERIES
    names = "corr_graph corr_threshold candidate_pairs_center degree_dist isolates_ratio graph_density corr_degree degree_prune subsample_nodes".split()
    for name in names:
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        text = df._jdf.queryExecution().analyzed().toString()
        assert "_ti" not in "".join(line for line in text.splitlines() if "Join" in line), name


def test_overlap_counts(spark):
    square = lambda c, x0: [(c, x, y) for x in range(x0, x0 + 4) for y in range(4)]
    df = spark.createDataFrame(square(0, 0) + square(1, 2) + square(2, 50), "cell_id int, x int, y int")
    assert rows(P.overlap_pixels(df, [], "cell_id", 64, tiles=2)) == [(0, 1, 8, 0.5, 0.5)]


def greedy_hub(edges):
    edges, gone = {tuple(sorted(e)) for e in edges}, set()
    while edges:
        deg = {}
        for e in edges:
            for v in e:
                deg[v] = deg.get(v, 0) + 1
        top = max(deg, key=lambda v: (deg[v], v))
        gone.add(top)
        edges = {e for e in edges if top not in e}
    return gone


@pytest.mark.parametrize("seed", [0, 1])
def test_graph_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    e = {tuple(sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(45)} | {(100, 101), (101, 102)}
    df = spark.createDataFrame(sorted(e), "src bigint, dst bigint")
    assert {r["node"] for r in H.dedup_hub(df).collect()} == greedy_hub(e)
    label = {v: v for pair in e for v in pair}
    moved = True
    while moved:
        moved = False
        for a, b in e:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert dict(rows(H.components(df))) == label


def test_dedup_snr_is_the_step_by_step_removal(spark):
    rng = np.random.default_rng(2)
    cells = list(range(8))
    r = {(a, b): float(rng.random()) for a in cells for b in cells if a < b}
    snr = {c: float(rng.random()) for c in cells}
    left, gone = set(cells), []
    while len(left) > 1 and max(v for (a, b), v in r.items() if a in left and b in left) > 0.6:
        low = min(left, key=lambda c: (snr[c], c))
        gone.append(low)
        left.discard(low)
    comps = spark.createDataFrame([(c, 0) for c in cells], "node bigint, component bigint")
    corr = spark.createDataFrame([(0, a, b) for (a, b), v in r.items() if v > 0.6], "component bigint, a bigint, b bigint")
    s = spark.createDataFrame(list(snr.items()), "node bigint, snr double")
    assert {x["node"] for x in H.dedup_snr(comps, corr, s).collect()} == set(gone)


def test_knn_brute_force_with_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)).round(3)
    x[10:19] = x[9]
    x[30] = x[31]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "frame bigint, vec array<double>")
    got = dict(rows(E.knn_sum(df, "frame", "vec", 6, slab_rows=12)))
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, :6].sum(1)
    assert np.allclose([got[i] for i in range(60)], d)


def test_nearest_centroid_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 3)
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(30, 3)), rng.normal(size=(10, 3))
    s = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "frame bigint, vec array<double>")
    cs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "label int, c array<double>")
    got = {r["frame"]: r["nearest"] for r in E.nearest_centroid(s, "vec", cs, "label", "c").collect()}
    want = np.abs(x[:, None] - c[None]).sum(2).argmin(1)
    assert [got[i] for i in range(30)] == list(want)
    # ties across tiles go to the smallest label; a null state stays; equal states are one question
    monkeypatch.setattr(E, "ROWS", 2)
    s = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [5.0, 1.0])], "frame bigint, vec array<double>")
    cs = spark.createDataFrame([(9, [1.0, 0.0]), (4, [0.0, 1.0]), (6, [-1.0, 0.0]), (2, [5.0, 3.0]), (1, None)], "label int, c array<double>")
    got = {r["frame"]: (r["nearest"], r["distance"]) for r in E.nearest_centroid(s, "vec", cs, "label", "c").collect()}
    assert got == {0: (4, 1.0), 1: (4, 1.0), 2: (None, None), 3: (2, 2.0)}
    assert {r["nearest"] for r in E.nearest_centroid(s, "vec", cs.limit(0), "label", "c").collect()} == {None}


def test_knn_of_clusters_in_many_dimensions_looks_at_few(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 64)) * 20
    x = np.concatenate([c + rng.normal(size=(20, 64)) * 0.1 for c in centres] + [np.zeros((30, 64)) + rng.integers(0, 2, (30, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "frame bigint, vec array<double>")
    seen = []
    cut = E.cut_lineage
    def watch(t):
        out = cut(t)
        if out.columns == ["_id", "vec", "_cell", "_piece"]:
            seen.append(out.count())
        return out
    monkeypatch.setattr(E, "cut_lineage", watch)
    got = dict(rows(E.knn_sum(df, "frame", "vec", 6, slab_rows=20)))
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, :6].sum(1)
    assert np.allclose([got[i] for i in range(len(x))], d, atol=1e-9)
    assert seen[0] < 0.25 * 402 * 40       # of some 40 cells, each state asks few


def strip(spark, wall, width=1, size=40):
    cells = [(0, 1, y, x, 1.0) for y in range(size) for x in range(size)
             if {"l": x < width, "r": x >= size - width, "b": y < width, "t": y >= size - width}[wall]]
    return spark.createDataFrame(cells, "unit int, field int, iy int, ix int, rate double")


def arena(spark, size=40):
    return spark.createDataFrame([(0, y, x) for y in range(size) for x in range(size)], "unit int, iy int, ix int")


def test_border_coverage_closed_forms(spark):
    seen = arena(spark)
    cov = lambda f, **k: M.border_coverage(seen, f, ["unit"], "field", (40, 40), **k).first()["coverage"]
    for w in "lrtb":
        assert cov(strip(spark, w), search_width=1, walls=w) == 1
    assert cov(strip(spark, "l"), search_width=1, walls="trb") == 1 / 40
    assert cov(strip(spark, "l").filter("iy < 10"), walls="l") == 0.25
    assert cov(strip(spark, "l").filter("iy < 0")) == 0
    with pytest.raises(ValueError):
        M.border_coverage(seen, strip(spark, "l"), ["unit"], "field", (40, 40), walls="abc")
    score = M.border_score(seen, strip(spark, "b"), ["unit"], "field", "rate", (40, 40), walls="b").first()
    assert abs(score["score"] - (1 - 0.05) / (1 + 0.05)) < 1e-9
    assert tuple(M.border_score(seen, strip(spark, "b").filter("iy < 0"), ["unit"], "field", "rate", (40, 40)).first())[1:] == (-1.0, 0.0)


def test_offset_border_with_unseen_bins(spark):
    seen = arena(spark).filter("ix >= 3")
    f = arena(spark).filter("ix = 3").withColumn("field", F.lit(1))
    assert M.border_coverage(seen, f, ["unit"], "field", (40, 40), 8, "l").first()["coverage"] == 1


def gauss_map(centres, shape, sigma):
    y, x = np.indices(shape)
    return sum(10 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * sigma ** 2)) for a, b in centres)


def map_df(spark, m):
    return spark.createDataFrame([(0, int(y), int(x), float(m[y, x])) for y, x in np.ndindex(*m.shape)], "unit int, iy int, ix int, rate double")


def test_place_fields_find_the_bumps(spark):
    centres = [(10, 10), (28, 25), (12, 33)]
    got = D.place_fields(map_df(spark, gauss_map(centres, (40, 40), 2.5)), ["unit"], "rate", (40, 40))
    props = M.field_props(got, ["unit", "field"], "rate").collect()
    assert {(r["peak_iy"], r["peak_ix"]) for r in props} == set(centres) and all(9 <= r["area"] < 150 for r in props)


def test_holes_and_labels():
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert D._has_hole(ring, np.zeros((7, 7), bool))
    assert not D._has_hole(ring, np.eye(7, dtype=bool))       # the hole was never visited
    ring[2, 3] = ring[1, 3] = False
    assert not D._has_hole(ring, np.zeros((7, 7), bool))      # open to the outside
    diag = np.zeros((5, 5), bool)
    diag[1, 1:4] = diag[3, 1:4] = diag[1:4, 1] = diag[1:4, 3] = True
    diag[1, 1] = False
    assert D._has_hole(diag, np.zeros((5, 5), bool))          # a diagonal gap is no way out
    lab = D._label(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 1]], bool), D.PLUS)
    assert len(set(lab[lab > 0])) == 4 and len(set(D._label(lab > 0, D.RING)[lab > 0])) == 1


def test_autocorrelation_brute_force():
    v = np.random.default_rng(8).random((6, 9))
    r = D.autocorrelation(v)
    h, w = r.shape[0] // 2, r.shape[1] // 2
    for dy, dx in [(0, 0), (2, -3), (-1, 4), (4, 0)]:
        a = v[max(dy, 0): 6 + min(dy, 0), max(dx, 0): 9 + min(dx, 0)]
        b = v[max(-dy, 0): 6 + min(-dy, 0), max(-dx, 0): 9 + min(-dx, 0)]
        assert abs(r[h + dy, w + dx] - np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 1e-9


def test_hexagonal_grid(spark):
    step, size = 24, 121
    centres = [(60 + i * step * math.sqrt(3) / 2, 60 + (j + (i % 2) / 2) * step) for i in range(-4, 5) for j in range(-4, 5)]
    ac = D.autocorrelogram(map_df(spark, gauss_map(centres, (size, size), 5.0)), ["unit"], "rate", (size, size))
    score = D.grid_score(ac, ["unit"])
    assert score.first()["score"] > 0.8
    st = M.grid_stats(D.grid_peaks(ac, score, ["unit"]), ["unit"]).first()
    assert abs(st["spacing"] - step) < 1.5 and abs(st["orientation"]) < 5
    assert rows(M.nearest6(D.grid_peaks(ac, score, ["unit"]), ["unit"]).select("rank")) == [(k,) for k in range(1, 7)]


def test_identical_and_inverse_maps(spark):
    m = gauss_map([(5, 5)], (12, 12), 2.0)
    a, b = map_df(spark, m), map_df(spark, -m)
    assert abs(P.map_cross_corr(a, a, ["unit"], "rate").first()["r"] - 1) < 1e-9
    assert abs(P.map_cross_corr(a, b, ["unit"], "rate").first()["r"] + 1) < 1e-9


def test_histograms_keep_all_values(spark):
    v = np.random.default_rng(9).random(1000) * 80
    df = spark.createDataFrame([(0, float(x)) for x in [*v, 80.0]], "k int, v double")
    for kw in ({}, {"bin_width": 2.5}, {"bin_number": 7}):
        assert O.accumulate_spatial(df, ["k"], {"i": ("v", 80.0, 0.0)}, **kw).agg(F.sum("n")).first()[0] == 1001
    with pytest.raises(ValueError):
        O.bins_of(80.0, bin_width=1.0, bin_number=3)


def test_walk_filter_modes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 6.0)], "speed double, x double")
    assert rows(FI.walk_filter(df, "speed", 3.0, ["x"])) == [(5.0, 6.0)]
    assert FI.walk_filter(df, "speed", 3.0, ["x"], "mask").filter("x is null").count() == 1
    with pytest.raises(ValueError):
        FI.walk_filter(df, "speed", 3.0, [], "drop")


def test_shuffles_keep_the_values(spark):
    df = spark.createDataFrame([(c, f, float(f * (c + 1))) for c in range(3) for f in range(50)], "cell_id int, frame bigint, v double")
    out = N.circ_shift(df, "cell_id", "frame", F.lit(50), 4)
    for c, k in itertools.product(range(3), range(5)):
        part = out.filter((F.col("cell_id") == c) & (F.col("shuffle") == k)).collect()
        assert sorted(r["frame"] for r in part) == list(range(50)) and sorted(r["v"] for r in part) == [float(f * (c + 1)) for f in range(50)]
    t = spark.createDataFrame([(1, int(v)) for v in np.linspace(1000, 13000, 40)], "unit int, t bigint")
    s = N.shuffle_times(t, "unit", "t", 2300, 0, 14000, 5)
    assert s.count() == 200 and s.agg(F.max("t")).first()[0] <= 14000
    with pytest.raises(ValueError):
        N.shuffle_times(t, "unit", "t", 8000, 0, 14000, 5)


def test_poisson_recovers_coefficients(spark):
    rng = np.random.default_rng(11)
    rec = [(c, float(x), float(y), 200.0, float(rng.poisson(200 * math.exp(-1 + 0.2 * x - 0.1 * c * y))))
           for c in range(3) for x in range(6) for y in range(5)]
    st = spark.createDataFrame(rec, "cell int, x double, y double, w double, s double")
    for r in E.poisson_tuning(st, "cell").collect():
        assert abs(r["b0"] + 1) < 0.1 and abs(r["b1"] - 0.2) < 0.03 and abs(r["b2"] + 0.1 * r["cell"]) < 0.05


def test_lag_histogram_equals_pairs(spark):
    t = np.sort(np.random.default_rng(12).integers(0, 5000, 300))
    df = spark.createDataFrame([(1, int(v)) for v in t], "unit int, t bigint")
    got = {r["bin"]: r["n"] for r in J.lag_histogram(df, "unit", "t", 200, 20).collect()}
    want = {}
    for a in t:
        for b in t:
            if 0 < b - a <= 200 and a + 200 < t[-1]:
                k = min(int((b - a) / 10), 19)
                want[k] = want.get(k, 0) + 1
    assert got == want


def test_track_files(spark, tmp_path):
    (tmp_path / "dlc.csv").write_text("scorer,a,a,a\nbodyparts,n,n,n\ncoords,x,y,likelihood\n0,1.5,2.5,0.9\n1,3,4,0.1\n")
    assert rows(R.read_tracking_csv(spark, str(tmp_path / "dlc.csv"), 1)) == [(0, 0, 1.5, 2.5, 0.9), (1, 0, 3.0, 4.0, 0.1)]
    (tmp_path / "tr.csv").write_text(" ,C0,C1\nTime(s),accepted,accepted\n0.0,1000,2000\n0.1,500,250\n")
    assert rows(R.read_trace_csv(spark, str(tmp_path / "tr.csv"), 2)) == [(0.0, 0, 1.0), (0.0, 1, 2.0), (0.1, 0, 0.5), (0.1, 1, 0.25)]


def test_second_write_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "a bigint, r double")
    assert R.write_missing(df, str(tmp_path / "c"), ["a"]) == 5
    assert R.write_missing(df, str(tmp_path / "c"), ["a"]) == 0


def test_plans_have_no_nested_loops(spark):
    from engram.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    for name in ("overlap_pixels", "lag_pairs", "join_spike_position", "centroid_distance", "nonvisited_drop", "match_forward"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = QUERIES["bin_floor"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan


def test_hub_removal_of_a_long_chain(spark):
    n = 40
    got = {r["node"] for r in H.dedup_hub(spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")).collect()}
    assert got == greedy_hub([(i, i + 1) for i in range(n)])


def test_speed_band_shows_units_without_a_band(spark):
    from engram.operators import filters
    df = spark.createDataFrame([("a", float(v)) for v in range(3)], "unit string, v double")
    kept = filters.speed_bandpass(df, ["unit"], "v", "adaptive", missing="keep").collect()
    assert len(kept) == 3 and all(r["upper_speed"] is None for r in kept)
    with pytest.raises(Exception, match="no speed band"):
        filters.speed_bandpass(df, ["unit"], "v", "adaptive").collect()


def test_eigenspectrum_is_that_of_the_covariance(spark):
    import numpy as np
    from engram.operators import decode as E
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "frame long, vec array<double>")
    share = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    share = share / share.sum()
    got = E.pca(df, "frame", "vec", 6)[0]
    assert np.allclose([r["explained"] for r in got.orderBy("component").collect()], share)
    c = np.cumsum(share)
    assert abs(E.auc_variance(got, [], "component", "explained").first()[0] - ((c[1:] + c[:-1]) / 2).sum() / 6) < 1e-9
