"""Null distributions and spectra against numpy, roll by roll."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import nulls as N, signal as G
from engram.plans import q_decode as Q
from engram.plans.catalog import QUERIES
from engram.sources import tables as S

SF = "/root/testdata/sf0.001"


def number(*ids):
    return int(hashlib.md5(":".join(map(str, ids)).encode()).hexdigest()[:8], 16)


def recording(spark):
    act = S.activity(spark, SF).select("cell_id", "frame", "f").toPandas()
    n = int(act.frame.max()) + 1
    return {c: np.bincount(g.frame, g.f, n) for c, g in act.groupby("cell_id")}, n


def test_draws_agree_in_both_forms(spark):
    df = spark.createDataFrame([("a", 3), ("a", None), (None, 7)], "s string, c int").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40))))
    got = {(r["s"], r["c"], r["k"]): r["u"] for r in df.select("s", "c", "k", N.draw(["s", "c"], "k", 5).alias("u")).collect()}
    for s, c in (("a", 3), ("a", None), (None, 7)):
        assert [got[s, c, k] for k in range(1, 41)] == N.drawn((s, c), 40, 5).tolist()
    assert len(set(got.values())) > 100


def test_place_tests_use_all_shuffles(spark):
    cells, n = recording(spark)
    pos = Q.positions(spark, SF).toPandas()
    pos["bin"] = pos.iy * 10 + pos.ix
    seconds = np.bincount(pos.bin, minlength=50)
    here, total = pos[pos.frame < n], seconds.sum()

    def si(f):
        per = np.bincount(here.bin, f[here.frame], 50)
        seen = (seconds > 0) & (per != 0)
        rate, mean = per[seen] / seconds[seen], per.sum() / total
        return (seconds[seen] / total * rate * np.log2(np.maximum(rate / mean, 1))).sum() / mean if mean else np.nan

    fifth, want, full = n // 5, {}, {}
    for c, f in cells.items():
        shifts = [0, *(fifth + number(0, c, k) % max(3 * fifth, 1) for k in range(1, 1001))]
        rolled = [si(np.roll(f, s)) for s in shifts]
        half = [si(np.where(np.arange(n) < n // 2, f, 0)), si(np.where(np.arange(n) < n // 2, 0, f))]
        for out, pool in ((full, rolled), (want, rolled + half)):
            pool = [x for x in pool if not np.isnan(x)]
            out[c] = (rolled[0] - np.mean(pool)) / np.std(pool)
    for name, z in (("si_zscore", full), ("place_cell_test", want)):
        got = {r["cell_id"]: r["z"] for r in QUERIES[name](spark, SF).collect()}
        assert got.keys() == z.keys() and all(abs(got[c] - z[c]) < 1e-4 for c in z), name
    assert {r["cell_id"] for r in QUERIES["place_cells"](spark, SF).collect()} == {c for c, x in full.items() if x > 1.5}


def test_information_of_sessions_of_unequal_length(spark):
    rng = np.random.default_rng(4)
    act, pos, want = [], [], {}
    for session, n in (("a", 90), ("b", 41), (None, 7)):
        place = rng.integers(-1, 4, n)
        pos += [(session, i, int(p)) for i, p in enumerate(place) if p >= 0]
        seconds = np.bincount(place[place >= 0], minlength=4).astype(float)
        for c in range(3):
            f = np.where(rng.random(n) < 0.4, rng.integers(1, 5, n), 0).astype(float) * (c < 2)
            act += [(session, c, i, float(v), n) for i, v in enumerate(f) if v or (c == 2 and i == 0)]
            def si(x):
                per = np.bincount(place[place >= 0], x[place >= 0], 4)
                with np.errstate(all="ignore"):
                    rate = np.nan_to_num(per / seconds)
                    mean = per.sum() / seconds.sum()
                    return (seconds / seconds.sum() * rate * np.log2(np.maximum(rate / mean, 1))).sum() / mean if mean else np.nan
            ids = [0, *([] if session is None else [session]), c]
            pool = [si(f)] + [si(np.roll(f, n // 5 + number(*ids, k) % max(3 * (n // 5), 1))) for k in range(1, 51)]
            known = [x for x in pool if not np.isnan(x)]
            want[session, c] = None if np.isnan(pool[0]) or np.std(known) <= 1e-12 else (pool[0] - np.mean(known)) / np.std(known)
    a = spark.createDataFrame(act, "s string, c int, frame int, v double, n int")
    p = spark.createDataFrame(pos, "s string, frame int, bin int")
    for tile in (64, 1):
        got = {(r["s"], r["c"]): r["z"] for r in N.information_null(a, p, ["s"], "c", "frame", "v", ["bin"], F.col("n"), 50, cells_per_task=tile).collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


@pytest.mark.parametrize("held", [1 << 22, 40])
def test_corr_zscore_of_recordings_of_unequal_length(spark, monkeypatch, held):
    monkeypatch.setattr(N, "HELD", held)
    rng = np.random.default_rng(7)
    rows, want, every = [], {}, {}
    for session, n in ((1, 24), (2, 17)):
        m = np.where(rng.random((5, n)) < 0.5, rng.random((5, n)), 0.0)
        m[4] = 0.7
        rows += [(session, f"c{c}", b, float(m[c, b]), n) for c in range(5) for b in range(n) if m[c, b]]
        z = lambda a, b, shifts: (lambda pool: None if np.std(pool) < 1e-9 else (pool[0] - np.mean(pool)) / np.std(pool))([m[a] @ np.roll(m[b], s) for s in shifts])
        for a in range(5):
            for b in range(a + 1, 5):
                want[session, f"c{a}", f"c{b}"] = z(a, b, [0, *(number(3, session, f"c{b}", k) % n for k in range(1, 101))])
                every[session, f"c{a}", f"c{b}"] = z(a, b, range(n))
    df = spark.createDataFrame(rows, "s int, cell string, bin bigint, v double, n int")
    for rolls, expect in ((100, want), (None, every)):
        got = {(r["s"], r["a"], r["b"]): r["z"] for r in N.corr_zscore(df, ["s"], "cell", "bin", "v", F.col("n"), rolls, seed=3).collect()}
        assert got.keys() == expect.keys()
        assert all((got[k] is None) == (expect[k] is None) and (got[k] is None or abs(got[k] - expect[k]) < 1e-6) for k in got), rolls
    assert N.corr_zscore(df.limit(0), ["s"], "cell", "bin", "v", F.col("n")).count() == 0


def test_corr_zscore_full_uses_every_roll(spark):
    cells, _ = recording(spark)
    days = {c: np.array([f[b * 24:b * 24 + 24].sum() for b in range(30)]) for c, f in cells.items()}
    got = {(r["a"], r["b"]): r["z"] for r in QUERIES["corr_zscore_full"](spark, SF).collect()}
    some = [p for p in got if got[p] is not None][:40]
    assert some
    for a, b in some:
        r = [np.corrcoef(days[a], np.roll(days[b], s))[0, 1] for s in range(30)]
        assert abs(got[a, b] - (r[0] - np.mean(r)) / np.std(r)) < 1e-4


def test_match_null_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for session, n in (("a", 300), (None, 45)):
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 12, n).astype(float)
        ask = [(float(rng.integers(0, 12)), float(rng.integers(0, 12))) if rng.random() < 0.6 else (None, None) for _ in range(n)]
        rows += [(session, i, float(x[i]), float(y[i]), *ask[i]) for i in range(n)]
        for k in range(1, 21):
            s = 30 + number(*([0] if session is None else [0, session]), k) % 60
            tx, ty = np.roll(x, s), np.roll(y, s)
            near = [min((tx[i:i + 5] - px) ** 2 + (ty[i:i + 5] - py) ** 2) for i, (px, py) in enumerate(ask) if px is not None]
            want[session, k] = (len(near), int(sum(v < 4 for v in near)))
    df = spark.createDataFrame(rows, "s string, frame bigint, x double, y double, px double, py double")
    for block in (1 << 14, 32):
        got = {(r["s"], r["shuffle"]): (r["total"], r["hits"]) for r in N.match_null(df, ["s"], "frame", "x", "y", "px", "py", 5, 2.0, 20, 30, 90, block=block).collect()}
        assert got == want


@pytest.mark.parametrize("whole,chunk", [(1 << 20, 1 << 16), (100, 64), (1, 1), (1, 1 << 10)])
def test_spectrum_of_any_length(spark, monkeypatch, whole, chunk):
    monkeypatch.setattr(G, "WHOLE", whole)
    monkeypatch.setattr(G, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    x = {c: rng.normal(size=n) for c, n in enumerate((720, 97, 1009, 1, 2, 64))}
    x[None] = np.where(rng.random(211) < 0.3, 0.0, rng.normal(size=211))
    x[None][-1] = 1.0
    df = spark.createDataFrame([(c, t, float(v)) for c, xs in x.items() for t, v in enumerate(xs) if v], "cell int, t int, v double")
    df = df.filter("cell IS NULL OR cell < 9")
    got = G.power_spectrum(df, ["cell"], "t", "v", 30.0).collect()
    for c, xs in x.items():
        mine = sorted((r["freq"], r["power"]) for r in got if r["cell"] == c)
        want = np.abs(np.fft.rfft(xs)) ** 2
        assert len(mine) == len(want) and np.allclose([p for _, p in mine], want, atol=1e-8) and np.allclose([f for f, _ in mine], np.fft.rfftfreq(len(xs), 1 / 30))


def test_long_prime_recording(spark, monkeypatch):
    monkeypatch.setattr(G, "WHOLE", 1 << 16)
    n = 65_537
    df = spark.range(n).select(F.lit(1).alias("c"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 - 0.5).alias("v"))
    x = np.array([r["v"] for r in df.orderBy("t").collect()])
    got = G.spectrum(df, ["c"], "t", "v").orderBy("k").toPandas()
    want = np.abs(np.fft.rfft(x)) ** 2
    assert got.k.tolist() == list(range(len(want))) and np.allclose(got.power, want, rtol=1e-8, atol=1e-6)
    plan = G.spectrum(df, ["c"], "t", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan


def test_cells_are_packed_before_they_are_copied(spark, monkeypatch):
    """Every bin of a cell went to 352 tiles and its rolls were drawn in each of them (F20, corr_zscore)."""
    df = spark.range(600).select((F.col("id") % 40).alias("cell"), F.floor(F.col("id") / 40).alias("bin"), (F.col("id") % 7 + 1).cast("double").alias("v"))
    whole = {(r["a"], r["b"]): r["z"] for r in N.corr_zscore(df, [], "cell", "bin", "v", 15, 50).collect()}
    monkeypatch.setattr(N, "HELD", 60)
    monkeypatch.setattr(N, "STEP", 45)
    monkeypatch.setattr(N, "BATCH", 10)
    out = N.corr_zscore(df, [], "cell", "bin", "v", 15, 50)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in text[text.index("explode("):]
    assert {(r["a"], r["b"]): r["z"] for r in out.collect()} == pytest.approx(whole) and len(whole) == 40 * 39 // 2


@pytest.mark.parametrize("shuffles", [50, 2])
def test_match_null_counts_every_roll_once(spark, shuffles):
    """500 rolls of 20 frames one by one took too long (F22); recordings too long for all rolls still go through the drawn ones."""
    rng = np.random.default_rng(2)
    n, reach = 61, 7
    x, y, px, py = rng.integers(0, 20, (4, n)).astype(float)
    asked = rng.random(n) < 0.7
    df = spark.createDataFrame([("s", f, float(x[f]), float(y[f]), float(px[f]) if asked[f] else None, float(py[f]) if asked[f] else None) for f in range(n)], "s string, f bigint, x double, y double, px double, py double")
    got = {r["shuffle"]: (r["total"], r["hits"]) for r in N.match_null(df, ["s"], "f", "x", "y", "px", "py", reach, 4.0, shuffles, 10, 50).collect()}
    want = {}
    for k in range(1, shuffles + 1):
        s = 10 + number(0, "s", k) % 40
        want[k] = (int(asked.sum()), sum(any((x[(f + j - s) % n] - px[f]) ** 2 + (y[(f + j - s) % n] - py[f]) ** 2 < 16 for j in range(min(reach, n - f))) for f in np.flatnonzero(asked)))
    assert got == want
    at = np.flatnonzero(asked)
    assert [N.rolled_hits(at, px[at], py[at], x, y, reach, 4.0)[(10 + number(0, "s", k) % 40) % n] for k in want] == [h for _, h in want.values()]


def test_multiplied_rows_are_not_shuffled(spark):
    rows = [(None if c == 3 else c, f, float((f or 0) % 5)) for c in range(4) for f in (0, 7, 7, 11, None)]
    act = spark.createDataFrame(rows, "cell_id bigint, frame bigint, f double")
    rolled = Q.digest(N.circ_shift(act, "cell_id", "frame", F.lit(50), 30), ["cell_id", "shuffle"], "frame")
    moved = Q.digest(N.shuffle_times(act, "cell_id", "frame", 5, 0, 50, 30), ["cell_id", "iteration"], "frame")
    for df, name, first in ((rolled, "shuffle", 0), (moved, "iteration", 1)):
        assert df._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0].count("Exchange") == 0
        assert {(r["cell_id"], r[name]) for r in df.collect()} == {(c, k) for c in (0, 1, 2, None) for k in range(first, 31)}
    for r in rolled.collect():
        s = 0 if r["shuffle"] == 0 else 10 + number(0, *([] if r["cell_id"] is None else [r["cell_id"]]), r["shuffle"]) % 30
        want = [(f + s) % 50 for f in (0, 7, 7, 11)]
        assert (r["n"], r["first"], r["last"], r["total"]) == (5, min(want), max(want), sum(want))


def test_every_roll_makes_pairs_in_tiles_without_a_join(spark, monkeypatch):
    """Two tables of all pairs were joined with each other and twice with the totals; the driver built their hash tables (corr_zscore_full)."""
    from engram.functions import pairs as X
    rng = np.random.default_rng(9)
    m = np.where(rng.random((9, 12)) < 0.5, rng.integers(1, 6, (9, 12)), 0).astype(float)
    m[2], m[5, 0], m[6, 0] = 3.0, 2.0, 4.0      # one constant cell
    rows = [("s", c, b, float(m[c, b])) for c in range(9) for b in range(12) if m[c, b]]
    df = spark.createDataFrame(rows + [("s", None, 0, 1.0), (None, 0, 0, 1.0), (None, 1, 1, 1.0)], "s string, cell bigint, bin bigint, v double")
    monkeypatch.setattr(X, "NARROW", 4)      # three tiles
    out = N.corr_zscore(df, ["s"], "cell", "bin", "v", 12, rolls=None)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]): r["z"] for r in out.collect()}
    assert got.keys() == {(a, b) for b in range(9) for a in range(b)}
    for (a, b), z in got.items():
        sums = np.array([m[a] @ np.roll(m[b], k) for k in range(12)])
        assert z is None if 2 in (a, b) else abs(z - (sums[0] - sums.mean()) / sums.std()) < 1e-9
