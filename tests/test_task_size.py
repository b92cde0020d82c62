"""What a task holds must not grow with the table: keys are dealt to as many partitions as the rows ask for."""

import math

import pytest
from pyspark.sql import functions as F

from engram.functions import blocks as B
from engram.operators import maps as M, occupancy as O, sequences as Q, signal as G
from engram.plans import q_maps, q_sequences
from engram.sources import tables as S


def rows_of(df):
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(near, r)) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tiny(monkeypatch):
    """A function that lets tasks hold so many rows only."""
    return lambda rows: monkeypatch.setattr(B, "TASK_ROWS", rows)


def lineitem(spark, tmp_path, units=40, per=12):
    rows = [(u, float(u * 7 % 50 + i) if (u + i) % 9 else None, (i % 11) / 100.0, 100.0 * i + u, u * per + i, i % 4, i, f"1996-01-{1 + i % 6:02d} 00:00:00") for u in range(units) for i in range(per)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_discount double, l_extendedprice double, l_orderkey long, l_linenumber int, l_partkey long, d string")
    df.withColumn("l_shipdate", F.to_timestamp_ntz("d")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_dealt_whole_keys(spark):
    df = spark.createDataFrame([(k, i) for k in [*range(50), None] for i in range(10)], "k int, i int")
    got, short = B.dealt(df, "k", size=10)
    assert short and got.rdd.getNumPartitions() == 51
    per = got.groupBy("k", F.spark_partition_id().alias("p")).count().collect()
    assert len(per) == 51 and all(r["count"] == 10 for r in per)
    assert B.dealt(df, "k", size=9) == (df, False)      # one key would fill a task
    assert B.dealt(df, "k", size=1000) == (df, True)    # the configured partitions are enough


@pytest.mark.parametrize("name", ["egocentric_map", "coherence", "dlc_median_part", "dlc_short_segments"])
def test_queries_deal_by_rows(spark, tmp_path, tiny, name):
    """F27, F30, F34, F35"""
    from engram.plans.catalog import QUERIES
    d = lineitem(spark, tmp_path)
    want = rows_of(QUERIES[name](spark, d))
    tiny(12)
    got = QUERIES[name](spark, d)
    assert rows_of(got) == want and want
    assert "hashpartitioning(l_suppkey" in plan(got) or ", 40)" in plan(got)
    assert ", 40)" in plan(got) and "ENSURE_REQUIREMENTS" not in plan(got)      # 480 rows, 12 a task, and no other shuffle


def test_long_frames_keep_the_bracketed_median(spark, tmp_path, monkeypatch):
    d = lineitem(spark, tmp_path)
    want = rows_of(q_sequences.dlc_median_part(spark, d))
    monkeypatch.setattr(q_sequences, "PARTS", 1)
    assert rows_of(q_sequences.dlc_median_part(spark, d)) == want


@pytest.mark.parametrize("size", [4, 4096])
def test_densify_and_welch(spark, tiny, size):
    """blocks are dealt before they are unfolded, and welch shuffles no frame."""
    df = spark.createDataFrame([(c, f, float(c + f % 5)) for c in range(30) for f in range(c % 3, 17, 2)], "cell int, f long, v double")
    make = lambda: B.densify(df, ["cell"], "f", {"v": "v"}, size)
    dense, spectra = make(), G.welch(make(), ["cell"], "f", "v", 8, 30.0)
    want, freqs = rows_of(dense), rows_of(spectra)
    assert len(want) == 30 * 17
    tiny(17)
    assert rows_of(make()) == want
    got = G.welch(make(), ["cell"], "f", "v", 8, 30.0)
    assert rows_of(got) == freqs and freqs
    if size > 17:
        assert ", 30)" in plan(got) and "_seg#" not in "".join(x for x in plan(got).splitlines() if "Join" in x or "Exchange" in x)


def test_short_runs_are_those_of_blocks(spark):
    """without blocks, runs and running columns are the same."""
    rows = [(k, f, None if (f * (k + 3)) % 7 < 3 else float(f)) for k in range(4) for f in range(50)]
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (1, None, 1.0)], "k int, frame long, v double")
    bounds = lambda short: rows_of(B.run_bounds(df.filter("frame is not null"), ["k"], ["frame"], B.frame_block("frame", 8), F.col("v").isNotNull(), "frame", short))
    assert bounds(True) == bounds(False)
    ordered = lambda short: rows_of(B.sequence(df, ["k"], ["frame"], B.frame_block("frame", 8), number="n", lag={"a": "v"}, lead={"b": "v"}, cumsum={"c": "v"}, ffill={"d": "v"}, bfill={"e": "v"}, short=short))
    assert ordered(True) == ordered(False)


@pytest.mark.parametrize("meet", [8, 64, 100000])
def test_neighbours_meet_in_tiles(spark, monkeypatch, meet):
    """a state travels once per tile within reach, and compares in parts of bounded size."""
    import numpy as np
    from engram.operators import decode as E
    monkeypatch.setattr(E, "MEET", meet)
    monkeypatch.setattr(E, "PART", 7)
    monkeypatch.setattr(E, "ASKED", -1)
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(60, 6)), 40 + draw.normal(size=(40, 6)), np.zeros((5, 6)), np.full((20, 6), 1e3) + draw.normal(size=(20, 6)) * 1e-6])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "frame long, vec array<double>")
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, :6].sum(1)
    got = E.knn_sum(df, "frame", "vec", 6, slab_rows=9)
    assert "_ti" in plan(got) and np.allclose([r["knn"] for r in got.orderBy("frame").collect()], want, rtol=1e-9, atol=1e-9)


def test_grid_peaks_are_made_once(spark, tmp_path):
    """F32: the peaks of an autocorrelogram are read once, whatever is asked of them."""
    rows = [(u, dy, dx) for u in range(3) for dy, dx in ((0, 6), (0, 12), (5, 3), (5, -3), (-5, 3), (-5, -3), (0, -6 - u), (9, 1))] + [(9, 1, 1), (None, 0, 1)]
    spark.createDataFrame(rows, "unit long, dy int, dx int").write.parquet(f"{tmp_path}/peaks")
    got = M.grid_stats(spark.read.parquet(f"{tmp_path}/peaks"), ["unit"])
    assert plan(got).count("FileScan") == 1
    want = []
    for u in range(3):
        near = [(0, 6), (5, 3), (5, -3), (-5, 3), (-5, -3), (0, -6 - u), (9, 1)]      # (0, 12) lies behind (0, 6)
        six = sorted(sorted(near, key=lambda p: (math.hypot(*p), *p))[:6], key=lambda p: math.atan2(*p))[:3]
        turns = [math.degrees(math.atan2(*p)) % 60 for p in six]
        turns = [t - 60 if 60 - t < t else t for t in turns]
        mean = sum(turns) / 3
        want.append((u, sum(math.hypot(*p) for p in six) / 3, mean, math.sqrt(sum((t - mean) ** 2 for t in turns) / 3)))
    assert rows_of(got) == [tuple(round(v, 6) for v in r) for r in want]
