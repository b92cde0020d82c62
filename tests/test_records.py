"""Layered activity files, unordered streams, interval counts and session pairs."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import joins as J, pairs as P, signal as G, speed as V
from engram.sources import files as R
from engram.streaming import events as E


def test_layers_are_written_once_and_replaced_when_outdated(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(s, c, i, float(v)) for s in (1, 2, 3) for c in (0, 1) for i, v in enumerate(rng.random(40))] + [(None, 9, 0, 1.0)]
    traces = spark.createDataFrame(rows, "session int, cell int, frame bigint, f double")
    calls = []

    def layers(t):
        calls.append(sorted(r["session"] for r in t.select("session").distinct().collect()))
        return G.activity_layers(t, ["session", "cell"], "frame", "f", 2.0, 0.5, 30.0)

    path = str(tmp_path)
    write = lambda t, params="a": R.write_layers(t, path, "session", layers, params)
    assert write(traces.filter("session = 1")) == 80 and write(traces) == 160 and write(traces) == 0
    assert calls == [[1], [2, 3]]
    got = spark.read.parquet(f"{path}/layers")
    assert set(got.columns) == {"session", "cell", "frame", "raw", "filtered", "detrended", "derivative", "onphase", "upphase", "scaled"}
    assert got.count() == 240 and got.filter("session = 2 AND cell = 1").count() == 40
    assert got.filter("upphase = 1 AND onphase = 0").count() == 0 and got.filter("scaled <> detrended * onphase").count() == 0
    assert write(traces.filter("session = 2"), "b") == 80 and spark.read.parquet(f"{path}/layers").count() == 240
    assert write(traces, "b") == 160 and write(traces, "b") == 0
    # a folder without an entry in the manifest is a broken write: it is replaced as a whole
    spark.read.parquet(f"{path}/layers").filter("session = 3").limit(5).withColumn("session", F.lit(4)).write.mode("append").partitionBy("session").parquet(f"{path}/layers")
    four = traces.filter("session = 3").withColumn("session", F.lit(4))
    assert write(four, "b") == 80 and spark.read.parquet(f"{path}/layers").filter("session = 4").count() == 80


def plain_runs(rows, threshold):
    """Closed runs of (key, at, id, value) rows."""
    out = []
    for k, own in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        run = []
        for _, at, _, v in own:
            if v >= threshold:
                run.append((at, v))
            elif run:
                out.append((k, run[0][0], run[-1][0], len(run), max(x for _, x in run)))
                run = []
    return sorted(out)


@pytest.mark.parametrize("files", [1, 6])
def test_unordered_files_give_the_batch_answer(spark, tmp_path, files):
    rng = np.random.default_rng(3)
    zero = dt.datetime(2024, 1, 1)
    rows = [(int(rng.integers(0, 4)), zero + dt.timedelta(seconds=int(s), microseconds=int(rng.integers(0, 3))), i, float(rng.integers(0, 100))) for i, s in enumerate(rng.integers(0, 3600, 500))]
    # the next file moves the watermark over everything, one more makes a trigger that knows it, and then a row comes too late
    end = [(k, zero + dt.timedelta(days=2), 1000 + k, 0.0) for k in range(4)]
    schema = "user_id long, ts timestamp, event_id long, value double"
    order = rng.permutation(len(rows))
    for n, part in enumerate(np.array_split(order, files)):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    more = [(k, zero + dt.timedelta(days=2, seconds=1), 2000 + k, 0.0) for k in range(4)]
    late = [(0, zero, 5000, 99.0)]
    for n, extra in enumerate((end, more, late)):
        spark.createDataFrame(extra, schema).coalesce(1).write.parquet(f"{tmp_path}/in/g{n}")
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("at", F.col("ts"))
    got = E.drain(E.stream_threshold_events(read(), "user_id", 60.0, "1 day"), f"{tmp_path}/out").collect()
    assert sorted((r["user_id"], r["start"], r["last"], r["events"], r["peak"]) for r in got) == plain_runs(rows, 60.0)


def test_interval_counts(spark):
    rng = np.random.default_rng(4)
    spikes = [(s, int(u), int(t)) for s in ("a", "b") for u, t in zip(rng.integers(0, 3, 120), rng.integers(0, 200, 120))] + [("a", 7, 50)] * 40
    frames = sorted({(s, int(t), float(x)) for s in ("a", "b") for t, x in zip(rng.integers(0, 230, 40), rng.integers(0, 2, 40))})
    s = spark.createDataFrame(spikes, "rec string, unit int, t bigint")
    f = spark.createDataFrame(frames, "rec string, at bigint, x double")
    for width in (10, 60):
        want = {}
        for rec, at, x in frames:
            for r, u, t in spikes:
                if r == rec and at - width < t <= at:
                    want[rec, u, at, x] = want.get((rec, u, at, x), 0) + 1
        got = J.join_spike_position(s, f, ["rec"], "unit", "t", "at", width).collect()
        assert {(r["rec"], r["unit"], r["at"], r["x"]): r["spikes"] for r in got} == want and len(got) == len(want)
    assert J.join_spike_position(s, f.limit(0), ["rec"], "unit", "t", "at", 10).count() == 0


def test_spike_rate_counts_per_recording(spark):
    frames = spark.createDataFrame([("a", 10 * i, i) for i in range(6)] + [("b", 7 * i, i) for i in range(3)], "rec string, t bigint, frame bigint")
    spikes = [("a", 1, 0), ("a", 1, 9), ("a", 1, 10), ("a", 2, 60), ("a", 2, 61), ("a", 2, -1), ("b", 1, 13), ("b", 1, 13)]
    s = spark.createDataFrame(spikes, "rec string, unit int, t bigint")
    got = {(r["rec"], r["unit"], r["frame"]): r["rate"] for r in V.spike_rate(s, frames, ["rec"], "unit", "t", "frame", F.floor(F.col("t") / 16).cast("long"), 10, 2.0).collect()}
    want = {(r, u, f): 0.0 for r, u, n in (("a", 1, 6), ("a", 2, 6), ("b", 1, 3)) for f in range(n)}
    want |= {("a", 1, 0): 4.0, ("a", 1, 1): 2.0, ("a", 2, 5): 2.0, ("b", 1, 1): 4.0}
    assert got == want


def test_session_pairs(spark):
    rng = np.random.default_rng(6)
    maps = {(c, s): np.round(rng.random(20), 3) for c in range(3) for s in (2, 5, 9)}
    maps[1, 9] = np.roll(maps[1, 2], -4) + 0.0
    maps[2, 5] = np.full(20, 2.0)
    df = spark.createDataFrame([(c, s, b, float(v)) for (c, s), m in maps.items() for b, v in enumerate(m)] + [(0, 2, 25, 9.0), (None, 2, 1, 1.0), (0, None, 1, 1.0)], "cell int, s int, b int, v double")
    got = {(r["cell"], r["first"], r["second"]): r for r in P.session_pair_corr(df, "cell", "s", "b", "v", 20, alpha=1.1, r_min=-1.0, offset=3).collect()}
    want = [(c, a, b) for c in range(3) for a, b in itertools.combinations((2, 5, 9), 2) if (c, a) != (2, 5) and (c, b) != (2, 5)]
    assert sorted(got) == sorted(want)
    for c, a, b in want:
        x, y, r = maps[c, a], maps[c, b], got[c, a, b]
        assert abs(r["r"] - np.corrcoef(x[3:], y[3:])[0, 1]) < 1e-9 and 0 <= r["p"] <= 1
        assert (r["peak_first"], r["peak_second"]) == (int(np.argmax(x[3:])) + 3, int(np.argmax(y[3:])) + 3) and r["shift"] == r["peak_first"] - r["peak_second"]
        rolls = [np.corrcoef(x, np.roll(y, s))[0, 1] for s in range(20)]
        assert abs(r["best_r"] - max(rolls)) < 1e-9 and abs(rolls[r["best_shift"]] - max(rolls)) < 1e-9
    assert got[1, 2, 9]["best_shift"] == 4 and got[1, 2, 9]["best_r"] > 0.999
