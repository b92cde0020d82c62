"""Recursive filters and detrending against the plain recursion, sample by sample."""

import math

import numpy as np
import pytest

from engram.functions import recursion as R
from engram.operators import signal as G


def digital(analog_top, analog_bottom):
    """Digital coefficients of analog polynomials in s (lowest power first)."""
    m = len(analog_bottom) - 1
    def expand(coef):
        out = np.zeros(m + 1)
        for k, c in enumerate(coef):
            term = np.array([1.0])
            for j in range(m):
                term = np.convolve(term, [1.0, -1.0] if j < k else [1.0, 1.0])
            out += c * term
        return out
    top, bottom = expand(analog_top), expand(analog_bottom)
    return top / bottom[0], bottom / bottom[0]


def low(order, cut, rate):
    w = math.tan(math.pi * cut / rate)
    bottom = {1: [w, 1], 2: [w * w, math.sqrt(2) * w, 1], 3: [w ** 3, 2 * w * w, 2 * w, 1]}[order]
    return digital([w ** order, *[0] * order], bottom)


def band(order, lo, hi, rate):
    wl, wh = math.tan(math.pi * lo / rate), math.tan(math.pi * hi / rate)
    b, q = wh - wl, wl * wh
    if order == 1:
        return digital([0, b, 0], [q, b, 1])
    return digital([0, 0, b * b, 0, 0], [q * q, math.sqrt(2) * b * q, 2 * q + b * b, math.sqrt(2) * b, 1])


def run(top, bottom, x):
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = sum(top[k] * x[n - k] for k in range(len(top)) if n >= k) - sum(bottom[k] * y[n - k] for k in range(1, len(bottom)) if n >= k)
    return y


def both_ways(top, bottom, x, pad):
    return run(top, bottom, run(top, bottom, np.r_[x, np.zeros(pad)])[::-1])[::-1][:len(x)]


CASES = [(R.low_pass(1, 1.0, 30.0), low(1, 1.0, 30.0)), (R.low_pass(2, 2.0, 30.0), low(2, 2.0, 30.0)), (R.low_pass(3, 3.0, 30.0), low(3, 3.0, 30.0)),
         (R.band_pass(1, 0.5, 2.0, 30.0, False), band(1, 0.5, 2.0, 30.0)), (R.band_pass(2, 500.0, 6000.0, 30000.0, True), band(2, 500.0, 6000.0, 30000.0)),
         (R.band_pass(1, 0.1, 14.0, 30.0, False), band(1, 0.1, 14.0, 30.0))]


@pytest.mark.parametrize("modes,plain", CASES)
def test_responses(modes, plain):
    one = np.zeros(400)
    one[0] = 1.0
    h = run(*plain, one)
    want = np.correlate(h, h, "full")[399:399 + 60] if modes.symmetric else h[:60]
    tail = 60 if modes.symmetric else 400
    got = [modes.response(n) for n in range(min(tail, 60))]
    assert np.allclose(got, want[:len(got)], atol=1e-10)
    assert modes.response(-3) == (modes.response(3) if modes.symmetric else 0.0)


def trace(spark, x, keys=("a", None)):
    return spark.createDataFrame([(k, i, None if v is None else float(v), f"n{i}") for k in keys for i, v in enumerate(x)], "k string, frame bigint, v double, note string")


@pytest.mark.parametrize("size", [7, 64, 4096])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_blocks_equal_the_recursion(spark, case, size):
    modes, plain = CASES[case]
    if case not in (0, 4) and size != 64:
        return
    x = np.random.default_rng(case).normal(size=300)
    got = R.recursive(trace(spark, x), ["k"], "frame", "v", modes, "y", size=size).orderBy("k", "frame").collect()
    want = both_ways(*plain, x, 900) if modes.symmetric else run(*plain, x)
    assert len(got) == 600 and got[5]["note"] == "n5"
    for half in (got[:300], got[300:]):
        assert np.allclose([r["y"] for r in half], want, atol=1e-9)


def test_slowest_low_pass_over_missing_blocks(spark):
    """0.0001 Hz at 30 Hz: nothing has died out over the whole trace; frames 500..1499 are absent."""
    x = np.random.default_rng(1).normal(size=3000) + 5
    here = np.r_[0:500, 1500:3000]
    df = spark.createDataFrame([("a", int(i), float(x[i])) for i in here] + [("a", 3000, None)], "k string, frame bigint, v double")
    got = {r["frame"]: r["low"] for r in R.recursive(df, ["k"], "frame", "v", R.low_pass(1, 0.0001, 30.0), "low", renormalise=True, size=128).collect()}
    w = math.tan(math.pi * 0.0001 / 30)
    pole = (1 - w) / (1 + w)
    # the two-sided response of the first order: h = g (delta + (1 + pole) pole^(n-1)), correlated with itself
    g = w / (1 + w)
    k0 = g * g * (1 + (1 + pole) ** 2 / (1 - pole ** 2))
    lag = np.abs(np.arange(3001)[:, None] - here[None, :])
    c = g * (1 + pole) / pole
    k = np.where(lag == 0, k0, c * (g + c * pole ** 2 / (1 - pole ** 2)) * pole ** lag)
    want = (k @ x[here]) / k.sum(axis=1)
    assert np.allclose([got[f] for f in (*here, 3000)], want[[*here, 3000]], rtol=1e-9)


def test_constant_stays_constant_and_nothing_stays_nothing(spark):
    df = trace(spark, [3.0] * 50, ("a",))
    assert {round(r["low"], 9) for r in G.lowpass(df, ["k"], "frame", "v", 0.01, 30.0).collect()} == {3.0}
    assert G.lowpass(df.limit(0), ["k"], "frame", "v", 0.01, 30.0).count() == 0
    gone = G.lowpass(trace(spark, [None, None], ("a",)), ["k"], "frame", "v", 0.01, 30.0).collect()
    assert len(gone) == 2 and all(r["low"] is None or math.isnan(r["low"]) for r in gone)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_detrend_equals_polyfit(spark, order):
    rng = np.random.default_rng(order)
    n = 900
    t = np.arange(n)
    x = 4 + 1e-3 * t - 2e-5 * t ** 2 + 1e-8 * t ** 3 + rng.normal(size=n)
    got = [r["flat"] for r in G.detrend(trace(spark, x, ("a",)), ["k"], "frame", "v", order, 0.1, 30.0).orderBy("frame").collect()]
    plain = low(order, 0.1, 30.0)
    smooth = both_ways(*plain, x, 4000) / both_ways(*plain, np.ones(n), 4000)
    assert np.allclose(got, x - np.polyval(np.polyfit(t, smooth, order), t), atol=1e-7)


def test_detrend_far_from_frame_zero_keeps_its_digits(spark):
    first = 10_000_000
    t = np.arange(300)
    x = 1 + 0.5 * t - 1e-3 * t ** 2 + 1e-6 * t ** 3
    df = spark.createDataFrame([("a", first + int(i), float(v)) for i, v in zip(t, x)] + [("b", 4, 2.0)], "k string, frame bigint, v double")
    got = {(r["k"], r["frame"]): r["flat"] for r in G.detrend(df, ["k"], "frame", "v", 3, 14.9, 30.0).collect()}
    assert max(abs(got["a", first + int(i)]) for i in t) < 0.05 and abs(got["b", 4]) < 1e-9
