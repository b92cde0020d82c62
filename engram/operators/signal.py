"""Filters, smoothing and spectra of traces."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from engram.functions import kernels as K
from engram.functions.exprs import ratio, with_key_aggregates
from engram.functions.recursion import band_pass, low_pass, recursive


def lowpass(df: DataFrame, keys, frame, value, cut: float, rate: float, out: str = "low", order: int = 1) -> DataFrame:
    """Zero-phase Butterworth low-pass; at the ends the response is renormalised over the frames present."""
    return recursive(df, list(keys), frame, value, low_pass(order, cut, rate), out, renormalise=True)


def highpass(df: DataFrame, keys, frame, value, cut: float, rate: float, out: str = "high") -> DataFrame:
    """First-order low- and high-pass are power complementary: zero-phase high = x - low."""
    return lowpass(df, keys, frame, value, cut, rate, "_low").withColumn(out, F.col(value) - F.col("_low")).drop("_low")


def bandpass(df: DataFrame, keys, frame, value, low: float, high: float, rate: float, out: str = "band") -> DataFrame:
    """Causal first-order band-pass."""
    return recursive(df, list(keys), frame, value, band_pass(1, low, high, rate, False), out)


def ephys_bandpass(df: DataFrame, keys, frame, value, low: float, high: float, rate: float, out: str = "band") -> DataFrame:
    """Zero-phase second-order band-pass per channel."""
    return recursive(df, list(keys), frame, value, band_pass(2, low, high, rate, True), out)


def exp_smooth(df: DataFrame, keys, frame, value, length: int, tau: float, cut: float, rate: float, out: str = "smooth") -> DataFrame:
    """Exponential decay over ``length`` samples followed by a low-pass."""
    w = [math.exp(-k / tau) for k in range(length)]
    decayed = K.convolve(df, keys, frame, value, w[::-1], "_exp", first=-(length - 1))
    return lowpass(decayed, keys, frame, "_exp", cut, rate, out).drop("_exp")


def detrend(df: DataFrame, keys, frame, value, order: int, cut: float, rate: float, out: str = "flat") -> DataFrame:
    """Subtract the polynomial of ``order`` 1 to 3 that fits the low-passed trace best (low-pass of the same order).

    Sums go over Legendre polynomials of the frame scaled to -1..1, which are nearly orthogonal on any recording, so no power of a
    frame number is ever summed. A trace of too few frames for the order is fitted by the terms it can hold."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    keys = list(keys)
    u = (F.col(frame) - F.col("_mid")) / F.col("_half")
    basis = [F.lit(1.0), u, (3 * u * u - 1) / 2, (5 * u * u * u - 3 * u) / 2][:order + 1]
    low = with_key_aggregates(lowpass(df, keys, frame, value, cut, rate, "_low", order), keys, ((F.max(frame) + F.min(frame)) / 2).alias("_mid"),
                              F.greatest((F.max(frame) - F.min(frame)) / 2, F.lit(0.5)).alias("_half"))
    n = order + 1
    held = F.col("_low").isNotNull() & ~F.isnan("_low")
    sums = [F.sum(F.when(held, basis[i] * basis[j])).alias(f"_s{i}{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(F.when(held, basis[i] * F.col("_low"))).alias(f"_y{i}") for i in range(n)]
    fit = low.groupBy(*keys).agg(*sums)
    # elimination of the normal equations, one column of results per step so that no expression is written twice
    for k in range(n):
        pivot = F.col(f"_s{k}{k}")
        steps = {}
        for i in range(k + 1, n):
            f = F.when(F.abs(pivot) > 1e-9, F.col(f"_s{k}{i}") / pivot).otherwise(0.0)
            steps |= {f"_s{i}{j}": F.col(f"_s{i}{j}") - f * F.col(f"_s{k}{j}") for j in range(i, n)}
            steps[f"_y{i}"] = F.col(f"_y{i}") - f * F.col(f"_y{k}")
        fit = fit.withColumns(steps) if steps else fit
    for k in reversed(range(n)):
        rest = sum((F.col(f"_s{k}{j}") * F.col(f"_a{j}") for j in range(k + 1, n)), F.lit(0.0))
        fit = fit.withColumn(f"_a{k}", F.when(F.abs(F.col(f"_s{k}{k}")) > 1e-9, (F.col(f"_y{k}") - rest) / F.col(f"_s{k}{k}")).otherwise(0.0))
    curve = fit.select(*keys, *[f"_a{k}" for k in range(n)])
    trend = sum((F.col(f"_a{k}") * basis[k] for k in range(n)), F.lit(0.0))
    return low.join(curve, keys).withColumn(out, F.col(value) - trend).select(*df.columns, out)


def activity_layers(df: DataFrame, keys, frame, value, cut: float, trend: float, rate: float, order: int = 1, k: float = 1.0) -> DataFrame:
    """(keys, frame, raw, filtered, detrended, derivative, onphase, upphase, scaled): all layers of the activity file.

    filtered: low-pass at ``cut``; detrended: filtered less the polynomial of ``order`` through its low-pass at ``trend``; derivative: of detrended;
    onphase: 1 where detrended is at least ``k`` standard deviations; upphase: onphase while it rises; scaled: detrended on on-phases.
    """
    from engram.operators.sequences import derivative
    keys = list(keys)
    low = lowpass(df.select(*keys, frame, F.col(value).alias("raw")), keys, frame, "raw", cut, rate, "filtered")
    flat = derivative(detrend(low, keys, frame, "filtered", order, trend, rate, "detrended"), keys, frame, "detrended", "derivative")
    on = F.when(F.col("detrended") >= F.col("_sd") * k, 1).otherwise(0)
    return (with_key_aggregates(flat, keys, F.stddev_pop("detrended").alias("_sd")).withColumn("onphase", on)
            .withColumn("upphase", F.when((F.col("onphase") == 1) & (F.col("derivative") > 0), 1).otherwise(0))
            .withColumn("scaled", F.col("detrended") * F.col("onphase"))
            .select(*keys, frame, "raw", "filtered", "detrended", "derivative", "onphase", "upphase", "scaled"))


def notch(df: DataFrame, keys, frame, value, freq: float, rate: float, block: int, out: str = "clean") -> DataFrame:
    """Subtract the sine and cosine of the mains frequency fitted per block."""
    ph = F.col(frame) * F.lit(2 * math.pi * freq / rate)
    b = df.withColumn("_w", F.floor(F.col(frame) / block)).withColumn("_s", F.sin(ph)).withColumn("_c", F.cos(ph))
    fit = b.groupBy(*keys, "_w").agg(F.sum(F.col(value) * F.col("_s")).alias("_xs"), F.sum(F.col(value) * F.col("_c")).alias("_xc"),
                                     F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum(F.col("_c") * F.col("_c")).alias("_cc"),
                                     F.sum(F.col("_s") * F.col("_c")).alias("_sc"))
    det = F.col("_ss") * F.col("_cc") - F.col("_sc") * F.col("_sc")
    a = F.coalesce(ratio(F.col("_xs") * F.col("_cc") - F.col("_xc") * F.col("_sc"), det), F.lit(0.0))
    c = F.coalesce(ratio(F.col("_xc") * F.col("_ss") - F.col("_xs") * F.col("_sc"), det), F.lit(0.0))
    fit = fit.select(*keys, "_w", a.alias("_a"), c.alias("_k"))
    return (b.join(fit, [*keys, "_w"]).withColumn(out, F.col(value) - F.col("_a") * F.col("_s") - F.col("_k") * F.col("_c"))
             .drop("_w", "_s", "_c", "_a", "_k"))


def _fourier(df: DataFrame, keys, t: Column, value: Column, freqs: list[float]) -> DataFrame:
    """Sine and cosine sums for a short list of frequencies in one aggregation, one row per frequency."""
    aggs = []
    for i, f in enumerate(freqs):
        ph = t * F.lit(2 * math.pi * f)
        aggs += [F.sum(value * F.cos(ph)).alias(f"_c{i}"), F.sum(value * F.sin(ph)).alias(f"_s{i}")]
    rows = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(f)).alias("freq"), F.col(f"_c{i}").alias("c"), F.col(f"_s{i}").alias("s"))
                     for i, f in enumerate(freqs)])
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(rows))


WHOLE = 1 << 20        # frames of a recording that one task transforms at once
CHUNK = 1 << 16        # numbers that a task holds of a longer one


def spectrum(df: DataFrame, keys, frame, value, n: Column | None = None) -> DataFrame:
    """(keys, n, k, power): |DFT|^2 at the frequencies k / n, k = 0 .. n / 2, of a whole recording of any length.

    ``n`` is the number of frames (else the last frame and one); frames outside 0 .. n - 1 are left out and missing ones are 0. Recordings of
    up to WHOLE frames are transformed in one task, longer ones by a chirp transform in blocks (``_chirp``). Which of the two are in the
    plan is told by the least and the largest length.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(frame).cast("long").alias("_t"), F.col(value).cast("double").alias("_v"), *([] if n is None else [n.cast("long").alias("n")]))
    if n is None:
        rows = with_key_aggregates(rows, keys, (F.max("_t") + 1).alias("n"))
    rows = rows.filter((F.col("_t") >= 0) & (F.col("_t") < F.col("n")))
    least, most = rows.agg(F.min("n"), F.max("n")).first()
    head = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name in keys] + [T.StructField("n", T.LongType())]
    schema = T.StructType([*head, T.StructField("k", T.LongType()), T.StructField("power", T.DoubleType())])
    parts = []
    if most is None or least <= WHOLE:
        def whole(table: pa.Table) -> pa.Table:
            length = table["n"][0].as_py()
            x = np.zeros(length)
            np.add.at(x, table["_t"].to_numpy(), np.nan_to_num(table["_v"].to_numpy().astype(float)))
            y = np.fft.rfft(x)
            return _same(table, keys + ["n"], {"k": pa.array(np.arange(len(y))), "power": pa.array(y.real ** 2 + y.imag ** 2)})
        parts.append(rows.filter(F.col("n") <= WHOLE).groupBy(*keys, "n").applyInArrow(whole, schema))
    if most is not None and most > WHOLE:
        parts.append(_chirp(rows.filter(F.col("n") > WHOLE), keys, head, schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _same(table: pa.Table, keys: list[str], more: dict[str, pa.Array]) -> pa.Table:
    """A table of the columns ``more`` with the keys of a group."""
    size = len(next(iter(more.values())))
    return pa.table([*[pa.array([table[k][0].as_py()] * size, table.schema.field(k).type) for k in keys], *more.values()], names=[*keys, *more])


class _Grid:
    """Shape of the chirp transform of n frames: places r + a * q, r < a, q < b, of a circle of a * b >= 2 n."""

    def __init__(self, n: int, chunk: int):
        bits = (2 * n - 1).bit_length()
        self.n, self.a, self.b = n, 1 << bits // 2, 1 << bits - bits // 2
        self.rows, self.cols = max(1, chunk // self.b), max(1, chunk // self.a)

    def chirp(self, t: np.ndarray) -> np.ndarray:
        """exp(i pi t^2 / n), the square taken modulo 2 n so that it keeps its digits."""
        return np.exp(1j * np.pi * (t * t % (2 * self.n)) / self.n)

    def turns(self, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * (r * k % (self.a * self.b)) / (self.a * self.b))


def _chirp(rows: DataFrame, keys: list[str], head: list, schema: T.StructType) -> DataFrame:
    """DFT of any length as a convolution with a chirp: X[k] = c*[k] sum over t of (x[t] c*[t]) c[k - t], c[t] = exp(i pi t^2 / n).

    The convolution is circular over a power of two a * b and runs as Fourier transforms over b and over a places. Three shuffles move
    blocks of about CHUNK numbers: residues modulo a, then frequencies (where signal and chirp are multiplied and the way back
    begins), then residues again. No task holds more than some blocks, whatever the length.
    """
    own, chunk = keys + ["n"], CHUNK
    bits = F.length(F.bin(2 * F.col("n") - 1))                 # the same numbers as in _Grid
    a, b = F.pow(F.lit(2), F.floor(bits / 2)).cast("long"), F.pow(F.lit(2), bits - F.floor(bits / 2)).cast("long")
    held = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(chunk) / b))
    every = rows.select(*own).distinct().select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((a - 1) / held))).alias("_g"), F.lit(None).cast("long").alias("_t"), F.lit(None).cast("double").alias("_v"))
    dealt = rows.select(*own, F.floor((F.col("_t") % a) / held).alias("_g"), "_t", "_v").unionByName(every)
    block = T.StructType([*head, T.StructField("_g", T.LongType()), T.StructField("_c", T.LongType()), T.StructField("_z", T.BinaryType())])

    def blocks(table, to: str, at: str, mine: int, pieces: list[tuple[int, np.ndarray]]) -> pa.Table:
        return _same(table, own, {c: v for c, v in ((to, pa.array([k for k, _ in pieces], pa.int64())), (at, pa.array([mine] * len(pieces), pa.int64())),
                                                   ("_z", pa.array([np.ascontiguousarray(z).tobytes() for _, z in pieces], pa.binary())))}).select(block.names)

    def forward(table: pa.Table) -> pa.Table:
        g, mine = _Grid(table["n"][0].as_py(), chunk), table["_g"][0].as_py()
        r = np.arange(mine * g.rows, min((mine + 1) * g.rows, g.a))
        x = np.zeros((len(r), g.b), complex)
        real = table.filter(pc.is_valid(table["_t"]))
        t = real["_t"].to_numpy().astype(np.int64)
        np.add.at(x, (t % g.a - r[0], t // g.a), np.nan_to_num(real["_v"].to_numpy().astype(float)) * g.chirp(t).conj())
        m = r[:, None] + g.a * np.arange(g.b)[None, :]
        back = np.minimum(m, g.a * g.b - m)
        chirp = np.where(back < g.n, g.chirp(back), 0)
        k = np.arange(g.b)
        z = np.fft.fft(np.stack([x, chirp]), axis=2) * g.turns(r[:, None], k[None, :])
        return blocks(table, "_c", "_g", mine, [(c // g.cols, z[:, :, c:c + g.cols]) for c in range(0, g.b, g.cols)])

    def across(table: pa.Table) -> pa.Table:
        g, mine = _Grid(table["n"][0].as_py(), chunk), table["_c"][0].as_py()
        k = np.arange(mine * g.cols, min((mine + 1) * g.cols, g.b))
        z = np.empty((2, g.a, len(k)), complex)
        for at, raw in zip(table["_g"].to_pylist(), table["_z"].to_pylist()):
            z[:, at * g.rows:(at + 1) * g.rows] = np.frombuffer(raw, complex).reshape(2, -1, len(k))
        z = np.fft.fft(z, axis=1)
        y = np.fft.ifft(z[0] * z[1], axis=0) * g.turns(np.arange(g.a)[:, None], k[None, :]).conj()
        return blocks(table, "_g", "_c", mine, [(r // g.rows, y[r:r + g.rows]) for r in range(0, g.a, g.rows)])

    def back(table: pa.Table) -> pa.Table:
        g, mine = _Grid(table["n"][0].as_py(), chunk), table["_g"][0].as_py()
        r = np.arange(mine * g.rows, min((mine + 1) * g.rows, g.a))
        y = np.empty((len(r), g.b), complex)
        for at, raw in zip(table["_c"].to_pylist(), table["_z"].to_pylist()):
            y[:, at * g.cols:(at + 1) * g.cols] = np.frombuffer(raw, complex).reshape(len(r), -1)
        k = r[:, None] + g.a * np.arange(g.b)[None, :]
        keep = k <= g.n // 2
        power = np.abs(np.fft.ifft(y, axis=1)[keep]) ** 2          # the last chirp only turns the phase
        return _same(table, own, {"k": pa.array(k[keep]), "power": pa.array(power)})

    one = dealt.groupBy(*own, "_g").applyInArrow(forward, block)
    two = one.groupBy(*own, "_c").applyInArrow(across, block)
    return two.groupBy(*own, "_g").applyInArrow(back, schema)


def power_spectrum(df: DataFrame, keys, frame, value, rate: float) -> DataFrame:
    """|DFT|^2 of a whole recording of any length at all its frequencies, 0 up to half the rate. Missing frames are 0."""
    got = spectrum(df, keys, frame, value)
    return got.select(*keys, (F.col("k") * F.lit(float(rate)) / F.col("n")).alias("freq"), "power")


def welch(df: DataFrame, keys, frame, value, segment: int, rate: float) -> DataFrame:
    """Amplitude density: Hann windows of ``segment`` frames with half overlap, means removed; all segment // 2 + 1 one-sided bins."""
    half = segment // 2
    ext = df.groupBy(*keys).agg((F.max(frame) + 1).alias("_n"))
    q = F.floor(F.col(frame) / half)
    seg = (df.join(ext, keys).withColumn("_seg", F.explode(F.array(q - 1, q)))
             .filter((F.col("_seg") >= 0) & (F.col("_seg") * half + segment <= F.col("_n"))))
    seg = seg.withColumn("_m", F.avg(value).over(W.partitionBy(*keys, "_seg")))      # a segment is short; a join would shuffle every frame
    k = F.col(frame) - F.col("_seg") * half
    win = 0.5 - 0.5 * F.cos(k * F.lit(2 * math.pi / segment))
    x = (F.col(value) - F.col("_m")) * win
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    scale = 2.0 / (rate * float((hann ** 2).sum()))
    freqs = [i * rate / segment for i in range(half + 1)]
    parts = _fourier(seg, [*keys, "_seg"], k / F.lit(float(rate)), x, freqs)
    p = (F.col("c") * F.col("c") + F.col("s") * F.col("s")) * F.lit(scale) * F.when(F.col("k").isin(*([0, half] if segment % 2 == 0 else [0])), 0.5).otherwise(1.0)
    return parts.groupBy(*keys, "freq").agg(F.sqrt(F.avg(p)).alias("density"))


def gauss_smooth_1d(df: DataFrame, keys, pos: str, value: str, sigma: float, n: int, out: str, circular: bool = False) -> DataFrame:
    """Gaussian along one bounded axis of a sparse map.

    Every bin sends its weighted value to its neighbours; positions beyond an end fold back
    (mirror padding) or wrap.  Only bins that receive something are returned.
    """
    w = K.gaussian(sigma)
    rad = len(w) // 2
    table = F.array(*[F.struct(F.lit(k - rad).alias("d"), F.lit(v).alias("w")) for k, v in enumerate(w)])
    sent = df.withColumn("_k", F.explode(table)).withColumn("_u", F.col(pos) + F.col("_k.d"))
    if circular:
        to = F.pmod("_u", F.lit(n))
    else:
        m = F.pmod("_u", F.lit(2 * n))
        to = F.when(m < n, m).otherwise(2 * n - 1 - m)
    return (sent.withColumn("_to", to.cast("int")).groupBy(*keys, F.col("_to").alias(pos))
                .agg(F.sum(F.col(value) * F.col("_k.w")).alias(out)))


def gauss_smooth(maps: DataFrame, keys, value: str, sigma: float, shape: tuple[int, int], out: str = "smooth",
                 circular: bool = False) -> DataFrame:
    """2-D Gaussian of a map as two 1-D passes; unvisited bins count as 0 and stay unvisited."""
    one = gauss_smooth_1d(maps.select(*keys, "iy", "ix", value), [*keys, "iy"], "ix", value, sigma, shape[1], "_a", circular)
    two = gauss_smooth_1d(one, [*keys, "ix"], "iy", "_a", sigma, shape[0], out, circular)
    return maps.join(two, [*keys, "iy", "ix"])
