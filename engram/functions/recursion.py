"""Recursive (infinite response) filters as scans of affine state maps.

A Butterworth filter is a sum of one-pole recursions: behind the direct term its response is sum over j of c_j * pole_j^n. A one-pole recursion over
a block is the affine map s -> pole^length * s + v, where v is what the block adds to a zero state. So each trace is cut in blocks,
one aggregation gives v of every block, the maps are composed along the trace (one row per block), and each block is then filtered once
from the state that reaches it. No block reads its neighbours, whatever the cut-off, and nothing is truncated.

Zero-phase filtering (forward and backward over a trace that is 0 beyond its ends) is the same with a symmetric response: the causal
sum over what came before plus the mirrored sum over what comes after. Poles and gains follow in closed form from the cut-offs.
"""

from __future__ import annotations

import cmath
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from engram.functions.blocks import BLOCK_FRAMES, frame_block


@dataclass(frozen=True)
class Modes:
    """response[0] = direct, response[n] = sum of Re(gain * pole^|n|) for n > 0, and for n < 0 if symmetric."""
    direct: float
    poles: tuple[complex, ...]
    gains: tuple[complex, ...]
    symmetric: bool

    def response(self, n: int) -> float:
        return self.direct if n == 0 else sum((g * p ** abs(n)).real for p, g in zip(self.poles, self.gains)) if n > 0 or self.symmetric else 0.0


def _modes(analog: list[complex], gain: float, plus: int, minus: int, symmetric: bool) -> Modes:
    """From the poles of the bilinear variable s = (1 - w) / (1 + w), w being a delay by one frame, and gain * (1 + w)^plus * (1 - w)^minus.

    Poles near 1 keep their digits: pole - 1 = 2 s / (1 - s), and differences of poles come from differences of s."""
    off = [2 * s / (1 - s) for s in analog]
    top = lambda w: gain * (1 + w) ** plus * (1 - w) ** minus
    keep, gains, at_zero = [], [], gain ** 2 if symmetric else gain
    for j, s in enumerate(analog):
        pole = 1 + off[j]
        apart = math.prod([2 * (s - t) / ((1 - s) * (1 - t)) / pole for i, t in enumerate(analog) if i != j], start=1)
        c = top(1 / pole) / apart
        if symmetric:
            there = top(pole) / math.prod([-(off[i] + off[j] + off[i] * off[j]) for i in range(len(analog))], start=1)
            at_zero += (c * (there - gain)).real
            c *= there
        if abs(s.imag) < 1e-13 * abs(s):
            keep.append(complex(pole.real))
            gains.append(complex(c.real))
        elif s.imag > 0:                          # its conjugate adds the same real part
            keep.append(pole)
            gains.append(2 * c)
    return Modes(at_zero, tuple(keep), tuple(gains), symmetric)


def _prototype(order: int) -> list[complex]:
    return [cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]


def low_pass(order: int, cut: float, rate: float, symmetric: bool = True) -> Modes:
    """Butterworth low-pass."""
    w = math.tan(math.pi * cut / rate)
    analog = [w * p for p in _prototype(order)]
    return _modes(analog, (w ** order / math.prod([1 - s for s in analog], start=1)).real, order, 0, symmetric)


def band_pass(order: int, low: float, high: float, rate: float, symmetric: bool) -> Modes:
    """Butterworth band-pass made of a prototype of ``order`` poles."""
    wl, wh = math.tan(math.pi * low / rate), math.tan(math.pi * high / rate)
    width, middle = wh - wl, wl * wh
    analog = []
    for p in _prototype(order):
        root = cmath.sqrt((p * width) ** 2 - 4 * middle)
        analog += [(p * width + root) / 2, (p * width - root) / 2]
    return _modes(analog, (width ** order / math.prod([1 - s for s in analog], start=1)).real, order, order, symmetric)


def one_pole(x: np.ndarray, pole: complex, state: complex) -> np.ndarray:
    """out[n] = state * pole^n + sum over m < n of pole^(n - m) * x[m]: rows of a square at once, then carries from row to row."""
    n = len(x)
    side = max(1, math.isqrt(n - 1) + 1)
    rows = -(-n // side)
    grid = np.zeros(rows * side)
    grid[:n] = x
    grid = grid.reshape(rows, side)
    p = pole.real if pole.imag == 0 else pole
    power = p ** np.arange(side + 1)
    lag = np.arange(side)[:, None] - np.arange(side)[None, :]
    inside = grid @ np.where(lag > 0, power[np.maximum(lag, 0)], 0).T
    add = grid @ power[side:0:-1]
    carry = np.empty(rows, complex)
    for r in range(rows):
        carry[r] = state
        state = state * power[side] + add[r]
    return (inside + carry[:, None] * power[None, :side]).reshape(-1)[:n]


def recursive(df: DataFrame, keys: list[str], frame: str, value: str, modes: Modes, out: str, *, renormalise: bool = False, size: int = BLOCK_FRAMES) -> DataFrame:
    """``out``: the filtered value; absent frames and values that are null or not finite count as 0.

    ``renormalise`` divides by the response over the frames that hold a value, which keeps a constant trace constant up to its ends.
    Frames name the rows of a key apart; keys may be null. The rows are shuffled once; besides them one row per block moves.
    """
    channels = ["_x", "_h"] if renormalise else ["_x"]
    sides = ["f", "b"] if modes.symmetric else ["f"]
    rows = df.withColumn("_b", frame_block(frame, size))
    x = F.col(value).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    src = {"_x": F.when(ok, x).otherwise(0.0), "_h": F.when(ok, 1.0).otherwise(0.0)}
    at = F.col(frame) - F.col("_b") * size
    steps = {"f": F.lit(size) - at, "b": at + 1}
    sums = []
    for c in channels:
        for p in modes.poles:
            r, turn = abs(p), cmath.phase(p)
            for side in sides:
                grown = F.pow(F.lit(r), steps[side]) * src[c]
                sums += [F.sum(grown * F.cos(steps[side] * turn)), F.sum(grown * F.sin(steps[side] * turn)) if turn else F.lit(0.0)]
    blocks = rows.groupBy(*keys, "_b").agg(F.array(*sums).alias("_v"))
    shape = (len(channels), len(modes.poles), len(sides))
    poles = np.array(modes.poles)
    states = T.StructType([*[df.schema[k] for k in keys], T.StructField("_b", T.LongType()), T.StructField("_in", T.ArrayType(T.DoubleType()))])

    def compose(table: pa.Table) -> pa.Table:
        """States that reach each block of a key, from the left and from the right."""
        order = np.argsort(table["_b"].to_numpy())
        table = table.take(pa.array(order))
        b = table["_b"].to_numpy()
        flat = table["_v"].combine_chunks().flatten().to_numpy().reshape(len(b), *shape, 2)
        v = flat[..., 0] + 1j * flat[..., 1]
        over = poles ** size
        got = np.empty_like(v)
        for k, way in enumerate([range(len(b)), range(len(b) - 1, -1, -1)][:len(sides)]):
            state, last = np.zeros(shape[:2], complex), None
            for i in way:
                if last is not None:
                    state = state * over ** (abs(int(b[i]) - int(b[last])) - 1)
                got[i, :, :, k] = state
                state, last = state * over + v[i, :, :, k], i
        parts = np.stack([got.real, got.imag], -1).reshape(len(b), -1)
        return pa.table([*[table[c] for c in keys], pa.array(b), pa.array(list(parts), pa.list_(pa.float64()))], names=states.names)

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    names = schema.names

    def block(rows: pa.Table, state: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.append_column(out, pa.array([], pa.float64())).select(names)
        flat = np.array(state["_in"][0].as_py()).reshape(*shape, 2)
        start = flat[..., 0] + 1j * flat[..., 1]
        at = (rows[frame].to_numpy() - rows["_b"][0].as_py() * size).astype(int)
        v = np.array(rows[value].to_numpy(), dtype=float)
        ok = np.isfinite(v)
        made = []
        for c in range(shape[0]):
            x = np.zeros(size)
            x[at[ok]] = v[ok] if c == 0 else 1.0
            y = modes.direct * x
            for j, (p, g) in enumerate(zip(modes.poles, modes.gains)):
                y += (g * one_pole(x, p, start[c, j, 0])).real
                if modes.symmetric:
                    y += (g * one_pole(x[::-1], p, start[c, j, 1])).real[::-1]
            made.append(y[at])
        y = made[0]
        if renormalise:
            y = np.where(np.abs(made[1]) > 1e-12, y / np.where(made[1] == 0, 1, made[1]), np.nan)
        return rows.append_column(out, pa.array(y)).select(names)

    reach = blocks.groupBy(*keys).applyInArrow(compose, states)
    return rows.groupBy(*keys, "_b").cogroup(reach.groupBy(*keys, "_b")).applyInArrow(block, schema)
