"""Scalar column expressions: everything here stays inside whole-stage codegen."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0, so that equal results compare equal."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, NULL where b is zero (also outside ANSI mode)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def pearson_from_sums(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson r from moment sums; NULL for a constant side."""
    n, sx, sy, sxx, syy, sxy = (col(c).cast("double") for c in (n, sx, sy, sxx, syy, sxy))
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    tiny = F.lit(1e-12)
    ok = (vx > tiny * n * sxx) & (vy > tiny * n * syy)
    return F.when(ok, ratio(n * sxy - sx * sy, F.sqrt(F.abs(vx)) * F.sqrt(F.abs(vy))))


def pearson_agg(x, y, weight_valid: Column | None = None) -> Column:
    """Pearson r as one aggregate expression over rows where both sides are present."""
    ok = col(x).isNotNull() & col(y).isNotNull()
    if weight_valid is not None:
        ok = ok & weight_valid
    x, y = F.when(ok, col(x).cast("double")), F.when(ok, col(y).cast("double"))
    return F.when((F.stddev_pop(x) > 1e-9) & (F.stddev_pop(y) > 1e-9),
                  F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def cart2pol(x, y) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    return F.sqrt(x * x + y * y), F.atan2(y, x)


def pol2cart(rho, phi) -> tuple[Column, Column]:
    return col(rho) * F.cos(col(phi)), col(rho) * F.sin(col(phi))


def wheel_xy(clicks, per_turn: int = 500, radius: float = 1.0) -> tuple[Column, Column]:
    """Position on the wheel rim; the angle is in radians."""
    phi = F.pmod(col(clicks), F.lit(per_turn)) * F.lit(2 * math.pi / per_turn)
    return pol2cart(F.lit(radius), phi)


def point_on_circle(angle, radius: float = 100.0) -> tuple[Column, Column]:
    return pol2cart(F.lit(radius), angle)


def bin_floor(v, width) -> Column:
    return F.floor(col(v) / F.lit(width)).cast("long")


def grid_partition(x, y, box: float, size: float) -> Column:
    """Square id, numbered x-major; rows outside the box keep id 0."""
    n = math.ceil(box / size)
    x, y = col(x), col(y)
    inside = (x >= 0) & (x < box) & (y >= 0) & (y < box)
    return F.when(inside, F.floor(x / size) * n + F.floor(y / size)).otherwise(0).cast("long")


def partition_center(square, box: float, size: float) -> tuple[Column, Column]:
    n = math.ceil(box / size)
    q = col(square)
    return (F.floor(q / n) + 0.5) * size, (F.pmod(q, F.lit(n)) + 0.5) * size


def nbins(length, width) -> Column:
    return F.ceil(col(length) / F.lit(width)).cast("long")


def euclid(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def signed_angle(ux, uy, vx, vy) -> Column:
    """Angle from u to v in (-pi, pi]."""
    ux, uy, vx, vy = (col(c) for c in (ux, uy, vx, vy))
    return F.atan2(ux * vy - uy * vx + F.lit(0.0), ux * vx + uy * vy + F.lit(0.0))


def mirror_shift(angle, period: float = 360.0) -> Column:
    """Negative peak shifts are moved half a turn on."""
    a = col(angle)
    return F.when(a < 0, F.pmod(a + F.lit(period / 2), F.lit(period))).otherwise(a)


def decibel(power) -> Column:
    return F.when(col(power) > 0, 20 * F.log10(col(power)))


def histogram_bin(v, lo: float, width: float, count: int) -> Column:
    """Index on fixed edges; the top edge belongs to the last bin, values outside give NULL."""
    v = col(v)
    top = lo + width * count
    raw = F.floor(F.round((v - F.lit(lo)) / F.lit(width), 9))
    return F.when((v >= lo) & (v <= top), F.least(raw, F.lit(count - 1))).cast("int")


def circular_shift(frame, shift, n) -> Column:
    return F.pmod(col(frame) + col(shift), col(n))


def with_key_aggregates(df, keys: list[str], *aggregates: Column):
    """The rows of ``df`` with aggregates of their key; a null key is a key like any other."""
    own = [f"__key{i}" for i in range(len(keys))]
    per = df.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(*aggregates)
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)], F.lit(True))
    return df.join(per if keys else F.broadcast(per), on).drop(*own)
