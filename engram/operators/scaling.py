"""Per-cell and per-arena rescaling of traces, positions and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from engram.functions.exprs import col, ratio
from engram.functions.quantiles import exact_quantile


def dff(df: DataFrame, keys: list[str], value: str, out: str = "dff", one_photon: bool = False) -> DataFrame:
    """(F - f0) / f0 with f0 = |median(F)| per cell; one-photon data only subtract f0."""
    base = exact_quantile(df, keys, value, 0.5, "_f0").withColumn("_f0", F.abs("_f0"))
    moved = F.col(value) - F.col("_f0")
    return df.join(base, keys).withColumn(out, moved if one_photon else ratio(moved, "_f0")).drop("_f0")


def standardize(df: DataFrame, keys: list[str], value: str, out: str = "std") -> DataFrame:
    """Subtract the median, divide by the range."""
    mid = exact_quantile(df, keys, value, 0.5, "_m")
    span = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_r"))
    return (df.join(mid.join(span, keys), keys)
              .withColumn(out, ratio(F.col(value) - F.col("_m"), "_r")).drop("_m", "_r"))


def minmax_norm(df: DataFrame, keys: list[str], value: str, out: str = "norm") -> DataFrame:
    """(x - min) / (max - min) per cell; a constant cell keeps its values."""
    ext = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.col(value)).otherwise(
        ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return df.join(ext, keys).withColumn(out, scaled).drop("_lo", "_hi")


def _extent(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row with the extent of the tracking."""
    return F.broadcast(df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")))


def rescale_arena(df: DataFrame, x: str, y: str, arena: tuple[float, float]) -> DataFrame:
    """Min-max both axes to the size of the arena (adds ``xs``, ``ys``)."""
    return (df.crossJoin(_extent(df, x, y))
              .withColumn("xs", ratio(F.col(x) - F.col("_x0"), F.col("_x1") - F.col("_x0")) * arena[0])
              .withColumn("ys", ratio(F.col(y) - F.col("_y0"), F.col("_y1") - F.col("_y0")) * arena[1])
              .drop("_x0", "_x1", "_y0", "_y1"))


def px_to_cm(df: DataFrame, x: str, y: str, box_width: float) -> DataFrame:
    """Shift to the origin and apply the scale of the x axis to both axes."""
    scale = (F.col("_x1") - F.col("_x0")) / F.lit(box_width)
    return (df.crossJoin(_extent(df, x, y))
              .withColumn("xc", ratio(F.col(x) - F.col("_x0"), scale))
              .withColumn("yc", ratio(F.col(y) - F.col("_y0"), scale))
              .drop("_x0", "_x1", "_y0", "_y1"))


def upsample_int(maps: DataFrame, k: int, iy: str = "iy", ix: str = "ix") -> DataFrame:
    """Repeat each bin k x k times; an unvisited bin gives k x k unvisited bins."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    return (maps.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
                .withColumn(iy, F.col(iy) * k + F.col("_dy")).withColumn(ix, F.col(ix) * k + F.col("_dx"))
                .drop("_dy", "_dx"))


def circular_mask(bins: DataFrame, x, y, diameter: float, cx, cy) -> DataFrame:
    """Distance and angle (degrees) of each bin centre from the arena centre, and the in-circle test."""
    dx, dy = col(x) - col(cx), col(y) - col(cy)
    dist = F.sqrt(dx * dx + dy * dy)
    return (bins.withColumn("dist", dist).withColumn("angle", F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)))
                .withColumn("inside", F.col("dist") <= F.lit(diameter / 2)))
