"""Occupancy and histograms over position, angle and speed.

A map is a long table (keys, iy, ix, value) that holds visited bins only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engram.functions.blocks import dealt, sequence
from engram.functions.ranks import numbered
from engram.functions.exprs import col, histogram_bin, ratio


def frame_duration(df: DataFrame, keys: list[str], t: str, block: Column, how: str = "min") -> DataFrame:
    """Smallest or mean time step per key."""
    steps = sequence(df, keys, [t], block, lag={"_before": t}).withColumn("_dt", F.col(t) - F.col("_before"))
    pick = F.min("_dt") if how == "min" else F.avg("_dt")
    return steps.groupBy(*keys).agg(pick.alias("dt"))


def place_occupancy(df: DataFrame, keys: list[str], ix: Column, iy: Column, durations: DataFrame,
                    min_seconds: float = 0.001) -> DataFrame:
    """Seconds per visited bin."""
    counts = df.groupBy(*keys, iy.alias("iy"), ix.alias("ix")).agg(F.count(F.lit(1)).alias("_c"))
    return (counts.join(durations, keys).withColumn("seconds", F.col("_c") * F.col("dt"))
            .filter(F.col("seconds") >= min_seconds).select(*keys, "iy", "ix", "seconds"))


def coverage(occupancy: DataFrame, keys: list[str], total_bins: float) -> DataFrame:
    return occupancy.groupBy(*keys).agg(F.least(F.lit(1.0), F.count(F.lit(1)) / F.lit(total_bins)).alias("coverage"))


def bins_of(arena: float, *, bin_width: float | None = None, bin_number: int | None = None,
            bin_edges: list[float] | None = None) -> tuple[float, int]:
    """Bin width and count; exactly one description may be given, 2.5 wide bins without any."""
    given = [v is not None for v in (bin_width, bin_number, bin_edges)]
    if sum(given) > 1:
        raise ValueError("give one of bin_width, bin_number and bin_edges")
    if bin_edges is not None:
        raise ValueError("explicit edges go to histogram_edges")
    n = bin_number if bin_number is not None else math.ceil(arena / (bin_width if bin_width is not None else 2.5))
    return arena / n, n


def accumulate_spatial(df: DataFrame, keys: list[str], axes: dict[str, tuple[str, float, float]],
                       limits: dict[str, tuple[float, float]] | None = None, **bins) -> DataFrame:
    """Histogram over one or two axes.

    ``axes`` maps an index name to (column, arena size, lowest value); values at or above the upper
    limit are left out, the top edge of the last bin counts in.
    """
    names = []
    for name, (c, arena, lo) in axes.items():
        width, n = bins_of(arena, **bins)
        if limits and name in limits:
            df = df.filter((F.col(c) >= limits[name][0]) & (F.col(c) < limits[name][1]))
        df = df.withColumn(name, histogram_bin(c, lo, width, n)).filter(F.col(name).isNotNull())
        names.append(name)
    return df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("n"))


def histogram_edges(df: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Histogram over explicit edges, last bin closed."""
    if sorted(edges) != list(edges) or len(edges) < 2:
        raise ValueError("edges must ascend")
    v = F.col(value)
    idx = sum((F.when(v >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    inside = (v >= edges[0]) & (v <= edges[-1])
    return df.filter(inside).groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, keys: list[str], value, lo: float, width: float, count: int) -> DataFrame:
    return (df.withColumn("bin", histogram_bin(value, lo, width, count)).filter("bin is not null")
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))


def hist_mode(df: DataFrame, keys: list[str], value, width: float, lo: float, hi: float, out: str = "mode") -> DataFrame:
    """Left edge of the first fullest bin."""
    h = histogram(df, keys, value, lo, width, int(round((hi - lo) / width)))
    best = h.groupBy(*keys).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("_bin"))
    return best.select(*keys, (F.lit(lo) + F.col("_bin") * F.lit(width)).alias(out))


def rate_map(events: DataFrame, occupancy: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Events per second in every visited bin."""
    return (occupancy.join(events.select(*keys, "iy", "ix", F.col(count).alias("_n")), [*keys, "iy", "ix"], "left")
            .withColumn("rate", ratio(F.coalesce(F.col("_n"), F.lit(0)), "seconds"))
            .select(*keys, "iy", "ix", "seconds", "rate"))


def tuning_map(df: DataFrame, keys: list[str], ix: Column, iy: Column, signal: str, dt: float = 1.0) -> DataFrame:
    """Signal per second in every visited bin, in one pass over the samples."""
    return (df.groupBy(*keys, iy.alias("iy"), ix.alias("ix"))
              .agg((F.count(F.lit(1)) * F.lit(float(dt))).alias("seconds"), F.sum(signal).alias("_s"))
              .withColumn("rate", ratio("_s", "seconds")).drop("_s"))


def map_peak(maps: DataFrame, keys: list[str], value: str = "rate") -> DataFrame:
    """Largest value and its first bin in row order."""
    best = maps.groupBy(*keys).agg(F.max_by(F.struct("iy", "ix", value), F.struct(F.col(value), -F.col("iy"), -F.col("ix"))).alias("_p"))
    return best.select(*keys, F.col("_p.iy").alias("peak_iy"), F.col("_p.ix").alias("peak_ix"), F.col(f"_p.{value}").alias("peak"))


def rate_map_stats(maps: DataFrame, keys: list[str], rate: str = "rate", seconds: str = "seconds") -> DataFrame:
    """Mean and peak rate, sparsity, selectivity, spatial information rate and content.

    A map has a bounded number of bins, so its totals come from a window over the map: the samples
    are read once and nothing is joined back.
    """
    w = W.partitionBy(*keys)
    p, v = F.col(seconds), F.col(rate)
    m = maps.withColumn("_t", F.sum(p).over(w)).withColumn("_m", ratio(F.sum(p * v).over(w), "_t"))
    bits = F.log2(F.greatest(ratio(v, "_m"), F.lit(1.0)))
    out = m.groupBy(*keys).agg(F.avg(v).alias("mean_rate"), F.max(v).alias("peak_rate"), F.max("_m").alias("_m"),
                               F.sum(ratio(p * v * v, "_t")).alias("_mm"), F.sum(ratio(p, "_t") * v * bits).alias("info_rate"))
    return out.select(*keys, "mean_rate", "peak_rate", ratio(F.col("_m") * F.col("_m"), "_mm").alias("sparsity"),
                      ratio("peak_rate", "_m").alias("selectivity"), "info_rate", ratio("info_rate", "_m").alias("info_content"))


def place_cellness(maps: DataFrame, keys: list[str], rate: str = "rate", seconds: str = "seconds") -> DataFrame:
    m = maps.withColumn("_o", ratio(seconds, F.sum(seconds).over(W.partitionBy(*keys))))
    o, v = F.col("_o"), F.col(rate)
    return (m.groupBy(*keys).agg(ratio(F.sum(v * o * v * o), F.sum(v * v * o)).alias("cellness"))
            .withColumn("is_place_cell", F.col("cellness") > 0.3))


def partition_firing(df: DataFrame, keys: list[str], square: Column, value: str) -> DataFrame:
    """Activity per square, and over the share of time spent there."""
    per = df.groupBy(*keys, square.alias("square")).agg(F.sum(value).alias("firing"), F.count(F.lit(1)).alias("_c"))
    share = ratio("_c", F.sum("_c").over(W.partitionBy(*keys)))
    return per.withColumn("rate", ratio("firing", share)).select(*keys, "square", "firing", "rate")


def angular_occupancy(df: DataFrame, keys: list[str], angle: Column, dt: float | Column, bin_deg: float = 15.0) -> DataFrame:
    n = math.ceil(360 / bin_deg)
    return (df.withColumn("bin", histogram_bin(angle, 0.0, 2 * math.pi / n, n)).filter("bin is not null")
              .groupBy(*keys, "bin").agg((F.count(F.lit(1)) * (F.lit(dt) if isinstance(dt, float) else dt)).alias("seconds")))


def speed_occupancy(df: DataFrame, keys: list[str], speed: Column, dt: float, width: float = 5.0) -> DataFrame:
    return (df.withColumn("bin", F.floor(speed / width).cast("int"))
              .groupBy(*keys, "bin").agg((F.count(F.lit(1)) * F.lit(dt)).alias("seconds")))


def tuning_curve(spikes: DataFrame, occupancy: DataFrame, keys: list[str], angle: Column, bin_deg: float = 15.0) -> DataFrame:
    n = math.ceil(360 / bin_deg)
    counts = (spikes.withColumn("bin", histogram_bin(angle, 0.0, 2 * math.pi / n, n)).filter("bin is not null")
                    .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n")))
    return (occupancy.join(counts, [*keys, "bin"], "left")
            .select(*keys, "bin", ratio(F.coalesce(F.col("_n"), F.lit(0)), "seconds").alias("rate")))


def tuning_curve_stats(curve: DataFrame, keys: list[str], n_bins: int, percentile: float = 0.95) -> DataFrame:
    """Circular mean, peak, mean vector length and the arc above ``percentile`` of the peak."""
    w = 2 * math.pi / n_bins
    a, v = (F.col("bin") + 0.5) * w, F.col("rate")
    first = (curve.groupBy(*keys)
             .agg(F.sum(v * F.cos(a)).alias("_c"), F.sum(v * F.sin(a)).alias("_s"), F.sum(v).alias("_v"),
                  F.max(v).alias("peak_rate"), F.avg(v).alias("mean_rate"),
                  F.max_by("bin", F.struct(v, -F.col("bin"))).alias("_pk")))
    off = F.lit(n_bins // 2) - F.col("_pk")
    turned = F.pmod(F.col("bin") + off, F.lit(n_bins))
    arc = (curve.join(first.select(*keys, "_pk", "peak_rate"), keys)
                .filter(v >= F.col("peak_rate") * percentile).groupBy(*keys)
                .agg(F.min(turned - off).alias("half_cw"), (F.max(turned - off) + 1).alias("half_ccw")))
    mvl = ratio(F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")), "_v")
    out = first.join(arc, keys).withColumn("mvl", mvl)
    angle = (F.col("half_ccw") - F.col("half_cw")) * w
    return out.select(*keys, F.atan2("_s", "_c").alias("mean_direction"), ((F.col("_pk") + 0.5) * w).alias("peak_direction"),
                      "peak_rate", "mean_rate", "mvl", F.sqrt(2 * (1 - F.col("mvl"))).alias("stdev"),
                      "half_cw", "half_ccw", angle.alias("arc"), (1 - angle / math.pi).alias("score"))


def egocentric_map(df: DataFrame, keys: list[str], x: str, y: str, heading: Column, n_angles: int, n_bins: int,
                   bounds: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """Frames per (angle, wall distance) in a rectangular arena; angles are relative to the head."""
    (x0, x1), (y0, y1) = bounds
    step = 2 * math.pi / n_angles
    span = math.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)
    # (x, y, heading) repeats are counted before the angles multiply the rows.
    base = dealt(df, *keys)[0].groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), heading.alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
    a = F.pmod(F.col("angle") * step + F.col("_h"), F.lit(2 * math.pi))
    wx = F.when(F.abs(a - math.pi) < math.pi / 2, F.lit(float(x0))).otherwise(F.lit(float(x1)))
    wy = F.when(a > math.pi, F.lit(float(y0))).otherwise(F.lit(float(y1)))
    dist = F.least((wx - F.col("_x")) / F.cos(a), (wy - F.col("_y")) / F.sin(a))
    return (base.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(n_angles - 1))))
            .withColumn("bin", histogram_bin(dist, 0.0, span / n_bins, n_bins)).filter("bin is not null")
            .groupBy(*keys, "angle", "bin").agg(F.sum("_c").alias("frames")))


def expand_events(df: DataFrame, times: Column) -> DataFrame:
    """Repeat every row ``times`` times; rows below one vanish."""
    n = F.floor(times).cast("int")
    return df.filter(n >= 1).withColumn("rep", F.explode(F.sequence(F.lit(1), n)))


def activity_map_1d(df: DataFrame, keys: list[str], pos: Column, value: str, moving: Column) -> DataFrame:
    """Mean activity per position bin over moving frames."""
    return df.filter(moving).groupBy(*keys, pos.alias("bin")).agg(F.avg(value).alias("rate"))


def order_by_peak(maps: DataFrame, keys: list[str], cell: str, pos: str = "bin", value: str = "rate") -> DataFrame:
    """Rank cells by the position of their peak; the ranking sees one row per cell."""
    peak = maps.groupBy(*keys, cell).agg(F.max_by(pos, F.struct(F.col(value), -F.col(pos))).alias("peak_bin"))
    if not keys:
        return numbered(peak, ["peak_bin", cell], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    return peak.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("peak_bin", cell)))
