"""Row selections: movement state, active frames and cells, tracking quality, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engram.functions.blocks import sequence
from engram.functions.exprs import col


def walk_filter(df: DataFrame, speed: str, cutoff: float, companions: list[str], fmt: str = "remove") -> DataFrame:
    """Keep rows at or above the cutoff, or mask their columns."""
    keep = F.col(speed) >= cutoff
    if fmt == "remove":
        return df.filter(keep)
    if fmt == "mask":
        return df.withColumns({c: F.when(keep, F.col(c)) for c in [speed, *companions]})
    raise ValueError(f"fmt must be 'remove' or 'mask', not {fmt!r}")


def mobile_split(df: DataFrame, speed: str, threshold: float = 5.0) -> DataFrame:
    return df.withColumn("mobile", F.col(speed) > threshold)


def run_quiescent(df: DataFrame, velocity: str, run_min: float = 0.02, quiet_max: float = 0.005) -> DataFrame:
    """Label frames as running or quiescent; frames between the two limits belong to neither."""
    v = F.col(velocity)
    return (df.withColumn("state", F.when(v > run_min, "running").when(v <= quiet_max, "quiescent"))
              .filter("state is not null"))


def state_restrict(activity: DataFrame, frames: DataFrame, on: list[str]) -> DataFrame:
    return activity.join(frames.select(*on).distinct(), on, "left_semi")


def active_frames(activity: DataFrame, frame: list[str], value: str, min_activity: float = 1) -> DataFrame:
    return (activity.groupBy(*frame).agg(F.sum(value).alias("total")).filter(F.col("total") >= min_activity))


def active_cells(activity: DataFrame, cell: list[str], frame: list[str], value: str, min_spikes: float) -> DataFrame:
    """Rows of cells with enough spikes, in frames where anything happened at all."""
    cells = activity.groupBy(*cell).agg(F.sum(value).alias("_s")).filter(F.col("_s") >= min_spikes)
    frames = activity.groupBy(*frame).agg(F.sum(value).alias("_s")).filter("_s > 0")
    return activity.join(cells, cell, "left_semi").join(frames, frame, "left_semi")


def speed_upper_bound(df: DataFrame, keys: list[str], speed: str, bandwidth: float, frames_needed: float) -> DataFrame:
    """Centre of the highest speed band of width ``bandwidth`` holding enough frames.

    Tenth-of-a-band histogram from min(speed); bands are looked at from the top down.
    """
    step = bandwidth / 10
    ext = df.groupBy(*keys).agg(F.min(speed).alias("_lo"), F.max(speed).alias("_hi"))
    edges = F.ceil(F.round((F.col("_hi") - F.col("_lo")) / step, 9)).cast("long")   # edges lo + i*step, i < edges
    ext = ext.withColumn("_ne", edges).filter("_ne > 1")
    raw = F.floor(F.round((F.col(speed) - F.col("_lo")) / step, 9)).cast("long")
    last = F.col("_ne") - 2
    onto = (F.col(speed) <= F.col("_lo") + (F.col("_ne") - 1) * step)
    hist = (df.join(ext, keys).filter(onto).withColumn("_i", F.least(raw, last))
              .groupBy(*keys, "_i", "_lo", "_ne").agg(F.count(F.lit(1)).alias("_c")))
    # A band is hist[j .. j+9]; every filled bin adds to the ten bands that hold it.
    bands = (hist.withColumn("_j", F.explode(F.sequence(F.col("_i") - 9, F.col("_i"))))
                 .groupBy(*keys, "_j", "_lo", "_ne").agg(F.sum("_c").alias("_c"))
                 .filter((F.col("_j") >= 0) & (F.col("_j") + 10 <= F.col("_ne") - 2) & (F.col("_c") >= frames_needed)))
    # hist has one bin fewer than edges: band start j in hist is edge index j + 1 counted from the top.
    top = bands.groupBy(*keys).agg(F.max(F.struct("_j", "_lo")).alias("_t"))
    return top.select(*keys, (F.col("_t._lo") + (F.col("_t._j") + 1 - 5) * step).alias("upper_speed"))


def speed_bandpass(df: DataFrame, keys: list[str], speed: str, mode: str = "none", lower: float = 2.0,
                   upper: float = 15.0, bandwidth: float = 2.0, frames_needed: float = 10.0,
                   missing: str = "error") -> DataFrame:
    """Frames inside a speed band: none, fixed, or from ``lower`` to the adaptive bound, which comes along as ``upper_speed``.

    A unit without a band that holds enough frames has no bound: ``missing`` raises an error, or keeps all its frames with a NULL bound.
    """
    v = F.col(speed)
    if mode == "none":
        return df
    if mode == "fixed":
        return df.filter((v >= lower) & (v <= upper))
    if mode == "adaptive":
        bound = speed_upper_bound(df, keys, speed, bandwidth, frames_needed)
        found = F.col("upper_speed").isNotNull()
        stop = F.raise_error(F.lit("no speed band holds enough frames")).cast("boolean") if missing == "error" else F.lit(True)
        return df.join(bound, keys, "left").filter(F.when(found, (v >= lower) & (v <= F.col("upper_speed"))).otherwise(stop))
    raise ValueError(f"unknown band pass {mode!r}")


def nonvisited_drop(test: DataFrame, train: DataFrame, x: str, y: str, radius: float = 3.0) -> DataFrame:
    """Drop test rows whose nearest training location is further than ``radius``.

    Locations are made distinct.  Two locations in one square of side radius / 1.5 are always near,
    which settles crowded places by a semi join; only what is left is measured against the training
    locations of the nine squares of side ``radius`` around it.
    """
    def squares(df, side, a, b):
        return df.withColumn(a, F.floor(F.col(x) / side)).withColumn(b, F.floor(F.col(y) / side))

    around = F.sequence(F.lit(-1), F.lit(1))
    known = train.select(x, y).distinct()
    fine = squares(known, radius / 1.5, "_fx", "_fy").select("_fx", "_fy").distinct()
    places = squares(squares(test.select(x, y).distinct(), radius / 1.5, "_fx", "_fy"), radius, "_gx", "_gy")
    sure = places.join(fine, ["_fx", "_fy"], "left_semi").select(x, y)
    open_ = places.join(fine, ["_fx", "_fy"], "left_anti")
    seen = (squares(known, radius, "_gx", "_gy")
            .withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
            .select(F.col(x).alias("_tx"), F.col(y).alias("_ty"),
                    (F.col("_gx") + F.col("_dx")).alias("_gx"), (F.col("_gy") + F.col("_dy")).alias("_gy")))
    dx, dy = F.col(x) - F.col("_tx"), F.col(y) - F.col("_ty")
    near = open_.join(seen, ["_gx", "_gy"]).filter(F.sqrt(dx * dx + dy * dy) <= radius).select(x, y).distinct()
    return test.join(sure.unionByName(near), [x, y], "left_semi")


def corr_threshold(pairs: DataFrame, z_min: float | None = None, p_max: float | None = None,
                   r_min: float | None = None, a: str = "a", b: str = "b") -> DataFrame:
    keep: Column = F.col(a) != F.col(b)
    if z_min is not None:
        keep = keep & (F.col("z") >= z_min)
    if p_max is not None:
        keep = keep & (F.col("p") <= p_max)
    if r_min is not None:
        keep = keep & (F.col("r") >= r_min)
    return pairs.filter(keep)


def train_test_split(df: DataFrame, keys: list[str], order: list[str], block: Column, share: float = 0.8) -> DataFrame:
    """First ``share`` of the ordered rows is training data; adds ``part``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    numbered = sequence(df, keys, order, block, number="_row")
    joined = numbered.join(sizes, keys) if keys else numbered.crossJoin(F.broadcast(sizes))
    return joined.withColumn("part", F.when(F.col("_row") < F.floor(F.col("_n") * F.lit(share)), "train")
                             .otherwise("test")).drop("_row", "_n")


def split_data_range(df: DataFrame, frame: str, cell: list[str], value: str, initial: int, end: int) -> DataFrame:
    """Rows of a frame range, without the cells that are silent in it."""
    part = df.filter((F.col(frame) >= initial) & (F.col(frame) < end))
    loud = part.groupBy(*cell).agg(F.sum(value).alias("_s")).filter("_s > 0")
    return part.join(loud, cell, "left_semi")


def place_cells(stats: DataFrame, z: str = "z", threshold: float = 3.0) -> DataFrame:
    return stats.filter(F.col(z) > threshold)


def degree_prune(edges: DataFrame, min_degree: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Drop nodes of low degree once; isolates vanish with their edges."""
    keys = keys or []
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
    keep = ends.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") >= min_degree).select(*keys, "node")
    for side in ("src", "dst"):
        edges = edges.join(keep.withColumnRenamed("node", side), [*keys, side], "left_semi")
    return edges
