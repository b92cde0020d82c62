"""Sequence operators: speed, smoothing, runs of events, wheel clicks, tracking repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engram.functions import kernels as K
from engram.functions.blocks import (block_window, core, frame_block, run_bounds,
                                     sequence, with_halo)
from engram.functions.ranks import numbered
from engram.functions.exprs import col, ratio
from engram.functions.quantiles import exact_quantile


def rolling_box(df: DataFrame, keys: list[str], frame: str, value, width: int, out: str) -> DataFrame:
    """Moving average over ``width`` frames, zeros beyond both ends ("same" convolution)."""
    before, after = width // 2, (width - 1) // 2
    w = block_window(keys, frame).rangeBetween(-before, after)
    halo = with_halo(df, frame, before, after)
    return core(halo.withColumn(out, F.sum(col(value)).over(w) / F.lit(float(width))))


def moving_average(df: DataFrame, keys: list[str], frame: str, value: str, width: int, out: str) -> DataFrame:
    """Odd moving average where the end values are repeated beyond both ends."""
    if width % 2 == 0:
        raise ValueError("the moving average needs an odd width")
    h = width // 2
    ends = df.groupBy(*keys).agg(F.min(frame).alias("_f0"), F.max(frame).alias("_f1"),
                                 F.min_by(value, frame).alias("_v0"), F.max_by(value, frame).alias("_v1"))
    w = block_window(keys, frame).rangeBetween(-h, h)
    halo = with_halo(df, frame, h, h).withColumn("_sum", F.sum(value).over(w))
    miss0 = F.greatest(F.lit(0), F.col("_f0") - (F.col(frame) - h))
    miss1 = F.greatest(F.lit(0), F.col(frame) + h - F.col("_f1"))
    return (core(halo).join(ends, keys)
            .withColumn(out, (F.col("_sum") + miss0 * F.col("_v0") + miss1 * F.col("_v1")) / F.lit(float(width)))
            .drop("_sum", "_f0", "_f1", "_v0", "_v1"))


def speed(df: DataFrame, keys: list[str], frame: str, x: str, y: str | None = None, dt: float = 1.0,
          smooth: int | None = None, out: str = "speed") -> DataFrame:
    """Step length per time on a regular track; the first frame copies the second."""
    w = block_window(keys, frame)
    halo = with_halo(df, frame, 1, 2)
    dx = F.col(x) - F.lag(x).over(w)
    dist = F.abs(dx) if y is None else F.sqrt(dx * dx + (F.col(y) - F.lag(y).over(w)) * (F.col(y) - F.lag(y).over(w)))
    raw = halo.withColumn("_step", dist / F.lit(dt))
    got = core(raw.withColumn(out, F.coalesce("_step", F.lead("_step").over(w)))).drop("_step")
    if smooth is None:
        return got
    return moving_average(got.withColumnRenamed(out, "_raw"), keys, frame, "_raw", smooth, out).drop("_raw")


def speed_box(df: DataFrame, keys: list[str], frame: str, x: str, y: str, width: int, dt: float = 0.05,
              out: str = "speed") -> DataFrame:
    """Box-smoothed track, step to the next frame over dt (0 on the last), smoothed again."""
    sm = rolling_box(rolling_box(df, keys, frame, x, width, "_sx"), keys, frame, y, width, "_sy")
    w = block_window(keys, frame)
    dx, dy = F.lead("_sx").over(w) - F.col("_sx"), F.lead("_sy").over(w) - F.col("_sy")
    step = core(with_halo(sm, frame, 0, 1).withColumn("_v", F.coalesce(F.sqrt(dx * dx + dy * dy) / F.lit(dt), F.lit(0.0))))
    return rolling_box(step, keys, frame, "_v", width, out).drop("_v", "_sx", "_sy")


def velocity_savgol(df: DataFrame, keys: list[str], frame: str, x: str, y: str, fps: int, min_vel: float) -> DataFrame:
    """Savitzky-Golay smoothed speed (order 2, about one second); slow frames are dropped."""
    v = speed(df, keys, frame, x, y, 1.0 / fps, out="_raw")
    sm = K.convolve(v, keys, frame, "_raw", K.savgol(fps, 2), "velocity", renormalise=True).drop("_raw")
    return sm.filter(F.col("velocity") >= min_vel)


def mobile_smooth(df: DataFrame, keys: list[str], frame: str, value: str, threshold: float = 5.0,
                  width: int = 21, order: int = 4) -> DataFrame:
    sm = K.convolve(df, keys, frame, value, K.savgol(width, order), "_sm", renormalise=True)
    return sm.withColumn("mobile", F.col("_sm") > threshold).drop("_sm")


def median_filter(df: DataFrame, keys: list[str], frame: str, value: str, width: int, out: str) -> DataFrame:
    """Running median; the window has a fixed size, so its exact percentile is bounded work."""
    h = width // 2
    w = block_window(keys, frame).rangeBetween(-h, h)
    return core(with_halo(df, frame, h, h).withColumn(out, F.percentile(value, F.lit(0.5)).over(w)))


def derivative(df: DataFrame, keys: list[str], frame: str, value: str, out: str = "grad") -> DataFrame:
    """Central differences, one-sided at both ends."""
    w = block_window(keys, frame)
    prev, nxt, cur = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    g = F.when(prev.isNull(), nxt - cur).when(nxt.isNull(), cur - prev).otherwise((nxt - prev) / 2)
    return core(with_halo(df, frame, 1, 1).withColumn(out, g))


def upphase_mask(df: DataFrame, keys: list[str], frame: str, value: str, out: str = "up") -> DataFrame:
    """Values while the trace does not rise are set to 0."""
    return derivative(df, keys, frame, value, "_g").withColumn(out, F.when(F.col("_g") <= 0, 0.0).otherwise(F.col(value))).drop("_g")


def block_mode_baseline(df: DataFrame, keys: list[str], frame: str, value: str, window: int, width: float,
                        lo: float, hi: float, out: str) -> DataFrame:
    """Subtract the histogram mode of each block of ``window`` frames."""
    from engram.operators.occupancy import hist_mode
    b = df.withColumn("_w", F.floor(F.col(frame) / window))
    mode = hist_mode(b, [*keys, "_w"], value, width, lo, hi, "_mode")
    return b.join(mode, [*keys, "_w"], "left").withColumn(out, F.col(value) - F.coalesce("_mode", F.lit(0.0))).drop("_w", "_mode")


def event_threshold(df: DataFrame, keys: list[str], value: str, z: float, width: float = 0.001, reach: float = 25.0,
                    dff_min: float = 0.0, max_sigma: float = 100.0) -> DataFrame:
    """Threshold from the left half of the value distribution.

    Values up to the mode are pooled with their negatives (mean 0).  The threshold is the first grid
    point whose normal CDF passes the percentile with quantile ``z``; wide cells get 1.
    """
    from engram.operators.occupancy import hist_mode
    mode = hist_mode(df, keys, value, width, -reach, reach, "_mode")
    left = df.join(mode, keys).filter(F.col(value) <= F.col("_mode"))
    pooled = left.groupBy(*keys).agg(F.sum(F.col(value) * F.col(value)).alias("_ss"), F.count(F.lit(1)).alias("_n"),
                                     F.max("_mode").alias("mode"))
    sigma = F.sqrt(2 * F.col("_ss") / (2 * F.col("_n") - 1))
    grid = F.ceil(F.round(F.col("sigma") * F.lit(z) / width, 6)) * width
    thr = F.when(F.col("sigma") > max_sigma, 1.0).otherwise(grid)
    return pooled.withColumn("sigma", sigma).select(*keys, "mode", "sigma", F.greatest(thr, F.lit(dff_min)).alias("threshold"))


def moment_override(df: DataFrame, keys: list[str], value: str, limit: float = 0.01, scaling: float = 0.5) -> DataFrame:
    """Second central moment per cell; at or above the limit the threshold becomes ``scaling``."""
    return (df.groupBy(*keys).agg(F.var_pop(value).alias("moment2"))
              .withColumn("threshold", F.when(F.col("moment2") >= limit, F.lit(scaling))))


def binarize_runs(df: DataFrame, keys: list[str], frame: str, above: Column, min_width: int, out: str = "bin",
                  compat: bool = True) -> DataFrame:
    """Ones on runs of at least ``min_width`` frames.

    With ``compat`` a run s..e is written to s-1..e-1 and runs that touch an end of the recording vanish.
    """
    runs = run_bounds(df, keys, [frame], frame_block(frame), above, frame)
    wide = F.col("state") & (F.col("run_end") - F.col("run_start") + 1 >= min_width)
    if compat:
        inner = (F.col("run_start") > F.col("key_start")) & (F.col("run_end") < F.col("key_end"))
        mark = runs.withColumn("_m", F.when(wide & inner, 1).otherwise(0))
        w = block_window(keys, frame)
        got = core(with_halo(mark, frame, 0, 1).withColumn(out, F.coalesce(F.lead("_m").over(w), F.lit(0))))
    else:
        got = runs.withColumn(out, F.when(wide, 1).otherwise(0))
    return got.select(*df.columns, out)


def event_runs(df: DataFrame, keys: list[str], frame: str, on: Column) -> DataFrame:
    """One row per run of ``on`` frames: start, end and length."""
    runs = run_bounds(df, keys, [frame], frame_block(frame), on, frame)
    return (runs.filter(F.col("state") & F.col("is_start"))
                .select(*keys, F.col("run_start").alias("start"), F.col("run_end").alias("end"),
                        (F.col("run_end") - F.col("run_start") + 1).alias("length")))


def burst_stats(df: DataFrame, keys: list[str], frame: str, on: Column, value: str) -> DataFrame:
    """Per run of ``on``: peak over the median of the whole trace, and duration."""
    runs = run_bounds(df, keys, [frame], frame_block(frame), on, frame)
    per = (runs.filter("state").groupBy(*keys, "run_start")
               .agg(F.max(value).alias("_pk"), (F.max("run_end") - F.col("run_start") + 1).alias("duration")))
    med = exact_quantile(df, keys, value, 0.5, "_med")
    return per.join(med, keys).select(*keys, F.col("run_start").alias("start"), ratio("_pk", "_med").alias("peak"), "duration")


def binarize_std(df: DataFrame, keys: list[str], value: str, k: float, out: str = "bin") -> DataFrame:
    sd = df.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    return df.join(sd, keys).withColumn(out, F.when(F.col(value) >= F.col("_sd") * k, 1).otherwise(0)).drop("_sd")


def scale_events(df: DataFrame, keys: list[str], frame: str, on: Column, scale: str, min_amplitude: float,
                 buffer: int = 5, out: str = "scaled") -> DataFrame:
    """Every inner run carries the sum of ``scale`` from its start to ``buffer`` past its end.

    Half-height edges are cut to whole frames, so run s..e reads and writes from s-1 and stops before e.
    """
    runs = run_bounds(df, keys, [frame], frame_block(frame), on, frame)
    cum = sequence(runs, keys, [frame], frame_block(frame), cumsum={"_c": scale})
    # The running sum at the end of the reach is looked up by frame; a run at the end of the trace stops there.
    starts = cum.filter(F.col("state") & F.col("is_start"))
    starts = starts.filter((F.col("run_start") > F.col("key_start")) & (F.col("run_end") < F.col("key_end")))
    at = cum.select(*keys, F.col(frame).alias("_at"), F.col("_c").alias("_to"))
    before = cum.select(*keys, (F.col(frame) + 2).alias("_bf"), F.col("_c").alias("_from"))
    ev = (starts.select(*keys, "run_start", "run_end",
                        F.least(F.col("run_end") + buffer - 1, F.col("key_end")).alias("_at"), F.col("run_start").alias("_bf"))
          .join(at, [*keys, "_at"]).join(before, [*keys, "_bf"], "left")
          .select(*keys, "run_start", "run_end", (F.col("_to") - F.coalesce("_from", F.lit(0.0))).alias("amplitude")))
    return ev.select(*keys, F.col("run_start").alias("start"), F.col("run_end").alias("end"),
                     F.when(F.col("amplitude") >= min_amplitude, F.col("amplitude")).otherwise(0.0).alias(out))


def event_onsets(df: DataFrame, keys: list[str], frame: str, on: Column) -> DataFrame:
    """Frames where ``on`` turns from 0 to 1."""
    w = block_window(keys, frame)
    return (core(with_halo(df.withColumn("_on", on), frame, 1, 0).withColumn("_p", F.lag("_on").over(w)))
            .filter(F.col("_on") & ~F.col("_p")).drop("_on", "_p"))


def find_sequences(df: DataFrame, keys: list[str], frame: str, jump: Column) -> DataFrame:
    """Segment number of every frame; ``jump`` marks the first frame of a new segment."""
    return sequence(df, keys, [frame], frame_block(frame), cumsum={"segment": F.when(jump, 1).otherwise(0)})


def fill_gaps(df: DataFrame, keys: list[str], frame: str, state: str, n: int, out: str = "filled") -> DataFrame:
    """Fill between ones at most ``n`` apart, then between zeros at most ``n`` apart.

    A filled frame has both ends of its gap within ``n`` frames, so a halo of ``n`` is enough.
    """
    def fill(d, c, v, name):
        w = block_window(keys, frame)
        mark = F.when(F.col(c) == v, F.col(frame))
        halo = (with_halo(d, frame, n, n).withColumn("_a", F.max(mark).over(w.rangeBetween(-n, 0)))
                .withColumn("_z", F.min(mark).over(w.rangeBetween(0, n))))
        return core(halo).withColumn(name, F.when(F.col("_z") - F.col("_a") <= n, v).otherwise(F.col(c))).drop("_a", "_z")

    return fill(fill(df, state, 1, "_one"), "_one", 0, out).drop("_one")


def bout_hist(df: DataFrame, keys: list[str], at: str, block: Column, max_step) -> DataFrame:
    """Number of bouts by length: maximal stretches whose steps are at most ``max_step``."""
    near = sequence(df, keys, [at], block, lag={"_p": at})
    near = near.withColumn("_new", F.when(F.col("_p").isNull() | (F.col(at) - F.col("_p") > max_step), 1).otherwise(0))
    bouts = sequence(near, keys, [at], block, cumsum={"_bout": "_new"})
    return (bouts.groupBy(*keys, "_bout").agg(F.count(F.lit(1)).alias("length"))
                 .groupBy("length").agg(F.count(F.lit(1)).alias("bouts")))


def rising_edges(df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, level: float = 1.0) -> DataFrame:
    near = sequence(df, keys, order, block, lag={"_p": value})
    return near.filter((F.col(value) >= level) & (F.col("_p") < level)).drop("_p")


def win_cumdist(df: DataFrame, keys: list[str], order: list[str], block: Column, click: Column, per_click: float) -> DataFrame:
    """Running click count and distance."""
    out = sequence(df.withColumn("_k", click), keys, order, block, cumsum={"clicks": "_k"})
    return out.withColumn("distance", F.col("clicks") * F.lit(per_click)).drop("_k")


def click_velocity(df: DataFrame, keys: list[str], at: str, block: Column, click: str, per_click: float, rate: float,
                   still: int) -> DataFrame:
    """Velocity at every click; a pause of ``still`` samples or more is replaced by zeros every ``still`` samples.

    The click that ends such a pause is replaced too, the very first click counts from sample 0.
    """
    near = sequence(df.filter(F.col(click) != 0), keys, [at], block, lag={"_p": at})
    gap = F.col(at) - F.coalesce("_p", F.lit(0))
    moving = (near.filter(F.col("_p").isNull() | (gap < still))
              .select(*keys, F.col(at).alias("sample"), ratio(F.col(click) * F.lit(per_click) * F.lit(rate), gap).alias("velocity")))
    steps = F.floor((gap - 1) / still).cast("bigint")
    zeros = (near.filter(F.col("_p").isNotNull() & (gap >= still) & (steps >= 1))
             .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), steps)))
             .select(*keys, (F.col("_p") + F.col("_i") * still).alias("sample"), F.lit(0.0).alias("velocity")))
    return moving.unionByName(zeros)


def frame_offsets(df: DataFrame, keys: list[str], session: str, frame: str) -> DataFrame:
    """Running frame offset of consecutive sessions; the window sees one row per session."""
    n = df.groupBy(*keys, session).agg(F.count(F.lit(1)).alias("frames"))
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(session).rowsBetween(W.unboundedPreceding, -1)
    return n.withColumn("offset", F.coalesce(F.sum("frames").over(w), F.lit(0)))


def dedup_states(df: DataFrame, frame: str, total: Column, tol: float = 1e-10) -> DataFrame:
    """Drop a state whose summed change to the one before is at most ``tol``."""
    s = sequence(df.withColumn("_t", total), [], [frame], frame_block(frame), lag={"_p": "_t"})
    return s.filter(F.col("_p").isNull() | (F.col("_t") - F.col("_p") > tol)).drop("_t", "_p")


def dlc_likelihood(df: DataFrame, likelihood: str, threshold: float, x: str = "x", y: str = "y") -> DataFrame:
    ok = F.col(likelihood) >= threshold
    return df.withColumns({x: F.when(ok, F.col(x)), y: F.when(ok, F.col(y))})


def dlc_jump(df: DataFrame, keys: list[str], frame: str, x: str, y: str, max_jump: float) -> DataFrame:
    """Blank a frame when the step to the next one is too long."""
    w = block_window(keys, frame)
    dx, dy = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    far = F.coalesce(F.sqrt(dx * dx + dy * dy) > max_jump, F.lit(False))
    halo = with_halo(df, frame, 0, 1).withColumn("_far", far)
    return core(halo).withColumns({x: F.when(~F.col("_far"), F.col(x)), y: F.when(~F.col("_far"), F.col(y))}).drop("_far")


def dlc_median_part(df: DataFrame, keys: list[str], frame: str, x: str, y: str) -> DataFrame:
    """Median over body parts; a frame has a handful of parts, so the exact median is bounded."""
    return df.groupBy(*keys, frame).agg(F.median(x).alias("x"), F.median(y).alias("y"))


def dlc_short_segments(df: DataFrame, keys: list[str], frame: str, x: str, y: str, min_length: int, fill: int, short: bool = False) -> DataFrame:
    """Blank valid stretches shorter than ``min_length``; fill blanks with the median of frames -fill..fill-1. ``short`` keys fit a task each."""
    runs = run_bounds(df, keys, [frame], frame_block(frame), F.col(x).isNotNull(), frame, short)
    brief = F.col("state") & (F.col("run_end") - F.col("run_start") + 1 < min_length)
    cut = runs.withColumns({x: F.when(~brief, F.col(x)), y: F.when(~brief, F.col(y))}).select(*df.columns)
    w = block_window(keys, frame).rangeBetween(-fill, fill - 1)
    halo = with_halo(cut, frame, fill, fill)
    med = halo.withColumn("_mx", F.percentile(x, F.lit(0.5)).over(w)).withColumn("_my", F.percentile(y, F.lit(0.5)).over(w))
    return core(med).withColumns({x: F.coalesce(x, "_mx"), y: F.coalesce(y, "_my")}).drop("_mx", "_my")


def global_std(df: DataFrame, keys: list[str], cell: list[str], value: str, width: float = 0.5, count: int = 200) -> DataFrame:
    """First histogram edge at which half of the cells (with any variation) are covered."""
    from engram.functions.exprs import histogram_bin
    sd = df.groupBy(*keys, *cell).agg(F.stddev_pop(value).alias("_sd")).filter("_sd > 0")
    h = (sd.withColumn("bin", histogram_bin("_sd", 0.0, width, count)).filter("bin is not null")
           .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_c")))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    upto = F.sum("_c").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_c").over(w)
    hit = h.withColumn("_share", upto / total).filter("_share >= 0.5")
    return hit.groupBy(*keys).agg((F.min("bin") * F.lit(width)).alias("global_std"))


def trace_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Signal to noise (mean over sd, 0 without variation) and skewness."""
    sd = F.stddev_pop(value)
    return df.groupBy(*keys).agg(F.when(sd > 0, F.avg(value) / sd).otherwise(0.0).alias("snr"), F.skewness(value).alias("skew"))


def dense_ids(df: DataFrame, label: str, out: str = "dense_id") -> DataFrame:
    """Relabel 0..n-1; only the distinct labels are ranked, by ranges."""
    ids = numbered(df.select(label).distinct(), [label], out).withColumn(out, F.col(out).cast("int"))
    return df.join(ids, label)


def time_bin_sum(df: DataFrame, keys: list[str], frame: str, value: str, width: int, every: int = 1) -> DataFrame:
    """Keep every k-th frame, then add ``width`` of those per bin; a partial last bin stays."""
    kept = df.filter(F.col(frame) % every == 0)
    return kept.groupBy(*keys, F.floor(F.col(frame) / (every * width)).alias("bin")).agg(F.sum(value).alias("value"))


def time_bin(df: DataFrame, keys: list[str], frame: str, value: str, width: int, how: str = "sum") -> DataFrame:
    """Bins of ``width`` frames; the last bin is dropped, full or not."""
    b = df.withColumn("bin", F.floor(F.col(frame) / width))
    last = b.groupBy(*keys).agg(F.max("bin").alias("_last"))
    agg = F.sum(value) if how == "sum" else F.median(value)
    return (b.groupBy(*keys, "bin").agg(agg.alias("value")).join(last, keys)
             .filter(F.col("bin") < F.col("_last")).drop("_last"))
