"""Summaries over animals, sessions and days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from engram.functions.exprs import ratio
from engram.functions.pvalue import pearson_pvalue

KEYS = ["animal", "session"]


def _on_list(sessions: DataFrame, metric: DataFrame) -> DataFrame:
    """Every listed session, NULL where nothing was recorded."""
    return sessions.select(*KEYS).distinct().join(metric, KEYS, "left")


def cohort_cells(df: DataFrame, sessions: DataFrame, cell: str) -> DataFrame:
    return _on_list(sessions, df.groupBy(*KEYS).agg(F.countDistinct(cell).alias("cells")))


def cohort_duration(df: DataFrame, sessions: DataFrame, fps: float = 30.0) -> DataFrame:
    return _on_list(sessions, df.groupBy(*KEYS).agg((F.count(F.lit(1)) / F.lit(fps)).alias("seconds")))


def cohort_running(df: DataFrame, sessions: DataFrame, velocity: str, limit: float = 0.02) -> DataFrame:
    return _on_list(sessions, df.groupBy(*KEYS).agg(F.avg(F.when(F.col(velocity) > limit, 1.0).otherwise(0.0)).alias("running")))


def cohort_distance(df: DataFrame, sessions: DataFrame, step: str) -> DataFrame:
    return _on_list(sessions, df.groupBy(*KEYS).agg(F.sum(step).alias("distance")))


def cohort_totals(df: DataFrame, cell: str, step: str) -> DataFrame:
    """Per session, per animal and overall."""
    return df.rollup(*KEYS).agg(F.count(F.lit(1)).alias("frames"), F.countDistinct(cell).alias("cells"), F.sum(step).alias("distance"))


def trend_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Line and Pearson r of a metric against the day; missing values are left out."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return (d.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
                                 F.count(F.lit(1)).alias("n"),
                                 F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("r"))
             .withColumn("p", pearson_pvalue("r", F.col("n").cast("double"))))


def trend_quadratic(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = a x^2 + b x + c from power sums of the centred x."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    mid = d.groupBy(*keys).agg(F.avg("_x").alias("_m"))
    u, v = F.col("_x") - F.col("_m"), F.col("_y")
    s = d.join(mid, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"),
        F.sum(v).alias("t0"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"), F.max("_m").alias("_m"))
    n, s2, s3, s4, t0, t1, t2 = (F.col(k) for k in "n s2 s3 s4 t0 t1 t2".split())
    det = n * (s2 * s4 - s3 * s3) - s2 * s2 * s2
    c = ratio(t0 * (s2 * s4 - s3 * s3) - s2 * (s2 * t2 - s3 * t1), det)   # at the centre
    b = ratio(n * (t1 * s4 - s3 * t2) + s2 * (s3 * t0 - s2 * t1), det)
    a = ratio(n * (s2 * t2 - t1 * s3) - s2 * s2 * t0, det)
    s = s.withColumn("a", a).withColumn("_b", b).withColumn("_c", c)
    return s.select(*keys, "a", (F.col("_b") - 2 * F.col("a") * F.col("_m")).alias("b"),
                    (F.col("_c") - F.col("_b") * F.col("_m") + F.col("a") * F.col("_m") * F.col("_m")).alias("c"))


def top_cells(df: DataFrame, keys: list[str], cell: str, frame: str, n_cells: int, n_frames: int) -> DataFrame:
    """First cells in quality order and first frames of every session that has enough of both."""
    cells = df.groupBy(*keys, cell).agg(F.max(frame).alias("_last"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(cell))
    enough = (cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.max("_last").alias("_l"))
              .filter((F.col("_c") >= n_cells) & (F.col("_l") + 1 >= n_frames)).select(*keys))
    best = cells.withColumn("_r", rank).filter(F.col("_r") <= n_cells).select(*keys, cell)
    return df.filter(F.col(frame) < n_frames).join(best, [*keys, cell], "left_semi").join(enough, keys, "left_semi")
