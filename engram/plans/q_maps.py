"""Occupancy, rate maps and tuning."""

import math

from pyspark.sql import functions as F

from engram.functions.blocks import dealt, frame_block, with_halo, block_window, core
from engram.functions.exprs import rounded as r
from engram.operators import occupancy as O
from engram.plans.registry import query
from engram.sources import tables as S
from engram.sources.tables import with_views

IX, IY = "CAST(floor(x / 2.5) AS INTEGER)", "CAST(y AS INTEGER)"
TMAP = f"""m AS (SELECT unit, {IY} AS iy, {IX} AS ix, CAST(count(*) AS DOUBLE) AS seconds, sum(signal) / count(*) AS rate
    FROM tracking GROUP BY 1, 2, 3)"""
STATS = """s1 AS (SELECT unit, sum(seconds) AS tt, sum(seconds * rate) / sum(seconds) AS mr, sum(seconds * rate * rate) / sum(seconds) AS mrr,
        avg(rate) AS mean_rate, max(rate) AS peak_rate FROM m GROUP BY 1),
    s2 AS (SELECT m.unit, sum(seconds / tt * rate * log2(greatest(rate / mr, 1.0))) AS info_rate FROM m JOIN s1 USING (unit) GROUP BY 1)"""


def ix():
    return F.floor(F.col("x") / 2.5).cast("int")


def iy():
    return F.col("y").cast("int")


def angle():
    """Heading of a tracking sample: the x axis of the test table wrapped to a turn."""
    return F.col("x") * F.lit(2 * math.pi / 51)


def unit_map(spark, d):
    return O.tuning_map(dealt(S.tracking(spark, d), "unit")[0], ["unit"], ix(), iy(), "signal")


@query("rate_map_stats", with_views("tracking", TMAP, STATS, """SELECT unit, round(mean_rate, 4) + 0.0 AS mean_rate,
    round(peak_rate, 4) + 0.0 AS peak_rate, round(mr * mr / mrr, 6) + 0.0 AS sparsity, round(peak_rate / mr, 6) + 0.0 AS selectivity,
    round(info_rate, 4) + 0.0 AS info_rate, round(info_rate / mr, 6) + 0.0 AS info_content FROM s1 JOIN s2 USING (unit)"""))
def rate_map_stats(spark, d):
    st = O.rate_map_stats(unit_map(spark, d), ["unit"])
    return st.select("unit", r("mean_rate", 4).alias("mean_rate"), r("peak_rate", 4).alias("peak_rate"), r("sparsity").alias("sparsity"),
                     r("selectivity").alias("selectivity"), r("info_rate", 4).alias("info_rate"), r("info_content").alias("info_content"))


@query("place_occupancy", with_views("track", f"SELECT session, {IY} AS iy, {IX} AS ix, round(count(*) * 5e-2, 6) + 0.0 AS seconds FROM track GROUP BY 1, 2, 3"))
def place_occupancy(spark, d):
    t = S.track(spark, d).withColumn("sec", F.col("frame") / 20.0)
    dt = O.frame_duration(t, ["session"], "frame", frame_block()).withColumn("dt", F.col("dt") * 0.05)
    return O.place_occupancy(t, ["session"], ix(), iy(), dt).select("session", "iy", "ix", r("seconds").alias("seconds"))


@query("occupancy_coverage", with_views("tracking", f"""SELECT unit, round(least(1.0, count(DISTINCT ({IY}, {IX})) / 231.0), 6) + 0.0 AS coverage FROM tracking GROUP BY 1"""))
def occupancy_coverage(spark, d):
    bins = S.tracking(spark, d).select("unit", iy().alias("iy"), ix().alias("ix")).distinct()
    return O.coverage(bins, ["unit"], 231.0).select("unit", r("coverage").alias("coverage"))


@query("accumulate_spatial", with_views("tracking", """SELECT unit, CAST(least(floor((x - 1) / 2.45), 19) AS INTEGER) AS ix,
    CAST(least(floor(round(y / 2.5, 9)), 3) AS INTEGER) AS iy, count(*) AS n FROM tracking WHERE y < 10 GROUP BY 1, 2, 3"""))
def accumulate_spatial(spark, d):
    return O.accumulate_spatial(S.tracking(spark, d), ["unit"], {"ix": ("x", 49.0, 1.0), "iy": ("y", 10.0, 0.0)},
                                {"iy": (0.0, 10.0)})


@query("histogram", with_views("spikes", "SELECT kind, CAST(least(floor(round(value / 5, 9)), 199) AS INTEGER) AS bin, count(*) AS n FROM spikes WHERE value >= 0 AND value <= 1000 GROUP BY 1, 2"))
def histogram(spark, d):
    return O.histogram(S.spikes(spark, d), ["kind"], "value", 0.0, 5.0, 200)


@query("histogram_edges", with_views("spikes", """SELECT kind, CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 ELSE 2 END AS bin, count(*) AS n
    FROM spikes WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2"""))
def histogram_edges(spark, d):
    return O.histogram_edges(S.spikes(spark, d), ["kind"], "value", [0.0, 10.0, 50.0, 200.0])


@query("hist_mode", with_views("spikes", """h AS (SELECT unit_id, CAST(least(floor(round(value / 5, 9)), 199) AS INTEGER) AS bin, count(*) AS n FROM spikes WHERE value BETWEEN 0 AND 1000 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, bin) AS rk FROM h)""", "SELECT unit_id, bin * 5.0::DOUBLE AS mode FROM k WHERE rk = 1"))
def hist_mode(spark, d):
    return O.hist_mode(S.spikes(spark, d), ["unit_id"], "value", 5.0, 0.0, 1000.0)


@query("rate_map", with_views("tracking", f"""o AS (SELECT unit, {IY} AS iy, {IX} AS ix, count(*) * 0.5 AS seconds, count(*) FILTER (WHERE signal > 60) AS n
    FROM tracking GROUP BY 1, 2, 3)""", "SELECT unit, iy, ix, CAST(seconds AS DOUBLE) AS seconds, round(n / seconds, 6) + 0.0 AS rate FROM o"))
def rate_map(spark, d):
    t = S.tracking(spark, d)
    occ = t.groupBy("unit", iy().alias("iy"), ix().alias("ix")).agg((F.count(F.lit(1)) * F.lit(0.5)).alias("seconds"))
    ev = t.filter("signal > 60").groupBy("unit", iy().alias("iy"), ix().alias("ix")).agg(F.count(F.lit(1)).alias("n"))
    return O.rate_map(ev, occ, ["unit"]).select("unit", "iy", "ix", "seconds", r("rate").alias("rate"))


@query("tuning_map", with_views("tracking", TMAP, """k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY rate DESC, iy, ix) AS rk, count(*) OVER (PARTITION BY unit) AS bins FROM m)""",
    "SELECT unit, iy AS peak_iy, ix AS peak_ix, round(rate, 4) + 0.0 AS peak, bins FROM k WHERE rk = 1"))
def tuning_map(spark, d):
    m = unit_map(spark, d)
    n = m.groupBy("unit").agg(F.count(F.lit(1)).alias("bins"))
    return O.map_peak(m, ["unit"]).join(n, "unit").select("unit", "peak_iy", "peak_ix", r("peak", 4).alias("peak"), "bins")


@query("place_cellness", with_views("tracking", TMAP, "t AS (SELECT unit, sum(seconds) AS tt FROM m GROUP BY 1)",
    """SELECT unit, round(sum((rate * seconds / tt) * (rate * seconds / tt)) / sum(rate * rate * seconds / tt), 6) + 0.0 AS cellness,
    sum((rate * seconds / tt) * (rate * seconds / tt)) / sum(rate * rate * seconds / tt) > 0.3 AS is_place_cell FROM m JOIN t USING (unit) GROUP BY 1"""))
def place_cellness(spark, d):
    return O.place_cellness(unit_map(spark, d), ["unit"]).withColumn("cellness", r("cellness"))


@query("partition_firing", with_views("tracking", """p AS (SELECT unit, CAST(CASE WHEN x < 50 AND y * 5 < 50 THEN floor(x / 10) * 5 + floor(y * 5 / 10) ELSE 0 END AS BIGINT) AS square,
    sum(signal) AS firing, count(*) AS c FROM tracking GROUP BY 1, 2), t AS (SELECT unit, sum(c) AS tt FROM p GROUP BY 1)""",
    "SELECT unit, square, round(firing, 2) + 0.0 AS firing, round(firing / (c / tt), 2) + 0.0 AS rate FROM p JOIN t USING (unit)"))
def partition_firing(spark, d):
    from engram.functions.exprs import grid_partition
    out = O.partition_firing(S.tracking(spark, d), ["unit"], grid_partition("x", F.col("y") * 5, 50.0, 10.0), "signal")
    return out.select("unit", "square", r("firing", 2).alias("firing"), r("rate", 2).alias("rate"))


ANG = "x * (2 * pi() / 51)"
ABIN = f"CAST(least(floor(round({ANG} / (2 * pi() / 24), 9)), 23) AS INTEGER)"


@query("angular_occupancy", with_views("tracking", f"SELECT unit, {ABIN} AS bin, round(count(*) * 5e-2, 6) + 0.0 AS seconds FROM tracking GROUP BY 1, 2"))
def angular_occupancy(spark, d):
    return O.angular_occupancy(S.tracking(spark, d), ["unit"], angle(), 0.05).withColumn("seconds", r("seconds"))


@query("speed_occupancy", with_views("tracking", "SELECT unit, CAST(floor(x / 5) AS INTEGER) AS bin, round(count(*) * 5e-2, 6) + 0.0 AS seconds FROM tracking GROUP BY 1, 2"))
def speed_occupancy(spark, d):
    return O.speed_occupancy(S.tracking(spark, d), ["unit"], F.col("x"), 0.05).withColumn("seconds", r("seconds"))


CURVE = f"""curve AS (SELECT unit, {ABIN} AS bin, count(*) FILTER (WHERE signal > 60) / (count(*) * 5e-2) AS rate FROM tracking GROUP BY 1, 2)"""


def curve(spark, d):
    t = S.tracking(spark, d)
    return O.tuning_curve(t.filter("signal > 60"), O.angular_occupancy(t, ["unit"], angle(), 0.05), ["unit"], angle())


@query("tuning_curve", with_views("tracking", CURVE, "SELECT unit, bin, round(rate, 6) + 0.0 AS rate FROM curve"))
def tuning_curve(spark, d):
    return curve(spark, d).withColumn("rate", r("rate"))


@query("tuning_curve_stats", with_views("tracking", CURVE, """f AS (SELECT unit, sum(rate * cos((bin + 0.5) * (2 * pi() / 24))) AS c, sum(rate * sin((bin + 0.5) * (2 * pi() / 24))) AS s,
        sum(rate) AS v, max(rate) AS peak_rate, avg(rate) AS mean_rate FROM curve GROUP BY 1),
    k AS (SELECT curve.unit, min(bin) AS pk FROM curve JOIN f ON f.unit = curve.unit AND curve.rate = f.peak_rate GROUP BY 1),
    h AS (SELECT curve.unit, min((bin + 12 - pk + 24) % 24 - (12 - pk)) AS half_cw, max((bin + 12 - pk + 24) % 24 - (12 - pk)) + 1 AS half_ccw
        FROM curve JOIN f USING (unit) JOIN k USING (unit) WHERE rate >= peak_rate * 0.95 GROUP BY 1)""",
    """SELECT unit, round(atan2(s, c), 5) + 0.0 AS mean_direction, round((pk + 0.5) * (2 * pi() / 24), 6) + 0.0 AS peak_direction,
    round(peak_rate, 6) + 0.0 AS peak_rate, round(mean_rate, 6) + 0.0 AS mean_rate, round(sqrt(c * c + s * s) / v, 6) + 0.0 AS mvl,
    round(sqrt(2 * (1 - sqrt(c * c + s * s) / v)), 6) + 0.0 AS stdev, half_cw, half_ccw,
    round(1 - (half_ccw - half_cw) * (2 * pi() / 24) / pi(), 6) + 0.0 AS score FROM f JOIN k USING (unit) JOIN h USING (unit)"""))
def tuning_curve_stats(spark, d):
    st = O.tuning_curve_stats(curve(spark, d), ["unit"], 24)
    return st.select("unit", r("mean_direction", 5).alias("mean_direction"), *[r(c).alias(c) for c in ("peak_direction", "peak_rate", "mean_rate", "mvl", "stdev")],
                     "half_cw", "half_ccw", r("score").alias("score"))


@query("egocentric_map", with_views("tracking", """b AS (SELECT unit, x, y * 5 AS y, (pk % 8) * (2 * pi() / 8) + 0.1 AS h, count(*) AS c FROM tracking GROUP BY 1, 2, 3, 4),
    a AS (SELECT unit, x, y, c, k AS angle, fmod(k * (2 * pi() / 12) + h, 2 * pi()) AS a FROM b CROSS JOIN (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS k)),
    w AS (SELECT *, least((CASE WHEN abs(a - pi()) < pi() / 2 THEN 0.0 ELSE 51.0 END - x) / cos(a), (CASE WHEN a > pi() THEN -1.0 ELSE 51.0 END - y) / sin(a)) AS dist FROM a),
    e AS (SELECT sqrt(51.0 * 51.0 + 52.0 * 52.0) AS span)""",
    """SELECT unit, angle, CAST(least(floor(round(dist / (span / 20), 9)), 19) AS INTEGER) AS bin, CAST(sum(c) AS BIGINT) AS frames FROM w, e
    WHERE dist >= 0 AND dist <= span GROUP BY 1, 2, 3"""))
def egocentric_map(spark, d):
    t = S.tracking(spark, d).withColumn("y", F.col("y") * 5)
    heading = (F.col("pk") % 8) * F.lit(2 * math.pi / 8) + 0.1
    return O.egocentric_map(t, ["unit"], "x", "y", heading, 12, 20, ((0.0, 51.0), (-1.0, 51.0)))


@query("expand_events", with_views("spikes", "SELECT event_id, CAST(unnest(range(1, CAST(floor(value / 20) AS INTEGER) + 1)) AS INTEGER) AS rep FROM spikes WHERE value / 20 >= 1"))
def expand_events(spark, d):
    return O.expand_events(S.spikes(spark, d), F.col("value") / 20).select("event_id", "rep")


@query("activity_map_1d", with_views("tracking", "SELECT unit, CAST(floor(x) AS BIGINT) AS bin, round(avg(signal), 4) + 0.0 AS rate FROM tracking WHERE y > 2 GROUP BY 1, 2"))
def activity_map_1d(spark, d):
    return O.activity_map_1d(S.tracking(spark, d), ["unit"], F.floor("x"), "signal", F.col("y") > 2).withColumn("rate", r("rate", 4))


@query("order_by_peak", with_views("tracking", """a AS (SELECT unit, CAST(floor(x) AS BIGINT) AS bin, avg(signal) AS rate FROM tracking WHERE y > 2 GROUP BY 1, 2),
    k AS (SELECT unit, bin AS peak_bin, row_number() OVER (PARTITION BY unit ORDER BY rate DESC, bin) AS rk FROM a)""",
    "SELECT unit, peak_bin, CAST(row_number() OVER (ORDER BY peak_bin, unit) AS INTEGER) AS rank FROM k WHERE rk = 1"))
def order_by_peak(spark, d):
    m = O.activity_map_1d(S.tracking(spark, d), ["unit"], F.floor("x"), "signal", F.col("y") > 2)
    return O.order_by_peak(m, [], "unit").select("unit", "peak_bin", "rank")


BELT = """belt AS (SELECT unit, CAST(floor(x) AS BIGINT) AS bin, sum(signal) AS v FROM tracking GROUP BY 1, 2),
    g AS (SELECT u.unit, b.bin, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT unit FROM tracking) u CROSS JOIN (SELECT unnest(range(0, 51)) AS bin) b LEFT JOIN belt USING (unit, bin)),
    sm AS (SELECT unit, bin, sum(v) OVER (PARTITION BY unit ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS s FROM g),
    e AS (SELECT unit, min(s) AS lo, max(s) AS hi FROM sm GROUP BY 1)"""


@query("cell_session_average", with_views("tracking", BELT, "SELECT unit, bin, round((s - lo) / (hi - lo), 6) + 0.0 AS avg FROM sm JOIN e USING (unit) WHERE hi > lo"))
def cell_session_average(spark, d):
    from engram.operators.sequences import rolling_box
    from engram.operators.scaling import minmax_norm
    from engram.functions.blocks import densify
    belt = S.tracking(spark, d).groupBy("unit", F.floor("x").alias("bin")).agg(F.sum("signal").alias("v"))
    sm = rolling_box(densify(belt, ["unit"], "bin", {"v": "v"}), ["unit"], "bin", "v", 11, "s")
    return minmax_norm(sm, ["unit"], "s", "avg").select("unit", "bin", r("avg").alias("avg"))


@query("skaggs_1d", with_views("tracking", "m AS (SELECT unit, CAST(floor(x) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS seconds, avg(signal) AS rate FROM tracking GROUP BY 1, 2)",
    STATS, "SELECT unit, round(info_rate, 4) + 0.0 AS info_rate, round(info_rate / mr, 6) + 0.0 AS info_content FROM s1 JOIN s2 USING (unit)"))
def skaggs_1d(spark, d):
    m = S.tracking(spark, d).groupBy("unit", F.floor("x").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("seconds"), F.avg("signal").alias("rate"))
    return O.rate_map_stats(m, ["unit"]).select("unit", r("info_rate", 4).alias("info_rate"), r("info_content").alias("info_content"))
