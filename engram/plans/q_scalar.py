"""Projections and filters."""

from pyspark.sql import functions as F

from engram.functions import exprs as X
from engram.functions.blocks import frame_block
from engram.functions.exprs import rounded as r
from engram.operators import filters, scaling
from engram.plans.registry import query
from engram.sources import tables as S
from engram.sources.tables import with_views

ID = ["unit", "t", "ok", "ln", "pk"]
IDS = ", ".join(ID)


def _sql(expr, views="tracking", src="tracking", tail=""):
    return with_views(views, f"SELECT {IDS}, {expr} FROM {src} {tail}")


def _tracked(make, *names):
    """Query that adds the columns built by ``make`` to every tracking row."""
    def build(spark, d):
        made = make()
        made = made if isinstance(made, tuple) else (made,)
        return S.tracking(spark, d).select(*ID, *[c.alias(n) for n, c in zip(names, made)])
    return build


def _both(pair):
    return tuple(r(c) for c in pair)


@query("dff", with_views("tracking", f"""SELECT {IDS}, round((signal - f0) / f0, 6) + 0.0 AS dff
    FROM tracking JOIN (SELECT unit AS u, abs(median(signal)) AS f0 FROM tracking GROUP BY 1) ON u = unit"""))
def dff(spark, d):
    return scaling.dff(S.tracking(spark, d), ["unit"], "signal").select(*ID, r("dff").alias("dff"))


@query("standardize", with_views("tracking", f"""SELECT {IDS}, round((signal - m) / rng, 6) + 0.0 AS std
    FROM tracking JOIN (SELECT unit AS u, median(signal) AS m, max(signal) - min(signal) AS rng FROM tracking GROUP BY 1) ON u = unit"""))
def standardize(spark, d):
    return scaling.standardize(S.tracking(spark, d), ["unit"], "signal").select(*ID, r("std").alias("std"))


@query("minmax_norm", with_views("tracking", f"""SELECT {IDS}, round(CASE WHEN hi = lo THEN signal ELSE (signal - lo) / (hi - lo) END, 6) + 0.0 AS norm
    FROM tracking JOIN (SELECT unit AS u, min(signal) AS lo, max(signal) AS hi FROM tracking GROUP BY 1) ON u = unit"""))
def minmax_norm(spark, d):
    return scaling.minmax_norm(S.tracking(spark, d), ["unit"], "signal").select(*ID, r("norm").alias("norm"))


@query("rescale_arena", with_views("tracking", f"""SELECT {IDS}, round((x - x0) / (x1 - x0) * 80, 6) + 0.0 AS xs,
    round((y - y0) / (y1 - y0) * 80, 6) + 0.0 AS ys
    FROM tracking CROSS JOIN (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM tracking)"""))
def rescale_arena(spark, d):
    return scaling.rescale_arena(S.tracking(spark, d), "x", "y", (80.0, 80.0)).select(*ID, r("xs").alias("xs"), r("ys").alias("ys"))


@query("px_to_cm", with_views("tracking", f"""SELECT {IDS}, round((x - x0) / ((x1 - x0) / 80.0), 6) + 0.0 AS xc,
    round((y - y0) / ((x1 - x0) / 80.0), 6) + 0.0 AS yc
    FROM tracking CROSS JOIN (SELECT min(x) x0, max(x) x1, min(y) y0 FROM tracking)"""))
def px_to_cm(spark, d):
    return scaling.px_to_cm(S.tracking(spark, d), "x", "y", 80.0).select(*ID, r("xc").alias("xc"), r("yc").alias("yc"))


query("cart2pol", _sql("round(sqrt(x*x + y*y), 6) + 0.0 AS rho, round(atan2(y, x), 6) + 0.0 AS phi"))(
    _tracked(lambda: _both(X.cart2pol("x", "y")), "rho", "phi"))
query("pol2cart", _sql("round(x * cos(y), 6) + 0.0 AS px, round(x * sin(y), 6) + 0.0 AS py"))(_tracked(lambda: _both(X.pol2cart("x", "y")), "px", "py"))
query("wheel_xy", _sql("round(0.1 * cos((ok % 500) * (2 * pi() / 500)), 6) + 0.0 AS wx, round(0.1 * sin((ok % 500) * (2 * pi() / 500)), 6) + 0.0 AS wy"))(
    _tracked(lambda: _both(X.wheel_xy("ok", 500, 0.1)), "wx", "wy"))
query("point_on_circle", _sql("round(100 * cos(x), 6) + 0.0 AS cx, round(100 * sin(x), 6) + 0.0 AS cy"))(_tracked(lambda: _both(X.point_on_circle("x")), "cx", "cy"))
query("bin_floor", _sql("CAST(floor(x / 2.5) AS BIGINT) AS bin"))(_tracked(lambda: X.bin_floor("x", 2.5), "bin"))
query("grid_partition", _sql("""CAST(CASE WHEN x >= 0 AND x < 50 AND y * 5 >= 0 AND y * 5 < 50
    THEN floor(x / 10) * 5 + floor(y * 5 / 10) ELSE 0 END AS BIGINT) AS square"""))(
    _tracked(lambda: X.grid_partition("x", F.col("y") * 5, 50.0, 10.0), "square"))
query("partition_center", with_views("tracking", f"""q AS (SELECT *, CASE WHEN x >= 0 AND x < 50 AND y * 5 >= 0 AND y * 5 < 50
    THEN floor(x / 10) * 5 + floor(y * 5 / 10) ELSE 0 END AS s FROM tracking)""",
    f"SELECT {IDS}, CAST((floor(s / 5) + 0.5) * 10 AS DOUBLE) AS sx, CAST((s % 5 + 0.5) * 10 AS DOUBLE) AS sy FROM q"))(
    _tracked(lambda: _both(X.partition_center(X.grid_partition("x", F.col("y") * 5, 50.0, 10.0), 50.0, 10.0)), "sx", "sy"))
query("head_angle", _sql("""round(atan2((x - 25) * (pk % 11 - y) - (y - 5) * (pk % 50 - x) + 0.0,
    (x - 25) * (pk % 50 - x) + (y - 5) * (pk % 11 - y) + 0.0), 6) + 0.0 AS angle"""))(
    _tracked(lambda: r(X.signed_angle(F.col("x") - 25, F.col("y") - 5, F.col("pk") % 50 - F.col("x"), F.col("pk") % 11 - F.col("y"))), "angle"))
query("mirror_shift_angle", _sql("""round(CASE WHEN (x - 25) * 7.2 < 0 THEN (x - 25) * 7.2 + 180 ELSE (x - 25) * 7.2 END, 6) + 0.0 AS angle"""))(
    _tracked(lambda: r(X.mirror_shift((F.col("x") - 25) * F.lit(7.2))), "angle"))
query("power_log", _sql("round(20 * log10(signal), 6) + 0.0 AS db"))(_tracked(lambda: r(X.decibel("signal")), "db"))
query("walk_filter", _sql("x, y, signal", tail="WHERE x >= 20"))(
    lambda spark, d: filters.walk_filter(S.tracking(spark, d), "x", 20.0, ["y", "signal"]).select(*ID, "x", "y", "signal"))
query("mobile_split", _sql("x > 5 AS mobile"))(
    lambda spark, d: filters.mobile_split(S.tracking(spark, d), "x", 5.0).select(*ID, "mobile"))
query("run_quiescent", _sql("CASE WHEN x > 40 THEN 'running' ELSE 'quiescent' END AS state", tail="WHERE x > 40 OR x <= 5"))(
    lambda spark, d: filters.run_quiescent(S.tracking(spark, d), "x", 40.0, 5.0).select(*ID, "state"))


@query("nbins", with_views("tracking", "SELECT unit, CAST(ceil((max(x) - min(x)) / 2.5) AS BIGINT) AS bins FROM tracking GROUP BY 1"))
def nbins(spark, d):
    return (S.tracking(spark, d).groupBy("unit").agg((F.max("x") - F.min("x")).alias("len"))
            .select("unit", X.nbins("len", 2.5).alias("bins")))


@query("decode_error", with_views("tracking", f"""SELECT {IDS}, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 6) + 0.0 AS err
    FROM tracking JOIN (SELECT unit AS u, avg(x) AS mx, avg(y) AS my FROM tracking GROUP BY 1) ON u = unit"""))
def decode_error(spark, d):
    t = S.tracking(spark, d)
    pred = t.groupBy("unit").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return t.join(pred, "unit").select(*ID, r(X.euclid("x", "y", "mx", "my")).alias("err"))


@query("scale_by_dff", with_views("activity", "SELECT cell_id, frame, round((CASE WHEN n >= 2 THEN 1 ELSE 0 END) * f, 6) + 0.0 AS scaled FROM activity"))
def scale_by_dff(spark, d):
    return S.activity(spark, d).select("cell_id", "frame", r(F.when(F.col("n") >= 2, F.col("f")).otherwise(0.0)).alias("scaled"))


@query("binarize_ttl", with_views("spikes", "SELECT event_id, CASE WHEN value >= 2.5 THEN 1 ELSE 0 END AS ttl FROM spikes"))
def binarize_ttl(spark, d):
    return S.spikes(spark, d).select("event_id", F.when(F.col("value") >= 2.5, 1).otherwise(0).alias("ttl"))


@query("upsample_int", with_views("tracking", """m AS (SELECT unit, CAST(y AS INTEGER) AS iy, CAST(floor(x / 5) AS INTEGER) AS ix, count(*) AS v FROM tracking GROUP BY 1, 2, 3)""",
    """SELECT unit, iy * 2 + dy AS iy, ix * 2 + dx AS ix, v FROM m CROSS JOIN (VALUES (0), (1)) a(dy) CROSS JOIN (VALUES (0), (1)) b(dx)"""))
def upsample_int(spark, d):
    m = (S.tracking(spark, d).groupBy("unit", F.col("y").cast("int").alias("iy"), F.floor(F.col("x") / 5).cast("int").alias("ix"))
         .agg(F.count(F.lit(1)).alias("v")))
    return scaling.upsample_int(m, 2)


@query("circular_mask", with_views("tracking", """SELECT unit, x, y * 5 AS y,
    round(sqrt((x - 25) * (x - 25) + (y * 5 - 25) * (y * 5 - 25)), 6) + 0.0 AS dist,
    round(CASE WHEN atan2(y * 5 - 25, x - 25) < 0 THEN degrees(atan2(y * 5 - 25, x - 25)) + 360 ELSE degrees(atan2(y * 5 - 25, x - 25)) END, 6) + 0.0 AS angle,
    sqrt((x - 25) * (x - 25) + (y * 5 - 25) * (y * 5 - 25)) <= 20 AS inside
    FROM (SELECT DISTINCT unit, x, y FROM tracking)"""))
def circular_mask(spark, d):
    bins = S.tracking(spark, d).select("unit", "x", (F.col("y") * 5).alias("y")).distinct()
    out = scaling.circular_mask(bins, "x", "y", 40.0, F.lit(25.0), F.lit(25.0))
    return out.select("unit", "x", "y", r("dist").alias("dist"), r("angle").alias("angle"), "inside")


@query("state_restrict", with_views("activity", """fr AS (SELECT frame FROM activity GROUP BY 1 HAVING count(*) > 13)""",
    "SELECT cell_id, frame, round(f, 4) AS f FROM activity WHERE frame IN (SELECT frame FROM fr)"))
def state_restrict(spark, d):
    a = S.activity(spark, d)
    busy = a.groupBy("frame").agg(F.count(F.lit(1)).alias("c")).filter("c > 13")
    return filters.state_restrict(a, busy, ["frame"]).select("cell_id", "frame", r("f", 4).alias("f"))


@query("active_frames", with_views("activity", "SELECT frame, CAST(sum(n) AS BIGINT) AS total FROM activity GROUP BY 1 HAVING sum(n) >= 15"))
def active_frames(spark, d):
    return filters.active_frames(S.activity(spark, d), ["frame"], "n", 15)


@query("active_cells", with_views("activity", """c AS (SELECT cell_id FROM activity GROUP BY 1 HAVING sum(n) >= 70)""",
    "SELECT cell_id, frame, n FROM activity WHERE cell_id IN (SELECT cell_id FROM c)"))
def active_cells(spark, d):
    return filters.active_cells(S.activity(spark, d), ["cell_id"], ["frame"], "n", 70).select("cell_id", "frame", "n")


@query("preprocess_bayes", with_views("activity", """c AS (SELECT cell_id FROM activity GROUP BY 1 HAVING sum(n) >= 60),
    k AS (SELECT * FROM activity WHERE cell_id IN (SELECT cell_id FROM c))""",
    "SELECT frame, count(*) AS cells, CAST(sum(n) AS BIGINT) AS spikes FROM k GROUP BY 1"))
def preprocess_bayes(spark, d):
    kept = filters.active_cells(S.activity(spark, d), ["cell_id"], ["frame"], "n", 60)
    return kept.groupBy("frame").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("spikes"))


@query("split_data_range", with_views("activity", """p AS (SELECT * FROM activity WHERE frame >= 100 AND frame < 400),
    c AS (SELECT cell_id FROM p GROUP BY 1 HAVING sum(n) > 0)""", "SELECT cell_id, frame, n FROM p WHERE cell_id IN (SELECT cell_id FROM c)"))
def split_data_range(spark, d):
    return filters.split_data_range(S.activity(spark, d), "frame", ["cell_id"], "n", 100, 400).select("cell_id", "frame", "n")


@query("speed_bandpass", with_views("tracking", """e AS (SELECT unit, min(x) AS lo, CAST(ceil(round((max(x) - min(x)) / 0.2, 9)) AS BIGINT) AS ne FROM tracking GROUP BY 1),
    h AS (SELECT unit, lo, ne, least(CAST(floor(round((x - lo) / 0.2, 9)) AS BIGINT), ne - 2) AS i, count(*) AS c
          FROM tracking JOIN e USING (unit) WHERE ne > 1 AND x <= lo + (ne - 1) * 0.2 GROUP BY 1, 2, 3, 4),
    g AS (SELECT unit, lo, ne, unnest(range(0, ne - 11)) AS j FROM e WHERE ne > 11),
    b AS (SELECT g.unit, g.lo, g.j, sum(c) AS c FROM g JOIN h ON h.unit = g.unit AND h.i BETWEEN g.j AND g.j + 9 GROUP BY 1, 2, 3 HAVING sum(c) >= 10),
    u AS (SELECT unit, max(j) AS j, any_value(lo) AS lo FROM b GROUP BY 1)""",
    f"SELECT {IDS}, x, round(lo + (j - 4) * 0.2, 6) + 0.0 AS upper_speed FROM tracking LEFT JOIN u USING (unit) WHERE j IS NULL OR (x >= 2 AND x <= lo + (j - 4) * 0.2)"))
def speed_bandpass(spark, d):
    return filters.speed_bandpass(S.tracking(spark, d), ["unit"], "x", "adaptive", frames_needed=10, missing="keep").select(*ID, "x", r("upper_speed").alias("upper_speed"))


@query("nonvisited_drop", with_views("tracking", """p AS (SELECT *, x + (pk % 7) * 10 AS px FROM tracking),
    tr AS (SELECT DISTINCT px AS tx, y AS ty FROM p WHERE ok % 5 < 2 AND pk % 7 < 5)""",
    f"""SELECT {IDS}, px, y FROM p WHERE ok % 5 >= 2 AND EXISTS (SELECT 1 FROM tr WHERE sqrt((px - tx) * (px - tx) + (y - ty) * (y - ty)) <= 3)"""))
def nonvisited_drop(spark, d):
    p = S.tracking(spark, d).withColumn("px", F.col("x") + (F.col("pk") % 7) * 10)
    train = p.filter("ok % 5 < 2 and pk % 7 < 5")
    return filters.nonvisited_drop(p.filter("ok % 5 >= 2"), train, "px", "y", 3.0).select(*ID, "px", "y")


@query("train_test_split", with_views("track", """n AS (SELECT session, count(*) AS n FROM track GROUP BY 1)""",
    "SELECT session, frame, CASE WHEN frame < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM track JOIN n USING (session)"))
def train_test_split(spark, d):
    return filters.train_test_split(S.track(spark, d), ["session"], ["frame"], frame_block()).select("session", "frame", "part")
