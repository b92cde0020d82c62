"""Map geometry: smoothing, coherence, correlation of maps, fields, borders and grids."""

from pyspark.sql import functions as F

from engram.functions import kernels as K
from engram.functions.blocks import dealt
from engram.functions.exprs import rounded as r
from engram.operators import fields as D, maps as M, occupancy as O, pairs as P, signal as G
from engram.plans.q_maps import IX, IY, TMAP, ix, iy, unit_map
from engram.plans.q_pairs import P28
from engram.plans.registry import query
from engram.session import Rounds
from engram.sources import tables as S
from engram.sources.tables import with_views

SHAPE = (11, 21)
UNIT = ["unit"]
_W = K.gaussian(1.5)
_RAD = len(_W) // 2


def smooth_map(spark, d):
    return G.gauss_smooth(unit_map(spark, d).select("unit", "iy", "ix", "rate"), UNIT, "rate", 1.5, SHAPE)


def _fold(c, n):
    m = f"((({c}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END)"


SMOOTH = f"""kn(d, w) AS (VALUES {", ".join(f"({k - _RAD}, {v!r}::DOUBLE)" for k, v in enumerate(_W))}),
    row_s AS (SELECT u.unit, u.iy, g.ix, sum(kn.w * coalesce(m.rate, 0)) AS a FROM (SELECT DISTINCT unit, iy FROM m) u
        CROSS JOIN (SELECT unnest(range(0, 21)) AS ix) g CROSS JOIN kn LEFT JOIN m ON m.unit = u.unit AND m.iy = u.iy AND m.ix = {_fold('g.ix + kn.d', 21)} GROUP BY 1, 2, 3),
    sm AS (SELECT m.unit, m.iy, m.ix, any_value(m.rate) AS rate, sum(kn.w * coalesce(s.a, 0)) AS smooth FROM m CROSS JOIN kn
        LEFT JOIN row_s s ON s.unit = m.unit AND s.ix = m.ix AND s.iy = {_fold('m.iy + kn.d', 11)} GROUP BY 1, 2, 3)"""


@query("gauss_smooth", with_views("tracking", TMAP, SMOOTH, "SELECT unit, iy, ix, round(smooth, 6) + 0.0 AS smooth FROM sm"))
def gauss_smooth(spark, d):
    return smooth_map(spark, d).select("unit", "iy", "ix", r("smooth").alias("smooth"))


@query("coherence", with_views("tracking", TMAP, """g AS (SELECT u.unit, y.iy, x.ix, coalesce(m.rate, 0) AS v FROM (SELECT DISTINCT unit FROM m) u CROSS JOIN (SELECT unnest(range(0, 11)) AS iy) y
        CROSS JOIN (SELECT unnest(range(0, 21)) AS ix) x LEFT JOIN m ON m.unit = u.unit AND m.iy = y.iy AND m.ix = x.ix),
    nb AS (SELECT g.unit, g.iy, g.ix, any_value(g.v) AS v, coalesce(sum(h.v), 0) / 8 AS a FROM g LEFT JOIN g h ON h.unit = g.unit AND abs(h.iy - g.iy) <= 1 AND abs(h.ix - g.ix) <= 1
        AND NOT (h.iy = g.iy AND h.ix = g.ix) GROUP BY 1, 2, 3)""", "SELECT unit, round(corr(v, a), 6) + 0.0 AS coherence FROM nb GROUP BY 1"))
def coherence(spark, d):
    return M.coherence(unit_map(spark, d), UNIT, "rate", SHAPE).withColumn("coherence", r("coherence"))


HALF = f"""hm AS (SELECT unit, ok % 2 AS half, {IY} AS iy, {IX} AS ix, avg(signal) AS rate FROM tracking GROUP BY 1, 2, 3, 4),
    j AS (SELECT a.unit, a.iy, a.ix, a.rate AS a, b.rate AS b FROM hm a JOIN hm b ON a.unit = b.unit AND a.iy = b.iy AND a.ix = b.ix AND a.half = 0 AND b.half = 1)"""


def halves(spark, d):
    t = S.tracking(spark, d)
    return [O.tuning_map(t.filter(F.col("ok") % 2 == h), UNIT, ix(), iy(), "signal").select("unit", "iy", "ix", "rate") for h in (0, 1)]


@query("map_cross_corr", with_views("tracking", HALF, "SELECT unit, round(corr(a, b), 6) + 0.0 AS r, count(*) AS n FROM j GROUP BY 1"))
def map_cross_corr(spark, d):
    return P.map_cross_corr(*halves(spark, d), UNIT, "rate").withColumn("r", r("r"))


@query("map_cross_corr_rows", with_views("tracking", HALF, "SELECT unit, iy, round(corr(a, b), 6) + 0.0 AS r, count(*) AS n FROM j GROUP BY 1, 2 HAVING count(*) >= 3"))
def map_cross_corr_rows(spark, d):
    return P.map_cross_corr(*halves(spark, d), UNIT, "rate", ["iy"]).filter("n >= 3").withColumn("r", r("r"))


@query("pv_corr", with_views("tracking", HALF, "SELECT iy, ix, round(corr(a, b), 6) + 0.0 AS r, count(*) AS n FROM j GROUP BY 1, 2"))
def pv_corr(spark, d):
    return P.pv_corr(*halves(spark, d), "unit", "rate")[1].withColumn("r", r("r"))


@query("pv_corr_rows", with_views("tracking", HALF, "SELECT iy, round(corr(a, b), 6) + 0.0 AS r, count(*) AS n FROM j GROUP BY 1"))
def pv_corr_rows(spark, d):
    return P.pv_corr(*halves(spark, d), "unit", "rate")[0].withColumn("r", r("r"))


CHALF = f"""hc AS (SELECT unit, ok % 2 AS half, CAST(floor((y - 0) / 3) AS INTEGER) AS iy, CAST(floor((x - 1) / 10) AS INTEGER) AS ix, avg(signal) AS rate FROM tracking GROUP BY 1, 2, 3, 4)"""


@query("pv_corr_matrix", with_views("tracking", CHALF, """SELECT a.iy, a.ix, b.iy AS iy2, b.ix AS ix2, CASE WHEN stddev_pop(a.rate) > 1e-9 AND stddev_pop(b.rate) > 1e-9 THEN round(corr(a.rate, b.rate), 6) + 0.0 END AS r, count(*) AS n
    FROM hc a JOIN hc b ON a.unit = b.unit AND a.half = 0 AND b.half = 1 GROUP BY 1, 2, 3, 4"""))
def pv_corr_matrix(spark, d):
    t, cx, cy = S.tracking(spark, d), F.floor((F.col("x") - 1) / 10).cast("int"), F.floor(F.col("y") / 3).cast("int")
    first, second = (O.tuning_map(t.filter(F.col("ok") % 2 == h), UNIT, cx, cy, "signal").select("unit", "iy", "ix", "rate") for h in (0, 1))
    return P.pv_matrix(first, second, "unit", "rate").withColumn("r", r("r"))


# Sessions are years; a map has 30 bins, so that p is the finite sum of 28 degrees of freedom.
@query("pairwise_session_corr", with_views("tracking", """mb AS (SELECT unit, t // 365 AS session, CAST(floor((x - 1) * 0.6) AS INTEGER) AS bin, avg(signal) AS rate FROM tracking GROUP BY 1, 2, 3),
    gr AS (SELECT s.unit, s.session, b.bin, coalesce(rate, 0.0) AS rate FROM (SELECT DISTINCT unit, session FROM mb) s CROSS JOIN (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin) b LEFT JOIN mb USING (unit, session, bin)),
    rl AS (SELECT a.unit, a.session AS first, c.session AS second, (a.bin - c.bin + 30) % 30 AS s, a.rate AS x, c.rate AS y FROM gr a JOIN gr c ON a.unit = c.unit AND a.session < c.session),
    rr AS (SELECT unit, first, second, s, corr(x, y) AS r FROM rl GROUP BY 1, 2, 3, 4),
    bs AS (SELECT unit, first, second, max(r) FILTER (WHERE s = 0) AS r, max(r) AS best_r, arg_max(s, (round(r, 9), -s)) AS best_shift FROM rr GROUP BY 1, 2, 3),
    pk AS (SELECT unit, session, arg_max(bin, (rate, -bin)) AS peak FROM gr GROUP BY 1, 2)""",
    f"""SELECT unit, first, second, round(r, 6) + 0.0 AS r, round({P28}, 6) + 0.0 AS p, p1.peak AS peak_first, p2.peak AS peak_second, p1.peak - p2.peak AS shift, CAST(best_shift AS INTEGER) AS best_shift, round(best_r, 6) + 0.0 AS best_r
    FROM bs JOIN pk p1 USING (unit) JOIN pk p2 USING (unit) WHERE p1.session = first AND p2.session = second AND {P28} < 0.2 AND abs(r) > 0.1"""))
def pairwise_session_corr(spark, d):
    t = S.tracking(spark, d).withColumn("session", F.expr("t div 365"))
    maps = t.groupBy("unit", "session", F.floor((F.col("x") - 1) * 0.6).cast("int").alias("bin")).agg(F.avg("signal").alias("rate"))
    out = P.session_pair_corr(maps, "unit", "session", "bin", "rate", 30, alpha=0.2, r_min=0.1)
    return out.withColumns({c: r(c) for c in ("r", "p", "best_r")})


@query("unscramble_segments", with_views("tracking", "b AS (SELECT unit, CAST(floor(x) AS BIGINT) AS bin, count(*) AS n FROM tracking GROUP BY 1, 2)",
    "SELECT unit, CASE WHEN bin // 10 < 5 THEN CASE bin // 10 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 3 END * 10 + bin % 10 ELSE bin END AS bin, n FROM b"))
def unscramble_segments(spark, d):
    b = S.tracking(spark, d).groupBy("unit", F.floor("x").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return M.unscramble_segments(b, "bin", [1, 3, 0, 4, 2], 10)


ACORR = """g AS (SELECT u.unit, y.iy, x.ix, coalesce(m.rate, 0) AS v FROM (SELECT DISTINCT unit FROM m) u CROSS JOIN (SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS iy) y
        CROSS JOIN (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS ix) x LEFT JOIN m ON m.unit = u.unit AND m.iy = y.iy AND m.ix = x.ix),
    ac AS (SELECT a.unit, a.iy - b.iy AS dy, a.ix - b.ix AS dx, count(*) AS n, sum(a.v) AS sa, sum(b.v) AS sb, sum(a.v * a.v) AS saa, sum(b.v * b.v) AS sbb, sum(a.v * b.v) AS sab
        FROM g a JOIN g b ON a.unit = b.unit WHERE abs(a.iy - b.iy) <= 9 AND abs(a.ix - b.ix) <= 18 GROUP BY 1, 2, 3)"""


def acorr(spark, d):
    return D.autocorrelogram(unit_map(spark, d).select("unit", "iy", "ix", "rate"), UNIT, "rate", SHAPE)


@query("autocorrelogram", with_views("tracking", TMAP, ACORR, """SELECT unit, dy, dx, round(CASE WHEN (saa - sa * sa / n) > 1e-9 AND (sbb - sb * sb / n) > 1e-9
    THEN (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) ELSE 0 END, 5) + 0.0 AS r FROM ac"""))
def autocorrelogram(spark, d):
    return acorr(spark, d).withColumn("r", r("r", 5))


COARSE = (11, 10)


def coarse_acorr(spark, d):
    """Autocorrelogram of coarse maps that have hardly any unvisited bin, smooth enough to have a centre field."""
    m = O.tuning_map(dealt(S.tracking(spark, d), "unit")[0], UNIT, F.floor((F.col("x") - 1) / 5).cast("int"), iy(), "signal").select("unit", "iy", "ix", "rate")
    sm = G.gauss_smooth(m, UNIT, "rate", 3.0, COARSE).select("unit", "iy", "ix", "smooth")
    return D.autocorrelogram(sm, UNIT, "smooth", COARSE)


@query("grid_score")
def grid_score(spark, d):
    return D.grid_score(coarse_acorr(spark, d), UNIT).withColumn("score", r("score", 4))


def _grid_peaks(spark, d):
    # scores and peaks read the same autocorrelograms, which are made once
    ac = Rounds(spark, "acorr").write("acorr", coarse_acorr(spark, d))
    return D.grid_peaks(ac, D.grid_score(ac, UNIT), UNIT, 0)


@query("nearest6")
def nearest6(spark, d):
    return M.nearest6(_grid_peaks(spark, d), UNIT).select("unit", "dy", "dx", r("distance").alias("distance"), r("angle").alias("angle"), "rank")


@query("grid_stats")
def grid_stats(spark, d):
    return M.grid_stats(_grid_peaks(spark, d), UNIT).select("unit", *[r(c).alias(c) for c in ("spacing", "orientation", "orientation_sd")])


@query("local_maxima", with_views("tracking", TMAP, SMOOTH, """SELECT unit, iy, ix, round(smooth, 6) + 0.0 AS smooth FROM sm a WHERE smooth > 0
    AND NOT EXISTS (SELECT 1 FROM sm b WHERE b.unit = a.unit AND abs(b.iy - a.iy) <= 1 AND abs(b.ix - a.ix) <= 1 AND b.smooth > a.smooth)"""))
def local_maxima(spark, d):
    return D.local_maxima(smooth_map(spark, d).select("unit", "iy", "ix", "smooth"), UNIT, "smooth", SHAPE, 0).withColumn("smooth", r("smooth"))


def grown(spark, d):
    sm = smooth_map(spark, d).select("unit", "iy", "ix", "smooth")
    return D.place_fields(sm, UNIT, "smooth", SHAPE, clear=0, min_bins=5)


@query("place_fields")
def place_fields(spark, d):
    return grown(spark, d).withColumn("smooth", r("smooth"))


# Simple fields for the operators that start from labelled bins: busy bins, one label per quadrant.
FLD = """mr AS (SELECT unit, avg(rate) AS mu FROM m GROUP BY 1),
    fl AS (SELECT unit, CAST(CASE WHEN iy >= 6 THEN 2 ELSE 0 END + CASE WHEN ix >= 10 THEN 1 ELSE 0 END AS INTEGER) AS field, iy, ix, rate FROM m JOIN mr USING (unit) WHERE rate >= 1.3 * mu)"""


def quadrants(spark, d):
    m = unit_map(spark, d)
    mu = m.groupBy("unit").agg(F.avg("rate").alias("mu"))
    label = F.when(F.col("iy") >= 6, 2).otherwise(0) + F.when(F.col("ix") >= 10, 1).otherwise(0)
    return m.join(mu, "unit").filter(F.col("rate") >= F.col("mu") * 1.3).select("unit", label.alias("field"), "iy", "ix", "rate")


@query("field_props", with_views("tracking", TMAP, FLD, """k AS (SELECT *, row_number() OVER (PARTITION BY unit, field ORDER BY rate DESC, iy, ix) AS rk FROM fl)""",
    """SELECT unit, field, count(*) AS area, min(iy) AS y0, min(ix) AS x0, max(iy) + 1 AS y1, max(ix) + 1 AS x1, round(avg(iy), 6) + 0.0 AS cy, round(avg(ix), 6) + 0.0 AS cx,
    round(avg(rate), 6) + 0.0 AS mean_rate, round(max(rate), 6) + 0.0 AS peak_rate, max(iy) FILTER (WHERE rk = 1) AS peak_iy, max(ix) FILTER (WHERE rk = 1) AS peak_ix FROM k GROUP BY 1, 2"""))
def field_props(spark, d):
    p = M.field_props(quadrants(spark, d), ["unit", "field"], "rate")
    return p.withColumns({c: r(c) for c in ("cy", "cx", "mean_rate", "peak_rate")})


@query("place_field_props")
def place_field_props(spark, d):
    p = M.field_props(grown(spark, d), ["unit", "field"], "smooth")
    return p.withColumns({c: r(c) for c in ("cy", "cx", "mean_rate", "peak_rate")})


WALLS = """vw AS (SELECT unit, w.wall, CASE w.wall WHEN 'l' THEN iy WHEN 'r' THEN iy ELSE ix END AS line, CASE w.wall WHEN 'l' THEN ix WHEN 'r' THEN 20 - ix WHEN 'b' THEN iy ELSE 10 - iy END AS depth, iy, ix
        FROM m CROSS JOIN (VALUES ('l'), ('r'), ('t'), ('b')) w(wall)),
    fs AS (SELECT unit, wall, line, min(depth) AS depth FROM vw WHERE depth < 4 GROUP BY 1, 2, 3),
    cv AS (SELECT vw.unit, fl.field, vw.wall, count(*) AS c FROM fs JOIN vw USING (unit, wall, line, depth) JOIN fl ON fl.unit = vw.unit AND fl.iy = vw.iy AND fl.ix = vw.ix GROUP BY 1, 2, 3),
    tt AS (SELECT unit, wall, count(*) AS n FROM fs GROUP BY 1, 2),
    bc AS (SELECT u.unit, coalesce(max(c / n), 0.0) AS coverage FROM (SELECT DISTINCT unit FROM m) u LEFT JOIN cv ON cv.unit = u.unit LEFT JOIN tt ON tt.unit = cv.unit AND tt.wall = cv.wall GROUP BY 1),
    wf AS (SELECT unit, 2 * sum(least(ix + 1, 21 - ix, iy + 1, 11 - iy) * rate) / sum(rate) / 11 AS wfd FROM fl GROUP BY 1)"""


@query("border_coverage", with_views("tracking", TMAP, FLD, WALLS, "SELECT unit, round(coverage, 6) + 0.0 AS coverage FROM bc"))
def border_coverage(spark, d):
    return M.border_coverage(unit_map(spark, d), quadrants(spark, d), UNIT, "field", SHAPE, 4).withColumn("coverage", r("coverage"))


@query("border_score", with_views("tracking", TMAP, FLD, WALLS, "SELECT unit, round(CASE WHEN wfd IS NULL THEN -1 ELSE (coverage - wfd) / (coverage + wfd) END, 6) + 0.0 AS score, round(coverage, 6) + 0.0 AS coverage FROM bc LEFT JOIN wf USING (unit)"))
def border_score(spark, d):
    out = M.border_score(unit_map(spark, d), quadrants(spark, d), UNIT, "field", "rate", SHAPE, 4)
    return out.select("unit", r("score").alias("score"), r("coverage").alias("coverage"))


HF = """hq AS (SELECT unit, half, iy, ix FROM hm JOIN (SELECT unit AS u, half AS h, avg(rate) AS mu FROM hm GROUP BY 1, 2) ON u = unit AND h = half WHERE rate >= 1.1 * mu)"""


def half_fields(spark, d):
    t = S.tracking(spark, d).withColumn("half", F.col("ok") % 2)
    m = O.tuning_map(t, ["unit", "half"], ix(), iy(), "signal")
    mu = m.groupBy("unit", "half").agg(F.avg("rate").alias("mu"))
    return m.join(mu, ["unit", "half"]).filter(F.col("rate") >= F.col("mu") * 1.1).select("unit", "half", "iy", "ix")


@query("field_overlap", with_views("tracking", HALF, HF, """u AS (SELECT unit, iy, ix, max(CASE WHEN half = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN half = 1 THEN 1 ELSE 0 END) AS b FROM hq GROUP BY 1, 2, 3)""",
    "SELECT unit, CAST(sum(a * b) AS BIGINT) AS shared, round(sum(a * b) / greatest(sum(a), sum(b)), 6) + 0.0 AS overlap FROM u GROUP BY 1"))
def field_overlap(spark, d):
    return P.field_overlap(half_fields(spark, d), UNIT, "half", 0, 1).withColumn("overlap", r("overlap"))


@query("field_redundancy", with_views("tracking", HALF, HF, "c AS (SELECT iy, ix, count(DISTINCT unit) AS cells FROM hq GROUP BY 1, 2)", "SELECT cells, count(*) AS bins FROM c GROUP BY 1"))
def field_redundancy(spark, d):
    return P.field_redundancy(half_fields(spark, d), [], "unit")[1]


@query("footprint_maps", with_views("tracking", """p AS (SELECT unit AS cell_id, pk % 64 AS x, ok % 64 AS y, sum(signal) AS lam FROM tracking GROUP BY 1, 2, 3), e AS (SELECT cell_id, min(lam) AS lo, max(lam) AS hi FROM p GROUP BY 1)""",
    "SELECT cell_id, x, y, round((lam - lo) / (hi - lo), 6) + 0.0 AS w FROM p JOIN e USING (cell_id)"))
def footprint_maps(spark, d):
    p = (S.tracking(spark, d).groupBy(F.col("unit").alias("cell_id"), (F.col("pk") % 64).alias("x"), (F.col("ok") % 64).alias("y")).agg(F.sum("signal").alias("lam")))
    return M.footprint_maps(p, ["cell_id"], "lam").select("cell_id", "x", "y", r("w").alias("w"))
