"""Sequence operators on traces, tracks and wheel clicks."""

import math

from pyspark.sql import functions as F

from engram.functions import kernels as K
from engram.functions.blocks import dealt, frame_block
from engram.functions.exprs import rounded as r
from engram.operators import sequences as Q, signal as G
from engram.plans.registry import query
from engram.sources import tables as S
from engram.sources.tables import with_views

CELL = ["cell_id"]
SES = ["session"]
BLOCK = frame_block
PARTS = 4096   # rows of a frame whose median one aggregation holds
MINUTE = S.MINUTE_US


def minute():
    return F.floor(F.col("t_us") / MINUTE).cast("long")


def kernel_sql(weights, first):
    return "k(lag, w) AS (VALUES " + ", ".join(f"({first + i}, {v!r}::DOUBLE)" for i, v in enumerate(weights)) + ")"


def conv_sql(name, weights, first, renorm, src="traces", key="cell_id", value="f"):
    """Gather form of a convolution."""
    div = " / sum(k.w)" if renorm else ""
    return f"""{name} AS (SELECT t.{key}, t.frame, sum(k.w * s.{value}){div} AS {name} FROM {src} t CROSS JOIN k
        JOIN {src} s ON s.{key} = t.{key} AND s.frame = t.frame + k.lag GROUP BY 1, 2)"""


def filtered_sql(name, top, bottom, src="traces", key="cell_id", value="f", zero_phase=True, renorm=False, pad=0):
    """A digital filter as the recursion it is: top and bottom are SQL lists of its coefficients, bottom[1] = 1.

    Zero-phase filters run forward over the trace and ``pad`` zeros, and then back; ``pad`` lets the response die out."""
    def run(to, start):
        return f"""{to}_r AS (SELECT *, 0 AS i, CAST(NULL AS DOUBLE) AS y, list_transform(range(len({top}) - 1), lambda q: 0.0::DOUBLE) AS h FROM {start}
        UNION ALL SELECT {key}, chan, arr, i + 1, y2, list_concat([y2], h[1:len(h) - 1]) FROM (SELECT {key}, chan, arr, i, h,
            list_dot_product(list_reverse({top}), list_concat(list_transform(range(len({top})), lambda q: 0.0::DOUBLE), arr)[i + 2:i + 1 + len({top})]) - list_dot_product(({bottom})[2:], h) AS y2
            FROM {to}_r WHERE i < len(arr)) s)"""
    zeros = f"list_transform(range({pad}), lambda q: 0.0::DOUBLE)"
    parts = [f"""{name}_0 AS (SELECT {key}, 'x' AS chan, list_concat(list({value}::DOUBLE ORDER BY frame), {zeros}) AS arr FROM {src} GROUP BY 1
        {f"UNION ALL SELECT {key}, 'h', list_concat(list(1.0::DOUBLE ORDER BY frame), {zeros}) FROM {src} GROUP BY 1" if renorm else ""})""", run(f"{name}_f", f"{name}_0")]
    at, last = "i - 1", f"{name}_f_r"
    if zero_phase:
        parts += [f"{name}_1 AS (SELECT {key}, chan, list(y ORDER BY i DESC) AS arr FROM {last} WHERE i > 0 GROUP BY 1, 2)", run(f"{name}_g", f"{name}_1")]
        at, last = "len(arr) - i", f"{name}_g_r"
    both = f"max(y) FILTER (WHERE chan = 'x'){f' / max(y) FILTER (WHERE chan = {chr(39)}h{chr(39)})' if renorm else ''}"
    return ",\n".join([*parts, f"{name} AS (SELECT {key}, CAST({at} AS BIGINT) AS frame, {both} AS {name} FROM {last} WHERE i > 0 AND {at} < len(arr) - {pad} GROUP BY 1, 2)"])


def low_sql(order, cut, rate):
    """Coefficients of the Butterworth low-pass from its analog form: (s + 1), (s^2 + sqrt(2) s + 1), (s^2 + s + 1)(s + 1) with s scaled by w."""
    w = f"tan(pi() * {cut} / {rate})"
    if order == 1:
        n = f"({w} + 1)"
        return f"[{w} / {n}, {w} / {n}]", f"[1.0, ({w} - 1) / {n}]"
    if order == 2:
        n = f"(1 + sqrt(2) * {w} + {w} * {w})"
        return f"[{w} * {w} / {n}, 2 * {w} * {w} / {n}, {w} * {w} / {n}]", f"[1.0, 2 * ({w} * {w} - 1) / {n}, (1 - sqrt(2) * {w} + {w} * {w}) / {n}]"
    c = [f"pow({w}, 3)", f"2 * pow({w}, 2)", f"2 * {w}", "1.0"]
    return analog_sql(c, [f"pow({w}, 3)", "0.0", "0.0", "0.0"])


# (1 - z)^k (1 + z)^(m - k) by powers of z
EXPANDED = {3: [[1, 3, 3, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -3, 3, -1]],
            4: [[1, 4, 6, 4, 1], [1, 2, 0, -2, -1], [1, 0, -2, 0, 1], [1, -2, 0, 2, -1], [1, -4, 6, -4, 1]],
            2: [[1, 2, 1], [1, 0, -1], [1, -2, 1]]}


def analog_sql(bottom, top):
    """Digital coefficients of analog polynomials (lowest power first) by s = (1 - z) / (1 + z)."""
    m = len(bottom) - 1
    at = lambda coef, i: "(" + " + ".join(f"({c}) * ({EXPANDED[m][k][i]})" for k, c in enumerate(coef)) + ")"
    lists = [", ".join(f"{at(c, i)} / {at(bottom, 0)}" for i in range(m + 1)) for c in (top, bottom)]
    return f"[{lists[0]}]", f"[{lists[1]}]"


def band_sql(order, low, high, rate):
    wl, wh = f"tan(pi() * {low} / {rate})", f"tan(pi() * {high} / {rate})"
    bw, w2 = f"({wh} - {wl})", f"({wl} * {wh})"
    if order == 1:
        return analog_sql([w2, bw, "1.0"], ["0.0", bw, "0.0"])
    return analog_sql([f"{w2} * {w2}", f"sqrt(2) * {bw} * {w2}", f"2 * {w2} + {bw} * {bw}", f"sqrt(2) * {bw}", "1.0"], ["0.0", "0.0", f"{bw} * {bw}", "0.0", "0.0"])


def recursive_views(*parts):
    return with_views(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


STEP = """st AS (SELECT session, frame, x, y, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) / 0.05 AS s
    FROM track WINDOW w AS (PARTITION BY session ORDER BY frame)),
    sp AS (SELECT session, frame, x, y, coalesce(s, lead(s) OVER (PARTITION BY session ORDER BY frame)) AS v FROM st)"""


@query("speed", with_views("track", STEP, """e AS (SELECT session, max(frame) AS f1 FROM sp GROUP BY 1)""",
    """SELECT p.session, p.frame, round(avg(q.v), 6) + 0.0 AS speed FROM sp p JOIN e USING (session) CROSS JOIN (VALUES (-1), (0), (1)) o(d)
    JOIN sp q ON q.session = p.session AND q.frame = least(greatest(p.frame + d, 0), f1) GROUP BY 1, 2"""))
def speed(spark, d):
    return Q.speed(S.track(spark, d), SES, "frame", "x", "y", 0.05, smooth=3).select("session", "frame", r("speed").alias("speed"))


def _box(c, n, out, src):
    b, a = n // 2, (n - 1) // 2
    return f"{out} AS (SELECT *, sum({c}) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING) / {n}.0 AS {out}v FROM {src})"


@query("speed_box", with_views("track", _box("x", 20, "bx", "track"), _box("y", 20, "byy", "bx"),
    """vv AS (SELECT *, coalesce(sqrt((lead(bxv) OVER w - bxv) * (lead(bxv) OVER w - bxv) + (lead(byyv) OVER w - byyv) * (lead(byyv) OVER w - byyv)) / 0.05, 0) AS v
        FROM byy WINDOW w AS (PARTITION BY session ORDER BY frame))""", _box("v", 20, "o", "vv"),
    "SELECT session, frame, round(ov, 6) + 0.0 AS speed FROM o"))
def speed_box(spark, d):
    return Q.speed_box(S.track(spark, d), SES, "frame", "x", "y", 20).select("session", "frame", r("speed").alias("speed"))


_SG = K.savgol(20, 2)


@query("velocity_savgol", with_views("track", STEP, kernel_sql(_SG, -(len(_SG) // 2)), conv_sql("velocity", _SG, 0, True, "sp", "session", "v"),
    "SELECT session, frame, round(velocity, 5) + 0.0 AS velocity FROM velocity WHERE velocity >= 350.00001"))
def velocity_savgol(spark, d):
    return Q.velocity_savgol(S.track(spark, d), SES, "frame", "x", "y", 20, 350.00001).select("session", "frame", r("velocity", 5).alias("velocity"))


_SG4 = K.savgol(21, 4)


@query("mobile_smooth", with_views("track", kernel_sql(_SG4, -10), conv_sql("sm", _SG4, 0, True, "track", "session", "x"),
    "SELECT session, frame, sm > 25.00001 AS mobile FROM sm"))
def mobile_smooth(spark, d):
    return Q.mobile_smooth(S.track(spark, d), SES, "frame", "x", 25.00001).select("session", "frame", "mobile")


@query("rolling_box", with_views("traces", """SELECT cell_id, frame, round(sum(f) OVER (PARTITION BY cell_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11, 6) + 0.0 AS box FROM traces"""))
def rolling_box(spark, d):
    return Q.rolling_box(S.traces(spark, d), CELL, "frame", "f", 11, "box").select("cell_id", "frame", r("box").alias("box"))


@query("median_filter", with_views("track", """SELECT session, frame, round(quantile_cont(signal, 0.5) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING), 6) + 0.0 AS med FROM track"""))
def median_filter(spark, d):
    return Q.median_filter(S.track(spark, d), SES, "frame", "signal", 101, "med").select("session", "frame", r("med").alias("med"))


GRAD = """g AS (SELECT cell_id, frame, f, CASE WHEN lag(f) OVER w IS NULL THEN lead(f) OVER w - f WHEN lead(f) OVER w IS NULL THEN f - lag(f) OVER w
    ELSE (lead(f) OVER w - lag(f) OVER w) / 2 END AS grad FROM traces WINDOW w AS (PARTITION BY cell_id ORDER BY frame))"""


@query("derivative", with_views("traces", GRAD, "SELECT cell_id, frame, round(grad, 4) + 0.0 AS grad FROM g"))
def derivative(spark, d):
    return Q.derivative(S.traces(spark, d), CELL, "frame", "f").select("cell_id", "frame", r("grad", 4).alias("grad"))


@query("upphase_mask", with_views("traces", GRAD, "SELECT cell_id, frame, round(CASE WHEN grad <= 0 THEN 0.0 ELSE f END, 4) + 0.0 AS up FROM g"))
def upphase_mask(spark, d):
    return Q.upphase_mask(S.traces(spark, d), CELL, "frame", "f").select("cell_id", "frame", r("up", 4).alias("up"))


@query("block_mode_baseline", with_views("track", """h AS (SELECT session, frame // 120 AS w, CAST(least(floor(round((signal + 0) / 2.5, 9)), 47) AS INTEGER) AS bin, count(*) AS n FROM track GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY session, w ORDER BY n DESC, bin) AS rk FROM h)""",
    "SELECT session, frame, round(signal - bin * 2.5, 6) + 0.0 AS base FROM track JOIN k USING (session) WHERE rk = 1 AND w = frame // 120"))
def block_mode_baseline(spark, d):
    out = Q.block_mode_baseline(S.track(spark, d), SES, "frame", "signal", 120, 2.5, 0.0, 120.0, "base")
    return out.select("session", "frame", r("base").alias("base"))


def detrended(order):
    """Polynomials that are orthogonal on the frames 0..n-1 take the place of normal equations."""
    u = "(t.frame - (n - 1) / 2.0)"
    p = ["1.0", u, f"({u} * {u} - m2)", f"({u} * {u} * {u} - {u} * m4 / m2)"][:order + 1]
    return recursive_views("traces", filtered_sql("low", *low_sql(order, 0.02, 1.0), renorm=True, pad=600),
        """nn AS (SELECT cell_id, count(*) AS n, avg(pow(frame - (z - 1) / 2.0, 2)) AS m2, avg(pow(frame - (z - 1) / 2.0, 4)) AS m4 FROM traces JOIN (SELECT cell_id, count(*) AS z FROM traces GROUP BY 1) USING (cell_id) GROUP BY 1)""",
        f"""fit AS (SELECT t.cell_id, {", ".join(f"sum(low * {q}) / sum({q} * {q}) AS c{k}" for k, q in enumerate(p))} FROM low t JOIN nn USING (cell_id) GROUP BY 1)""",
        f"""SELECT t.cell_id, t.frame, round(t.f - ({" + ".join(f"c{k} * {q}" for k, q in enumerate(p))}), 6) + 0.0 AS flat FROM traces t JOIN nn USING (cell_id) JOIN fit USING (cell_id)""")


def flat_trace(spark, d, order):
    return G.detrend(S.traces(spark, d), CELL, "frame", "f", order, 0.02, 1.0, "flat").select("cell_id", "frame", r("flat").alias("flat"))


@query("linear_detrend", detrended(1))
def linear_detrend(spark, d):
    return flat_trace(spark, d, 1)


@query("detrend_quadratic", detrended(2))
def detrend_quadratic(spark, d):
    return flat_trace(spark, d, 2)


@query("detrend_cubic", detrended(3))
def detrend_cubic(spark, d):
    return flat_trace(spark, d, 3)


Z99999 = 4.264890793922825


@query("event_threshold", with_views("tracking", """v AS (SELECT unit, signal - 52 AS v FROM tracking),
    h AS (SELECT unit, CAST(least(floor(round((v + 60) / 0.5, 9)), 239) AS INTEGER) AS bin, count(*) AS n FROM v WHERE v BETWEEN -60 AND 60 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, bin) AS rk FROM h),
    m AS (SELECT unit, -60 + bin * 5e-1 AS mode FROM k WHERE rk = 1),
    p AS (SELECT unit, mode, sqrt(2 * sum(v * v) / (2 * count(*) - 1)) AS sigma FROM v JOIN m USING (unit) WHERE v <= mode GROUP BY 1, 2)""",
    f"""SELECT unit, mode, round(sigma, 6) + 0.0 AS sigma, round(CASE WHEN sigma > 100 THEN 1.0 ELSE ceil(round(sigma * {Z99999!r}::DOUBLE / 0.5, 6)) * 0.5 END, 6) + 0.0 AS threshold FROM p"""))
def event_threshold(spark, d):
    v = S.tracking(spark, d).select("unit", (F.col("signal") - 52).alias("v"))
    out = Q.event_threshold(v, ["unit"], "v", Z99999, 0.5, 60.0, 0.1)
    return out.select("unit", "mode", r("sigma").alias("sigma"), r("threshold").alias("threshold"))


@query("moment2", with_views("traces", "SELECT cell_id, round(var_pop(f), 4) + 0.0 AS moment2, CASE WHEN var_pop(f) >= 250 THEN 5e-1 END AS threshold FROM traces GROUP BY 1"))
def moment2(spark, d):
    return Q.moment_override(S.traces(spark, d), CELL, "f", 250.0, 0.5).withColumn("moment2", r("moment2", 4))


@query("snr", with_views("traces", "SELECT cell_id, round(avg(f) / stddev_pop(f), 6) + 0.0 AS snr FROM traces GROUP BY 1"))
def snr(spark, d):
    return Q.trace_stats(S.traces(spark, d), CELL, "f").select("cell_id", r("snr").alias("snr"))


@query("skew", with_views("traces", "m AS (SELECT cell_id, avg(f) AS mu, stddev_pop(f) AS sd FROM traces GROUP BY 1)",
    "SELECT cell_id, round(avg(pow((f - mu) / sd, 3)), 6) + 0.0 AS skew FROM traces JOIN m USING (cell_id) GROUP BY 1"))
def skew(spark, d):
    return Q.trace_stats(S.traces(spark, d), CELL, "f").select("cell_id", r("skew").alias("skew"))


@query("global_std", with_views("traces", """s AS (SELECT cell_id, stddev_pop(f) AS sd FROM traces GROUP BY 1 HAVING stddev_pop(f) > 0),
    h AS (SELECT CAST(least(floor(round(sd / 0.5, 9)), 199) AS INTEGER) AS bin, count(*) AS c FROM s WHERE sd <= 100 GROUP BY 1),
    k AS (SELECT bin, sum(c) OVER (ORDER BY bin) / sum(c) OVER () AS share FROM h)""", "SELECT min(bin) * 5e-1 AS global_std FROM k WHERE share >= 0.5"))
def global_std(spark, d):
    return Q.global_std(S.traces(spark, d), [], CELL, "f")


RUNS = """z AS (SELECT cell_id, frame, f, f > 0 AS s, CASE WHEN (f > 0) IS DISTINCT FROM lag(f > 0) OVER w THEN 1 ELSE 0 END AS ch FROM traces WINDOW w AS (PARTITION BY cell_id ORDER BY frame)),
    zi AS (SELECT *, sum(ch) OVER (PARTITION BY cell_id ORDER BY frame) AS run FROM z),
    runs AS (SELECT cell_id, run, any_value(s) AS s, min(frame) AS a, max(frame) AS b FROM zi GROUP BY 1, 2),
    ends AS (SELECT cell_id, min(frame) AS f0, max(frame) AS f1 FROM traces GROUP BY 1)"""


def on():
    return F.col("f") > 0


@query("binarize_runs", with_views("traces", RUNS, "ok AS (SELECT cell_id, a, b FROM runs JOIN ends USING (cell_id) WHERE s AND b - a + 1 >= 2 AND a > f0 AND b < f1)",
    "SELECT t.cell_id, t.frame, CASE WHEN ok.a IS NULL THEN 0 ELSE 1 END AS bin FROM traces t LEFT JOIN ok ON ok.cell_id = t.cell_id AND t.frame BETWEEN ok.a - 1 AND ok.b - 1"))
def binarize_runs(spark, d):
    return Q.binarize_runs(S.traces(spark, d), CELL, "frame", on(), 2).select("cell_id", "frame", "bin")


@query("binarize_std", with_views("traces", "m AS (SELECT cell_id, stddev_pop(f) AS sd FROM traces GROUP BY 1)",
    "SELECT cell_id, frame, CASE WHEN f >= 2 * sd THEN 1 ELSE 0 END AS bin FROM traces JOIN m USING (cell_id)"))
def binarize_std(spark, d):
    return Q.binarize_std(S.traces(spark, d), CELL, "f", 2.0).select("cell_id", "frame", "bin")


@query("scale_events", with_views("traces", RUNS, "ev AS (SELECT cell_id, a, b, f1 FROM runs JOIN ends USING (cell_id) WHERE s AND a > f0 AND b < f1)",
    """SELECT ev.cell_id, a AS start, b AS "end", round(CASE WHEN sum(t.f) >= 40.0001 THEN sum(t.f) ELSE 0 END, 4) + 0.0 AS scaled
    FROM ev JOIN traces t ON t.cell_id = ev.cell_id AND t.frame BETWEEN a - 1 AND b + 4 GROUP BY 1, 2, 3"""))
def scale_events(spark, d):
    out = Q.scale_events(S.traces(spark, d), CELL, "frame", on(), "f", 40.0001)
    return out.select("cell_id", "start", "end", r("scaled", 4).alias("scaled"))


@query("event_onsets", with_views("traces", RUNS, "SELECT cell_id, a AS frame FROM runs JOIN ends USING (cell_id) WHERE s AND a > f0"))
def event_onsets(spark, d):
    return Q.event_onsets(S.traces(spark, d), CELL, "frame", on()).select("cell_id", "frame")


@query("event_runs", with_views("traces", RUNS, """SELECT cell_id, a AS start, b AS "end", b - a + 1 AS length FROM runs WHERE s"""))
def event_runs(spark, d):
    return Q.event_runs(S.traces(spark, d), CELL, "frame", on())


@query("burst_stats", with_views("track", """q AS (SELECT *, signal > 52 AS s FROM track), med AS (SELECT session, median(signal) AS med FROM track GROUP BY 1),
    z AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY session ORDER BY frame) THEN 1 ELSE 0 END AS ch FROM q),
    zi AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame) AS run FROM z)""",
    "SELECT session, min(frame) AS start, round(max(signal) / any_value(med), 6) + 0.0 AS peak, count(*) AS duration FROM zi JOIN med USING (session) WHERE s GROUP BY session, run"))
def burst_stats(spark, d):
    return Q.burst_stats(S.track(spark, d), SES, "frame", F.col("signal") > 52, "signal").withColumn("peak", r("peak"))


@query("fill_gaps", with_views("traces", """o1 AS (SELECT *, max(CASE WHEN f > 0 THEN frame END) OVER (PARTITION BY cell_id ORDER BY frame) AS a,
        min(CASE WHEN f > 0 THEN frame END) OVER (PARTITION BY cell_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM traces),
    o2 AS (SELECT cell_id, frame, CASE WHEN z - a <= 4 THEN 1 WHEN f > 0 THEN 1 ELSE 0 END AS s FROM o1),
    o3 AS (SELECT *, max(CASE WHEN s = 0 THEN frame END) OVER (PARTITION BY cell_id ORDER BY frame) AS a,
        min(CASE WHEN s = 0 THEN frame END) OVER (PARTITION BY cell_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM o2)""",
    "SELECT cell_id, frame, CASE WHEN z - a <= 4 THEN 0 ELSE s END AS filled FROM o3"))
def fill_gaps(spark, d):
    t = S.traces(spark, d).withColumn("s", F.when(on(), 1).otherwise(0))
    return Q.fill_gaps(t, CELL, "frame", "s", 4).select("cell_id", "frame", "filled")


@query("bout_hist", with_views("spikes", f"""n AS (SELECT unit_id, t_us, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY unit_id ORDER BY t_us) <= {6 * S.HOUR_US} THEN 0 ELSE 1 END AS nw FROM spikes),
    b AS (SELECT unit_id, sum(nw) OVER (PARTITION BY unit_id ORDER BY t_us) AS bout FROM n), l AS (SELECT unit_id, bout, count(*) AS length FROM b GROUP BY 1, 2)""",
    "SELECT length, count(*) AS bouts FROM l GROUP BY 1"))
def bout_hist(spark, d):
    return Q.bout_hist(S.spikes(spark, d), ["unit_id"], "t_us", minute(), 6 * S.HOUR_US)


@query("find_sequences", with_views("states", """j AS (SELECT frame, dim, v - lag(v) OVER (PARTITION BY dim ORDER BY frame) AS dv FROM states),
    n AS (SELECT frame, sqrt(sum(dv * dv)) AS step FROM j GROUP BY 1)""",
    "SELECT frame, CAST(sum(CASE WHEN step > 1.35 THEN 1 ELSE 0 END) OVER (ORDER BY frame) AS BIGINT) AS segment FROM n"))
def find_sequences(spark, d):
    from engram.operators.decode import state_steps
    steps = state_steps(S.state_vectors(spark, d), "frame", "vec")
    return Q.find_sequences(steps, [], "frame", F.coalesce(F.col("step") > 1.35, F.lit(False))).select("frame", "segment")


@query("dedup_states", with_views("states", """n AS (SELECT frame, round(sum(v), 1) AS s FROM states GROUP BY 1)""",
    "SELECT frame FROM (SELECT frame, s - lag(s) OVER (ORDER BY frame) AS ds FROM n) WHERE ds IS NULL OR ds > 1e-10"))
def dedup_states(spark, d):
    total = S.states(spark, d).groupBy("frame").agg(F.round(F.sum("v"), 1).alias("s"))
    return Q.dedup_states(total, "frame", F.col("s")).select("frame")


CLICK = "c AS (SELECT unit_id, t_us, event_id, CASE WHEN kind IN ('click', 'view') THEN 1 WHEN kind = 'error' THEN -1 ELSE 0 END AS click FROM spikes)"


def clicks(spark, d):
    k = F.col("kind")
    return S.spikes(spark, d).withColumn("click", F.when(k.isin("click", "view"), 1).when(k == "error", -1).otherwise(0))


@query("win_cumdist", with_views("spikes", CLICK, """SELECT unit_id, event_id, CAST(sum(-click) OVER (PARTITION BY unit_id ORDER BY t_us, event_id) AS BIGINT) AS clicks,
    round(sum(-click) OVER (PARTITION BY unit_id ORDER BY t_us, event_id) * (2 * pi() * 0.1 / 500), 6) + 0.0 AS distance FROM c"""))
def win_cumdist(spark, d):
    out = Q.win_cumdist(clicks(spark, d), ["unit_id"], ["t_us", "event_id"], minute(), -F.col("click"), 2 * math.pi * 0.1 / 500)
    return out.select("unit_id", "event_id", "clicks", r("distance").alias("distance"))


@query("rising_edges", with_views("spikes", CLICK, """SELECT unit_id, event_id FROM (SELECT *, lag(click) OVER (PARTITION BY unit_id ORDER BY t_us, event_id) AS p FROM c) WHERE click >= 1 AND p < 1"""))
def rising_edges(spark, d):
    return Q.rising_edges(clicks(spark, d), ["unit_id"], ["t_us", "event_id"], minute(), "click").select("unit_id", "event_id")


STILL = 10 * S.HOUR_US
VEL = f"""k AS (SELECT unit_id, t_us, click, lag(t_us) OVER (PARTITION BY unit_id ORDER BY t_us) AS p FROM c WHERE click <> 0),
    vel AS (SELECT unit_id, t_us AS sample, click * (2 * pi() * 0.1 / 500) * 3.6e9 / (t_us - coalesce(p, 0)) AS velocity FROM k WHERE p IS NULL OR t_us - p < {STILL}
        UNION ALL SELECT unit_id, p + CAST(i AS BIGINT) * {STILL}, 0.0 FROM (SELECT unit_id, p, unnest(range(1, (t_us - p - 1) // {STILL} + 1)) AS i FROM k WHERE p IS NOT NULL AND t_us - p >= {STILL}))"""


def velocity_table(spark, d):
    return Q.click_velocity(clicks(spark, d), ["unit_id"], "t_us", minute(), "click", 2 * math.pi * 0.1 / 500, 3.6e9, STILL)


@query("click_velocity", with_views("spikes", CLICK, VEL, "SELECT unit_id, sample, round(velocity, 6) + 0.0 AS velocity FROM vel"))
def click_velocity(spark, d):
    return velocity_table(spark, d).select("unit_id", "sample", r("velocity").alias("velocity"))


@query("frame_offsets", with_views("sessions", """n AS (SELECT animal, session, count(*) AS frames FROM sessions GROUP BY 1, 2)""",
    "SELECT animal, session, frames, CAST(coalesce(sum(frames) OVER (PARTITION BY animal ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n"))
def frame_offsets(spark, d):
    return Q.frame_offsets(S.sessions(spark, d), ["animal"], "session", "frame")


@query("dlc_likelihood", with_views("track", "SELECT session, frame, CASE WHEN signal >= 10 THEN x END AS x, CASE WHEN signal >= 10 THEN y END AS y FROM track"))
def dlc_likelihood(spark, d):
    return Q.dlc_likelihood(S.track(spark, d), "signal", 10.0).select("session", "frame", "x", "y")


JUMP = """jp AS (SELECT session, frame, x AS x0, y AS y0, coalesce(sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)) > 30, false) AS far
    FROM track WINDOW w AS (PARTITION BY session ORDER BY frame)),
    jj AS (SELECT session, frame, CASE WHEN NOT far THEN x0 END AS x, CASE WHEN NOT far THEN y0 END AS y FROM jp)"""


@query("dlc_jump", with_views("track", JUMP, "SELECT * FROM jj"))
def dlc_jump(spark, d):
    return Q.dlc_jump(S.track(spark, d), SES, "frame", "x", "y", 30.0).select("session", "frame", "x", "y")


@query("dlc_short_segments", with_views("track", JUMP, """z AS (SELECT *, CASE WHEN (x IS NOT NULL) IS DISTINCT FROM lag(x IS NOT NULL) OVER (PARTITION BY session ORDER BY frame) THEN 1 ELSE 0 END AS ch FROM jj),
    zi AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame) AS run FROM z),
    zl AS (SELECT session, frame, CASE WHEN count(*) OVER (PARTITION BY session, run) >= 3 THEN x END AS x, CASE WHEN count(*) OVER (PARTITION BY session, run) >= 3 THEN y END AS y FROM zi)""",
    """SELECT session, frame, coalesce(x, quantile_cont(x, 0.5) OVER w) AS x, coalesce(y, quantile_cont(y, 0.5) OVER w) AS y FROM zl
    WINDOW w AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)"""))
def dlc_short_segments(spark, d):
    j = Q.dlc_jump(S.track(spark, d), SES, "frame", "x", "y", 30.0).select("session", "frame", "x", "y")
    return Q.dlc_short_segments(j, SES, "frame", "x", "y", 3, 5, short=S.short_tracks(spark, d))


@query("dlc_median_part", with_views("tracking", "SELECT unit, t AS frame, median(x) AS x, median(y) AS y FROM tracking GROUP BY 1, 2"))
def dlc_median_part(spark, d):
    # The rows of one unit and day stand for the body parts of one frame; exact at any group size.
    from engram.functions.quantiles import exact_quantile
    t, _ = dealt(S.tracking(spark, d).select("unit", F.col("t").alias("frame"), "x", "y").dropna(subset=["unit", "frame"]), "unit")
    most = t.groupBy("unit", "frame").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (most or 0) <= PARTS:
        return Q.dlc_median_part(t, ["unit"], "frame", "x", "y").filter("x is not null and y is not null")
    mx, my = (exact_quantile(t, ["unit", "frame"], c, 0.5, c) for c in ("x", "y"))
    return mx.join(my, ["unit", "frame"])


@query("dense_ids", with_views("spikes", "SELECT event_id, unit_id, CAST(dense_rank() OVER (ORDER BY unit_id) - 1 AS INTEGER) AS dense_id FROM spikes"))
def dense_ids(spark, d):
    return Q.dense_ids(S.spikes(spark, d), "unit_id").select("event_id", "unit_id", "dense_id")


@query("time_bin_sum", with_views("traces", "SELECT cell_id, frame // 15 AS bin, round(sum(f), 4) + 0.0 AS value FROM traces WHERE frame % 5 = 0 GROUP BY 1, 2"))
def time_bin_sum(spark, d):
    return Q.time_bin_sum(S.traces(spark, d), CELL, "frame", "f", 3, 5).withColumn("value", r("value", 4))


@query("time_bin", with_views("traces", """b AS (SELECT cell_id, frame // 7 AS bin, sum(f) AS v FROM traces GROUP BY 1, 2)""",
    "SELECT cell_id, bin, round(v, 4) + 0.0 AS value FROM b WHERE bin < (SELECT max(bin) FROM b)"))
def time_bin(spark, d):
    return Q.time_bin(S.traces(spark, d), CELL, "frame", "f", 7).withColumn("value", r("value", 4))


@query("angle_hist", with_views("tracking", """a AS (SELECT atan2((x - 25) * (pk % 11 - y) - (y - 5) * (pk % 50 - x) + 0.0, (x - 25) * (pk % 50 - x) + (y - 5) * (pk % 11 - y) + 0.0) AS a FROM tracking)""",
    "SELECT CAST(least(floor(round((a + pi()) / (pi() / 6), 9)), 11) AS INTEGER) AS bin, count(*) AS n FROM a GROUP BY 1"))
def angle_hist(spark, d):
    from engram.functions.exprs import signed_angle
    from engram.operators.occupancy import histogram
    t = S.tracking(spark, d)
    a = signed_angle(F.col("x") - 25, F.col("y") - 5, F.col("pk") % 50 - F.col("x"), F.col("pk") % 11 - F.col("y"))
    return histogram(t, [], a, -math.pi, math.pi / 6, 12)


# Filters. The twins run the textbook recursion sample by sample; the engine's poles and gains do not appear in them.
_LOW = filtered_sql("low", *low_sql(1, 1.0, 30.0), renorm=True, pad=200)


@query("lowpass", recursive_views("traces", _LOW, "SELECT cell_id, frame, round(low, 6) + 0.0 AS low FROM low"))
def lowpass(spark, d):
    return G.lowpass(S.traces(spark, d), CELL, "frame", "f", 1.0, 30.0).select("cell_id", "frame", r("low").alias("low"))


@query("highpass", recursive_views("traces", _LOW, "SELECT cell_id, frame, round(f - low, 6) + 0.0 AS high FROM low JOIN traces USING (cell_id, frame)"))
def highpass(spark, d):
    return G.highpass(S.traces(spark, d), CELL, "frame", "f", 1.0, 30.0).select("cell_id", "frame", r("high").alias("high"))


@query("bandpass", recursive_views("traces", filtered_sql("band", *band_sql(1, 0.5, 2.0, 30.0), zero_phase=False), "SELECT cell_id, frame, round(band, 6) + 0.0 AS band FROM band"))
def bandpass(spark, d):
    return G.bandpass(S.traces(spark, d), CELL, "frame", "f", 0.5, 2.0, 30.0).select("cell_id", "frame", r("band").alias("band"))


@query("ephys_bandpass", recursive_views("traces", filtered_sql("band", *band_sql(2, 500.0, 6000.0, 30000.0), pad=600), "SELECT cell_id, frame, round(band, 6) + 0.0 AS band FROM band"))
def ephys_bandpass(spark, d):
    return G.ephys_bandpass(S.traces(spark, d), CELL, "frame", "f", 500.0, 6000.0, 30000.0).select("cell_id", "frame", r("band").alias("band"))


@query("exp_smooth", recursive_views("traces", """ex AS (SELECT t.cell_id, t.frame, sum(exp(-(t.frame - s.frame) / 20.0) * s.f) AS ex FROM traces t JOIN traces s
    ON s.cell_id = t.cell_id AND s.frame BETWEEN t.frame - 99 AND t.frame GROUP BY 1, 2)""", filtered_sql("low", *low_sql(1, 1.0, 30.0), "ex", "cell_id", "ex", renorm=True, pad=200),
    "SELECT cell_id, frame, round(low, 6) + 0.0 AS smooth FROM low"))
def exp_smooth(spark, d):
    return G.exp_smooth(S.traces(spark, d), CELL, "frame", "f", 100, 20.0, 1.0, 30.0).select("cell_id", "frame", r("smooth").alias("smooth"))


@query("notch", with_views("traces", """p AS (SELECT cell_id, frame, f, frame // 120 AS w, sin(frame * (2 * pi() * 5 / 30)) AS s, cos(frame * (2 * pi() * 5 / 30)) AS c FROM traces),
    q AS (SELECT cell_id, w, sum(f * s) AS xs, sum(f * c) AS xc, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc FROM p GROUP BY 1, 2)""",
    """SELECT cell_id, frame, round(f - (xs * cc - xc * sc) / (ss * cc - sc * sc) * s - (xc * ss - xs * sc) / (ss * cc - sc * sc) * c, 6) + 0.0 AS clean FROM p JOIN q USING (cell_id, w)"""))
def notch(spark, d):
    return G.notch(S.traces(spark, d), CELL, "frame", "f", 5.0, 30.0, 120).select("cell_id", "frame", r("clean").alias("clean"))


@query("power_spectrum", with_views("traces", """nn AS (SELECT cell_id, max(frame) + 1 AS n FROM traces GROUP BY 1),
    kk AS (SELECT cell_id, n, unnest(range(0, n // 2 + 1)) AS k FROM nn)""",
    """SELECT cell_id, round(k * 30 / n, 6) + 0.0 AS freq, round(ln(1 + sum(f * cos(2 * pi() * ((k * frame) % n) / n)) ^ 2 + sum(f * sin(2 * pi() * ((k * frame) % n) / n)) ^ 2), 5) + 0.0 AS log_power
    FROM kk JOIN traces USING (cell_id) GROUP BY cell_id, k, n"""))
def power_spectrum(spark, d):
    out = G.power_spectrum(S.traces(spark, d), CELL, "frame", "f", 30.0)
    return out.select("cell_id", r("freq").alias("freq"), r(F.log(1 + F.col("power")), 5).alias("log_power"))


@query("welch", with_views("traces", """sg AS (SELECT cell_id, frame, f, frame // 32 - o AS seg FROM traces CROSS JOIN (VALUES (0), (1)) v(o)),
    s2 AS (SELECT * FROM sg WHERE seg >= 0 AND seg * 32 + 64 <= (SELECT max(frame) + 1 FROM traces)),
    mm AS (SELECT cell_id, seg, avg(f) AS m FROM s2 GROUP BY 1, 2),
    xx AS (SELECT cell_id, seg, frame - seg * 32 AS k, (f - m) * (0.5 - 0.5 * cos((frame - seg * 32) * (2 * pi() / 64))) AS x FROM s2 JOIN mm USING (cell_id, seg)),
    pw AS (SELECT cell_id, seg, j, sum(x * cos(k * (2 * pi() * j / 64))) ^ 2 + sum(x * sin(k * (2 * pi() * j / 64))) ^ 2 AS p FROM xx CROSS JOIN (SELECT unnest(range(0, 33)) AS j) GROUP BY 1, 2, 3)""",
    "SELECT cell_id, j * 30 / 64 AS freq, round(sqrt(avg(p * 2 / (30 * 24) * CASE WHEN j IN (0, 32) THEN 0.5 ELSE 1 END)), 6) + 0.0 AS density FROM pw GROUP BY 1, 2"))
def welch(spark, d):
    return G.welch(S.traces(spark, d), CELL, "frame", "f", 64, 30.0).select("cell_id", "freq", r("density").alias("density"))
