"""Joins, pairs and graphs."""

from math import comb

from pyspark.sql import functions as F

from engram.functions.blocks import frame_block
from engram.functions.exprs import rounded as r
from engram.operators import graph as H, joins as J, pairs as P, sequences as Q
from engram.plans import q_sequences as QS
from engram.plans.registry import query
from engram.sources import tables as S
from engram.sources.tables import with_views

HOUR = S.HOUR_US
SESSION = ["session"]


@query("join_frame_position", with_views("activity track", """SELECT cell_id, session, frame, round(f, 4) + 0.0 AS f, x, y
    FROM (SELECT *, cell_id % (SELECT max(session) + 1 FROM track) AS session FROM activity) JOIN track USING (session, frame)"""))
def join_frame_position(spark, d):
    """Every cell is recorded in one of all sessions of the track."""
    sessions = S.tracking(spark, d).agg((F.max("unit") + 1).alias("_n"))   # one row
    act = S.activity(spark, d).crossJoin(F.broadcast(sessions)).withColumn("session", F.col("cell_id") % F.col("_n")).drop("_n")
    pos = S.track(spark, d).select("session", "frame", "x", "y")
    return J.join_frame_position(act, pos, ["session", "frame"]).select("cell_id", "session", "frame", r("f", 4).alias("f"), "x", "y")


@query("join_spike_position", with_views("spikes", """fr AS (SELECT DISTINCT t_us AS frame_t, value AS x FROM spikes WHERE kind = 'click')""",
    """SELECT unit_id, frame_t, x, CAST(count(*) AS BIGINT) AS spikes FROM fr JOIN spikes ON t_us <= frame_t AND t_us > frame_t - 900000000 GROUP BY 1, 2, 3"""))
def join_spike_position(spark, d):
    """All clicks are frames of one recording, so every frame meets the spikes of all units."""
    s = S.spikes(spark, d)
    frames = s.filter("kind = 'click'").select(F.col("t_us").alias("frame_t"), F.col("value").alias("x")).distinct()
    return J.join_spike_position(s.select("unit_id", "t_us"), frames, [], "unit_id", "t_us", "frame_t", 900_000_000)


@query("join_asof_velocity", with_views("spikes", QS.CLICK, QS.VEL, """tr AS (SELECT unit_id, t_us AS sample, event_id FROM spikes WHERE kind IN ('purchase', 'signup')),
    sg AS (SELECT unit_id, sample, velocity, lag(sample) OVER w AS ps, lag(velocity) OVER w AS pv, lead(sample) OVER w AS ns, lead(velocity) OVER w AS nv,
        row_number() OVER w AS rn FROM vel WINDOW w AS (PARTITION BY unit_id ORDER BY sample)),
    se AS (SELECT unit_id, sample, rn, CASE WHEN ns IS NULL THEN ps ELSE sample END AS s0, CASE WHEN ns IS NULL THEN pv ELSE velocity END AS v0,
        CASE WHEN ns IS NULL THEN sample ELSE ns END AS s1, CASE WHEN ns IS NULL THEN velocity ELSE nv END AS v1 FROM sg),
    fs AS (SELECT * FROM se WHERE rn = 1)""",
    """SELECT tr.unit_id, tr.sample, tr.event_id, round(coalesce(a.v0, fs.v0) + (tr.sample - coalesce(a.s0, fs.s0)) * (coalesce(a.v1, fs.v1) - coalesce(a.v0, fs.v0))
        / (coalesce(a.s1, fs.s1) - coalesce(a.s0, fs.s0)), 6) + 0.0 AS velocity
    FROM tr ASOF LEFT JOIN se a ON a.unit_id = tr.unit_id AND tr.sample >= a.sample JOIN fs ON fs.unit_id = tr.unit_id"""))
def join_asof_velocity(spark, d):
    trig = S.spikes(spark, d).filter("kind in ('purchase', 'signup')").select("unit_id", F.col("t_us").alias("sample"), "event_id")
    block = F.floor(F.col("sample") / S.MINUTE_US).cast("long")
    out = J.join_asof_velocity(QS.velocity_table(spark, d), trig, ["unit_id"], "sample", "velocity", block, "event_id")
    return out.withColumn("velocity", r("velocity"))


SNIP = """sn AS (SELECT a.cell_id AS unit_id, a.frame, o.k AS "offset", t.cell_id, t.f FROM activity a CROSS JOIN (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS k) o
    JOIN traces t ON t.cell_id = a.cell_id AND t.frame = a.frame + o.k
    WHERE a.n >= 2 AND a.frame - 3 >= (SELECT min(frame) FROM traces) AND a.frame + 3 <= (SELECT max(frame) FROM traces))"""


def snips(spark, d):
    tr = S.traces(spark, d)
    sp = S.activity(spark, d).filter("n >= 2").select("cell_id", "frame")
    return J.snippets(sp, tr, "cell_id", "frame", ["cell_id"], "frame", "f", 3, 3)


@query("snippets", with_views("activity traces", SNIP, "SELECT cell_id, frame, \"offset\", round(f, 4) + 0.0 AS f FROM sn"))
def snippets(spark, d):
    return snips(spark, d).select("cell_id", "frame", "offset", r("f", 4).alias("f"))


@query("templates", with_views("activity traces", SNIP, """w AS (SELECT cell_id % 10 AS unit, cell_id AS channel, "offset", avg(f) AS m, count(*) AS n FROM sn GROUP BY 1, 2, 3),
    p AS (SELECT unit, channel, max(m) - min(m) AS ptp, max(n) AS n FROM w GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ptp DESC, channel) AS rk FROM p)""",
    "SELECT unit, channel AS max_channel, round(ptp, 6) + 0.0 AS ptp, n AS spikes FROM k WHERE rk = 1"))
def templates(spark, d):
    s = snips(spark, d).select((F.col("cell_id") % 10).alias("unit"), F.col("cell_id").alias("channel"), "offset", "f")
    return J.templates(s, ["unit"], "channel", "f")[1].withColumn("ptp", r("ptp"))


@query("spike_raster", with_views("spikes", "SELECT DISTINCT unit_id, t_us // 60000000 AS bin FROM spikes"))
def spike_raster(spark, d):
    return J.spike_raster(S.spikes(spark, d), "unit_id", "t_us", S.MINUTE_US)


@query("lag_pairs", with_views("spikes", f"""SELECT a.unit_id, a.t_us, b.t_us AS later, b.t_us - a.t_us AS lag, count(*) AS n FROM spikes a JOIN spikes b
    ON a.unit_id = b.unit_id AND b.t_us > a.t_us AND b.t_us - a.t_us <= {2 * HOUR} GROUP BY 1, 2, 3, 4"""))
def lag_pairs(spark, d):
    return J.lag_pairs(S.spikes(spark, d), "unit_id", "t_us", 2 * HOUR)


HIST = f"""pr AS (SELECT a.unit_id, b.t_us - a.t_us AS lag FROM spikes a JOIN spikes b ON a.unit_id = b.unit_id AND b.t_us > a.t_us AND b.t_us - a.t_us <= {50 * HOUR}
        JOIN (SELECT unit_id, max(t_us) AS last FROM spikes GROUP BY 1) e ON e.unit_id = a.unit_id WHERE a.t_us + {50 * HOUR} < last),
    h AS (SELECT unit_id, CAST(least(floor(lag / ({50 * HOUR} / 200)), 199) AS INTEGER) AS bin, count(*) AS n FROM pr GROUP BY 1, 2)"""


def hist(spark, d):
    return J.lag_histogram(S.spikes(spark, d), "unit_id", "t_us", 50 * HOUR, 200)


@query("lag_histogram", with_views("spikes", HIST, "SELECT * FROM h"))
def lag_histogram(spark, d):
    return hist(spark, d)


@query("theta_index", with_views("spikes", HIST, """p AS (SELECT unit_id, CAST(coalesce(sum(n) FILTER (WHERE bin * 0.25 >= 10 AND bin * 0.25 < 14), 0) AS BIGINT) AS peak,
    CAST(coalesce(sum(n) FILTER (WHERE bin * 0.25 >= 5 AND bin * 0.25 < 7), 0) AS BIGINT) AS trough FROM h GROUP BY 1)""",
    "SELECT unit_id, peak, trough, round(CASE WHEN peak >= 5 AND trough >= 5 THEN (peak - trough) / (peak + trough) END, 6) + 0.0 AS theta FROM p"))
def theta_index(spark, d):
    return J.theta_index(hist(spark, d), "unit_id", 50.0, 200, (10.0, 14.0), (5.0, 7.0)).withColumn("theta", r("theta"))


PRED = "pd AS (SELECT session, frame, x, y, (CAST(x AS BIGINT) * 7 + frame * 3) % 50 AS px, (CAST(y AS BIGINT) * 3 + frame) % 11 AS py FROM track)"


def predicted(spark, d):
    t = S.track(spark, d).select("session", "frame", "x", "y")
    return (t.withColumn("px", ((F.col("x").cast("long") * 7 + F.col("frame") * 3) % 50).cast("double"))
             .withColumn("py", ((F.col("y").cast("long") * 3 + F.col("frame")) % 11).cast("double")))


def _match_sql(lo, hi, sign, extra=""):
    return (PRED, f"""far AS (SELECT * FROM pd WHERE sqrt((px - x) * (px - x) + (py - y) * (py - y)) > 10 {extra}),
    nn AS (SELECT a.session, a.frame, min(CAST((t.x - a.px) * (t.x - a.px) + (t.y - a.py) * (t.y - a.py) AS BIGINT) * 1000 + (t.frame - a.frame - ({lo}))) AS m
        FROM far a JOIN track t ON t.session = a.session AND t.frame BETWEEN a.frame + ({lo}) AND a.frame + ({hi}) GROUP BY 1, 2)""",
    f"SELECT session, frame, round(sqrt(m // 1000), 6) + 0.0 AS nearest, sqrt(m // 1000) < 4 AS hit, round({sign} * (m % 1000) / 20, 6) + 0.0 AS seconds FROM nn")


@query("match_forward", with_views("track", *_match_sql("0", "39", "1")))
def match_forward(spark, d):
    out = J.matches(predicted(spark, d), ["session"], "frame", "x", "y", "px", "py", 40, 10.0, 4.0, 20.0)
    return out.select("session", "frame", r("nearest").alias("nearest"), "hit", r("seconds").alias("seconds"))


@query("match_backward", with_views("track", *_match_sql("-40", "-1", "-1", "AND frame >= 40")))
def match_backward(spark, d):
    out = J.matches(predicted(spark, d), ["session"], "frame", "x", "y", "px", "py", 40, 10.0, 4.0, 20.0, backward=True)
    return out.select("session", "frame", r("nearest").alias("nearest"), "hit", r("seconds").alias("seconds"))


@query("align_clocks", with_views("spikes", """v AS (SELECT unit_id, min(t_us) AS v0 FROM spikes WHERE kind = 'view' GROUP BY 1), t AS (SELECT unit_id, min(t_us) AS t0 FROM spikes WHERE kind = 'click' GROUP BY 1)""",
    "SELECT event_id, t_us - v0 + t0 AS aligned FROM spikes JOIN v USING (unit_id) JOIN t USING (unit_id) WHERE kind = 'view'"))
def align_clocks(spark, d):
    s = S.spikes(spark, d)
    return J.align_clocks(s.filter("kind = 'view'"), s.filter("kind = 'click'"), ["unit_id"], "t_us").select("event_id", "aligned")


@query("join_matched_cells", with_views("sessions", """m AS (SELECT animal, session, cell_id, sum(v) / 997 AS v FROM sessions GROUP BY 1, 2, 3)""",
    "SELECT a.animal, a.session, a.cell_id, round(a.v, 6) + 0.0 AS v, round(b.v, 6) + 0.0 AS v_later FROM m a JOIN m b ON a.animal = b.animal AND a.cell_id = b.cell_id AND b.session = a.session + 1"))
def join_matched_cells(spark, d):
    m = S.sessions(spark, d).groupBy("animal", "session", "cell_id").agg((F.sum("v") / 997).alias("v"))
    return J.join_matched_cells(m, "session", ["animal", "cell_id"]).select("animal", "session", "cell_id", r("v").alias("v"), r("v_later").alias("v_later"))


@query("join_metadata", """SELECT o_orderkey AS session, c_mktsegment AS grp, c_nationkey AS animal FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_metadata(spark, d):
    o, c = S.table(spark, d, "orders"), S.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("session"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("animal"))


CENT = "ct AS (SELECT cell_id, median(x) AS cx, median(y) AS cy FROM pixels GROUP BY 1)"


@query("centroid_distance", with_views("pixels", CENT, """SELECT p.cell_id AS a, q.cell_id AS b, round(sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)), 6) + 0.0 AS distance
    FROM ct p JOIN ct q ON p.cell_id < q.cell_id"""))
def centroid_distance(spark, d):
    return J.centroid_distance(S.pixels(spark, d), [], "cell_id").withColumn("distance", r("distance"))


# Correlations over day bins of the activity.
DAYS = "dy AS (SELECT cell_id, frame // 24 AS bin, sum(f) AS v FROM activity GROUP BY 1, 2), cells AS (SELECT DISTINCT cell_id FROM dy), bins AS (SELECT CAST(unnest(range(0, 30)) AS BIGINT) AS bin)"
PAIRS = """gr AS (SELECT c.cell_id, b.bin, coalesce(dy.v, 0.0) AS v FROM cells c CROSS JOIN bins b LEFT JOIN dy ON dy.cell_id = c.cell_id AND dy.bin = b.bin),
    st AS (SELECT cell_id, avg(v) AS mu, stddev_pop(v) AS sd FROM gr GROUP BY 1),
    z AS (SELECT cell_id, bin, (v - mu) / sd AS z FROM gr JOIN st USING (cell_id)),
    co AS (SELECT p.cell_id AS a, q.cell_id AS b, sum(p.z * q.z) / 30 AS r FROM z p JOIN z q ON p.bin = q.bin AND p.cell_id < q.cell_id GROUP BY 1, 2)"""


def days(spark, d):
    return (S.activity(spark, d).groupBy("cell_id", F.floor(F.col("frame") / 24).alias("bin")).agg(F.sum("f").alias("v")))


def corr(spark, d, with_p=False):
    return P.pearson_pairs(days(spark, d), [], "cell_id", "bin", "v", 30, with_p=with_p)


@query("pearson_pairs", with_views("activity", DAYS, PAIRS, "SELECT a, b, 30 AS n, round(r, 6) + 0.0 AS r FROM co"))
def pearson_pairs(spark, d):
    return corr(spark, d).select("a", "b", "n", r("r").alias("r"))


# With 30 bins there are 28 degrees of freedom, for which p is a finite sum: 1 - |r| sum_k (2k over k) / 4^k (1 - r^2)^k, k < 14.
P28 = "1 - abs(r) * (" + " + ".join(f"{comb(2 * k, k) / 4 ** k!r} * pow(1 - r * r, {k})" for k in range(14)) + ")"


@query("pearson_pvalue", with_views("activity", DAYS, PAIRS, f"SELECT a, b, round(r, 6) + 0.0 AS r, round({P28}, 6) + 0.0 AS p FROM co"))
def pearson_pvalue(spark, d):
    return corr(spark, d, with_p=True).select("a", "b", r("r").alias("r"), r("p").alias("p"))


@query("join_pairs", with_views("activity", "s AS (SELECT DISTINCT cell_id, frame // 24 AS bin FROM activity)",
    "SELECT p.cell_id AS a, q.cell_id AS b, count(*) AS bins FROM s p JOIN s q ON p.bin = q.bin AND p.cell_id < q.cell_id GROUP BY 1, 2"))
def join_pairs(spark, d):
    from engram.functions.pairs import pair_products
    return pair_products(days(spark, d), None, [], "cell_id", "bin", "v", sums=False).select("a", "b", F.col("n").alias("bins"))


# Day bins of each kind of event as sessions of their own: the same cells, recorded several times.
SESSION_DAYS = """dy AS (SELECT kind AS session, unit_id AS cell_id, t_us // 86400000000 AS bin, sum(value) AS v FROM spikes GROUP BY 1, 2, 3), cells AS (SELECT DISTINCT session, cell_id FROM dy),
    bins AS (SELECT CAST(unnest(range(0, 30)) AS BIGINT) AS bin)"""
SESSION_PAIRS = """gr AS (SELECT c.session, c.cell_id, b.bin, coalesce(dy.v, 0.0) AS v FROM cells c CROSS JOIN bins b LEFT JOIN dy ON dy.session = c.session AND dy.cell_id = c.cell_id AND dy.bin = b.bin),
    st AS (SELECT session, cell_id, avg(v) AS mu, stddev_pop(v) AS sd FROM gr GROUP BY 1, 2 HAVING stddev_pop(v) > 1e-9),
    z AS (SELECT session, cell_id, bin, (v - mu) / sd AS z FROM gr JOIN st USING (session, cell_id)),
    co AS (SELECT p.session, p.cell_id AS a, q.cell_id AS b, sum(p.z * q.z) / 30 AS r FROM z p JOIN z q ON p.session = q.session AND p.bin = q.bin AND p.cell_id < q.cell_id GROUP BY 1, 2, 3)"""


def session_days(spark, d):
    return (S.spikes(spark, d).groupBy(F.col("kind").alias("session"), F.col("unit_id").alias("cell_id"), F.expr("t_us div 86400000000").alias("bin"))
            .agg(F.sum("value").alias("v")))


def above(spark, d, r_min):
    """Pairs of a session from a threshold on; the others are never written."""
    return P.pearson_above(session_days(spark, d), SESSION, "cell_id", "bin", "v", 30, r_min)


@query("corr_graph", with_views("spikes", SESSION_DAYS, SESSION_PAIRS, f"SELECT session, a AS src, b AS dst, round(r, 6) + 0.0 AS w FROM co WHERE r >= 0.4 AND {P28} < 0.1"))
def corr_graph(spark, d):
    return H_graph(spark, d).withColumn("w", r("w"))


def H_graph(spark, d, r_min=0.4):
    return P.corr_graph(above(spark, d, r_min), r_min, 0.1)


@query("corr_threshold", with_views("spikes", SESSION_DAYS, SESSION_PAIRS, f"SELECT session, a, b, round(r, 6) + 0.0 AS r, round({P28}, 6) + 0.0 AS p FROM co WHERE r >= 0.3 AND {P28} <= 0.05"))
def corr_threshold(spark, d):
    from engram.operators.filters import corr_threshold as keep
    return keep(above(spark, d, 0.3), p_max=0.05, r_min=0.3).select("session", "a", "b", r("r").alias("r"), r("p").alias("p"))


OV = """sz AS (SELECT cell_id, count(*) AS n FROM pixels GROUP BY 1),
    ov AS (SELECT p.cell_id AS cell1, q.cell_id AS cell2, count(*) AS px FROM pixels p JOIN pixels q ON p.x = q.x AND p.y = q.y AND p.cell_id < q.cell_id GROUP BY 1, 2),
    op AS (SELECT cell1, cell2, px, px / s1.n AS p1, px / s2.n AS p2 FROM ov JOIN sz s1 ON s1.cell_id = cell1 JOIN sz s2 ON s2.cell_id = cell2),
    ed AS (SELECT cell1 AS src, cell2 AS dst FROM op WHERE greatest(p1, p2) >= 0.18)"""


def overlaps(spark, d, least=None):
    return P.overlap_pixels(S.pixels(spark, d), [], "cell_id", 64, least=least)


def edges(spark, d):
    return P.candidate_pairs_overlap(overlaps(spark, d, 0.18), 0.18)


@query("overlap_pixels", with_views("pixels", OV, "SELECT cell1, cell2, px AS pixels_overlap, round(p1, 6) + 0.0 AS percent_cell1, round(p2, 6) + 0.0 AS percent_cell2 FROM op"))
def overlap_pixels(spark, d):
    return overlaps(spark, d).withColumn("percent_cell1", r("percent_cell1")).withColumn("percent_cell2", r("percent_cell2"))


@query("candidate_pairs_overlap", with_views("pixels", OV, "SELECT * FROM ed"))
def candidate_pairs_overlap(spark, d):
    return edges(spark, d)


@query("candidate_pairs_center", with_views("pixels spikes", CENT, SESSION_DAYS, SESSION_PAIRS, """SELECT co.session, p.cell_id AS src, q.cell_id AS dst FROM ct p JOIN ct q ON p.cell_id < q.cell_id JOIN co ON co.a = p.cell_id AND co.b = q.cell_id
    WHERE sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)) <= 4 AND co.r >= 0.2"""))
def candidate_pairs_center(spark, d):
    dist = J.centroid_distance(S.pixels(spark, d), [], "cell_id", 4.0)
    return P.candidate_pairs_center(dist, session_days(spark, d), SESSION, "cell_id", "bin", "v", 30, 4.0, 0.2)


COMP = """ar AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
    cc(node, lab) AS (SELECT src, src FROM ar UNION SELECT ar.dst, cc.lab FROM cc JOIN ar ON ar.src = cc.node)"""


@query("components", with_views("pixels", OV, COMP, "SELECT node, min(lab) AS component FROM cc GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1))
def components(spark, d):
    return H.components(edges(spark, d))


# One removal at a time: the node of the highest degree goes (tie: largest id) until no edge is left.
HUB = """h(edges, node, degree) AS (SELECT (SELECT list({'s': src, 'd': dst}) FROM ed), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
    SELECT list_filter(edges, lambda e: e.s <> n.node AND e.d <> n.node), n.node, n.deg FROM h, LATERAL (SELECT node, count(*) AS deg FROM (SELECT unnest(list_concat(list_transform(h.edges, lambda e: e.s),
        list_transform(h.edges, lambda e: e.d))) AS node) GROUP BY node ORDER BY deg DESC, node DESC LIMIT 1) n WHERE len(edges) > 0)"""


@query("dedup_hub", with_views("pixels", OV, HUB, "SELECT node, degree FROM h WHERE node IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1))
def dedup_hub(spark, d):
    return H.dedup_hub(edges(spark, d))


@query("set_except_removed", with_views("pixels", OV, HUB, "SELECT DISTINCT cell_id FROM pixels WHERE cell_id NOT IN (SELECT node FROM h WHERE node IS NOT NULL)").replace("WITH ", "WITH RECURSIVE ", 1))
def set_except_removed(spark, d):
    """Cells left after the duplicates are taken out."""
    cells = S.pixels(spark, d).select("cell_id").distinct()
    gone = H.dedup_hub(edges(spark, d)).select(F.col("node").alias("cell_id"))
    return cells.join(gone, "cell_id", "left_anti")


SNR = "sn AS (SELECT unit AS node, avg(signal) / stddev_pop(signal) AS snr FROM tracking GROUP BY 1)"
DED = """cm AS (SELECT node, min(lab) AS component FROM cc GROUP BY 1),
    dg AS (SELECT src AS node, count(*) AS degree FROM ar GROUP BY 1),
    rk AS (SELECT component, node, row_number() OVER (PARTITION BY component ORDER BY {order}) AS rk FROM cm JOIN sn USING (node) JOIN dg USING (node)),
    lm AS (SELECT session, a.component, max(least(a.rk, b.rk)) AS k FROM co JOIN rk a ON a.node = co.a JOIN rk b ON b.node = co.b AND b.component = a.component WHERE r > 0.1 GROUP BY 1, 2)"""


def _dedup_sql(order):
    return with_views("pixels tracking spikes", OV, COMP, SESSION_DAYS, SESSION_PAIRS, SNR, DED.format(order=order),
                      "SELECT session, node, component FROM rk JOIN lm USING (component) WHERE rk <= k").replace("WITH ", "WITH RECURSIVE ", 1)


def _snr(spark, d):
    return Q.trace_stats(S.tracking(spark, d), ["unit"], "signal").select(F.col("unit").alias("node"), "snr")


def alike(spark, d, comps):
    return H.within_components(comps, session_days(spark, d), SESSION, "cell_id", "bin", "v", 30, 0.1)


@query("dedup_snr", _dedup_sql("snr, node"))
def dedup_snr(spark, d):
    comps = H.components(edges(spark, d))
    return H.dedup_snr(comps, alike(spark, d, comps), _snr(spark, d), SESSION)


@query("dedup_hub_snr", _dedup_sql("degree DESC, snr, node"))
def dedup_hub_snr(spark, d):
    e = edges(spark, d)
    comps = H.components(e)
    return H.dedup_hub_snr(comps, alike(spark, d, comps), _snr(spark, d), e, SESSION)


G = f"""eg AS (SELECT session, a AS src, b AS dst FROM co WHERE r >= 0.4 AND {P28} < 0.1), en AS (SELECT session, src AS node FROM eg UNION ALL SELECT session, dst FROM eg),
    dg AS (SELECT session, node, count(*) AS degree FROM en GROUP BY 1, 2)"""


def graph_sql(text):
    return with_views("spikes", SESSION_DAYS, SESSION_PAIRS, G, text)


@query("degree_dist", graph_sql("SELECT session, degree // 2 * 2 AS degree_from, count(*) AS nodes FROM dg GROUP BY 1, 2"))
def degree_dist(spark, d):
    return H.degree_dist(H_graph(spark, d), keys=SESSION)


@query("degree_median", graph_sql("SELECT session, count(*) AS nodes, CAST(median(degree) AS DOUBLE) AS median_degree, round(avg(degree), 6) + 0.0 AS mean_degree FROM dg GROUP BY 1"))
def degree_median(spark, d):
    return H.degree_median(H_graph(spark, d), SESSION).withColumn("mean_degree", r("mean_degree"))


@query("isolates_ratio", with_views("spikes", SESSION_DAYS, SESSION_PAIRS, "nr AS (SELECT session, node, max(r) AS r FROM (SELECT session, a AS node, r FROM co UNION ALL SELECT session, b, r FROM co) GROUP BY 1, 2)",
    """SELECT c.session, t AS threshold, round(1 - count(*) FILTER (WHERE r >= t) / count(*), 6) + 0.0 AS isolates FROM cells c LEFT JOIN nr ON nr.session = c.session AND nr.node = c.cell_id
    CROSS JOIN (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) v(t) GROUP BY 1, 2"""))
def isolates_ratio(spark, d):
    n = session_days(spark, d).groupBy("session").agg(F.countDistinct("cell_id").alias("n_cells"))
    return H.isolates_ratio(above(spark, d, 0.3), n, [0.3, 0.4, 0.5, 0.6], SESSION).withColumn("isolates", r("isolates"))


@query("graph_density", graph_sql("""SELECT session, nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 6) + 0.0 AS density FROM (SELECT session, count(*) AS nodes FROM dg GROUP BY 1)
    JOIN (SELECT session, count(*) AS edges FROM eg GROUP BY 1) USING (session)"""))
def graph_density(spark, d):
    return H.graph_density(H_graph(spark, d), SESSION).withColumn("density", r("density"))


@query("corr_degree", graph_sql("SELECT session, node, degree FROM dg"))
def corr_degree(spark, d):
    return H.degrees(H_graph(spark, d), SESSION)


@query("degree_prune", graph_sql("SELECT eg.session, src, dst FROM eg JOIN dg a ON a.session = eg.session AND a.node = src JOIN dg b ON b.session = eg.session AND b.node = dst WHERE a.degree >= 3 AND b.degree >= 3"))
def degree_prune(spark, d):
    from engram.operators.filters import degree_prune as prune
    return prune(H_graph(spark, d).select("session", "src", "dst"), 3, SESSION)


@query("subsample_nodes", graph_sql("SELECT session, node FROM dg QUALIFY row_number() OVER (PARTITION BY session ORDER BY (node * 7919 + 104729) % 1000003, node) <= 10"))
def subsample_nodes(spark, d):
    return H.subsample_nodes(H.degrees(H_graph(spark, d), SESSION).select("session", "node"), "node", 10, 1, SESSION)


@query("set_union_sessions", with_views("spikes", "SELECT kind AS session, event_id AS frame, value FROM spikes"))
def set_union_sessions(spark, d):
    # the sessions lie in one table, so their union is one scan of it
    return S.spikes(spark, d).select(F.col("kind").alias("session"), F.col("event_id").alias("frame"), "value")


@query("set_intersect_frames", with_views("activity", "SELECT frame FROM activity WHERE cell_id % 2 = 0 AND n >= 2 INTERSECT SELECT frame FROM activity WHERE cell_id % 2 = 1 AND n >= 2"))
def set_intersect_frames(spark, d):
    a = S.activity(spark, d).filter("n >= 2")
    return a.filter("cell_id % 2 = 0").select("frame").intersect(a.filter("cell_id % 2 = 1").select("frame"))
