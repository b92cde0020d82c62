"""Sources, sinks, cohorts and trends."""

from pyspark.sql import functions as F

from engram.functions.exprs import rounded as r
from engram.operators import cohort as C, signal as G
from engram.plans import q_sequences as QS
from engram.plans.q_pairs import DAYS, PAIRS, corr
from engram.plans.registry import query
from engram.sources import files as R, tables as S
from engram.sources.tables import with_views

LIST = "ls AS (SELECT a.animal, s.session FROM (SELECT DISTINCT animal FROM sessions) a CROSS JOIN (SELECT CAST(unnest(range(1994, 2003)) AS INTEGER) AS session) s)"


def wanted(spark, d):
    """Session list of every animal, with years in which nothing was recorded."""
    return S.sessions(spark, d).select("animal").distinct().withColumn("session", F.explode(F.sequence(F.lit(1994), F.lit(2002))))


@query("cohort_cells", with_views("sessions", LIST, "SELECT ls.animal, ls.session, c AS cells FROM ls LEFT JOIN (SELECT animal, session, count(DISTINCT cell_id) AS c FROM sessions GROUP BY 1, 2) x USING (animal, session)"))
def cohort_cells(spark, d):
    return C.cohort_cells(S.sessions(spark, d), wanted(spark, d), "cell_id")


@query("cohort_duration", with_views("sessions", LIST, "SELECT ls.animal, ls.session, round(c / 30.0::DOUBLE, 6) + 0.0 AS seconds FROM ls LEFT JOIN (SELECT animal, session, count(*) AS c FROM sessions GROUP BY 1, 2) x USING (animal, session)"))
def cohort_duration(spark, d):
    return C.cohort_duration(S.sessions(spark, d), wanted(spark, d)).withColumn("seconds", r("seconds"))


@query("cohort_running", with_views("sessions", LIST, "SELECT ls.animal, ls.session, round(c, 6) + 0.0 AS running FROM ls LEFT JOIN (SELECT animal, session, avg(CASE WHEN v > 200000 THEN 1.0::DOUBLE ELSE 0 END) AS c FROM sessions GROUP BY 1, 2) x USING (animal, session)"))
def cohort_running(spark, d):
    return C.cohort_running(S.sessions(spark, d), wanted(spark, d), "v", 200000.0).withColumn("running", r("running"))


@query("cohort_distance", with_views("sessions", LIST, "SELECT ls.animal, ls.session, round(c / 1000, 4) + 0.0 AS distance FROM ls LEFT JOIN (SELECT animal, session, sum(v) AS c FROM sessions GROUP BY 1, 2) x USING (animal, session)"))
def cohort_distance(spark, d):
    return C.cohort_distance(S.sessions(spark, d), wanted(spark, d), "v").withColumn("distance", r(F.col("distance") / 1000, 4))


@query("cohort_totals", with_views("sessions", "SELECT animal, session, count(*) AS frames, count(DISTINCT cell_id) AS cells, round(sum(v) / 1000, 3) + 0.0 AS distance FROM sessions GROUP BY ROLLUP (animal, session)"))
def cohort_totals(spark, d):
    return C.cohort_totals(S.sessions(spark, d), "cell_id", "v").withColumn("distance", r(F.col("distance") / 1000, 3))


METRIC = "mt AS (SELECT animal, session, avg(v) / 1000 AS y FROM sessions GROUP BY 1, 2)"


def metric(spark, d):
    return S.sessions(spark, d).groupBy("animal", "session").agg((F.avg("v") / 1000).alias("y"))


@query("trend_fit", with_views("sessions", METRIC, "SELECT animal, round(regr_slope(y, session), 6) + 0.0 AS slope, round(regr_intercept(y, session), 3) + 0.0 AS intercept, count(*) AS n, round(corr(y, session), 6) + 0.0 AS r FROM mt GROUP BY 1"))
def trend_fit(spark, d):
    return C.trend_fit(metric(spark, d), ["animal"], "session", "y").select("animal", r("slope").alias("slope"), r("intercept", 3).alias("intercept"), "n", r("r").alias("r"))


@query("trend_pvalue")
def trend_pvalue(spark, d):
    return C.trend_fit(metric(spark, d), ["animal"], "session", "y").select("animal", r("p").alias("p"))


@query("trend_quadratic", with_views("sessions", METRIC, """c AS (SELECT animal, avg(session) AS m FROM mt GROUP BY 1), u AS (SELECT animal, session - m AS u, y, m FROM mt JOIN c USING (animal)),
    s AS (SELECT animal, any_value(m) AS m, count(*) AS n, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS t0, sum(u*y) AS t1, sum(u*u*y) AS t2 FROM u GROUP BY 1)""",
    """SELECT animal, round((n * (s2 * t2 - t1 * s3) - s2 * s2 * t0) / (n * (s2 * s4 - s3 * s3) - s2 * s2 * s2), 5) + 0.0 AS a FROM s"""))
def trend_quadratic(spark, d):
    return C.trend_quadratic(metric(spark, d), ["animal"], "session", "y").select("animal", r("a", 5).alias("a"))


@query("top_cells", with_views("sessions", """c AS (SELECT animal, session, cell_id, max(day) AS last FROM sessions GROUP BY 1, 2, 3),
    e AS (SELECT animal, session FROM c GROUP BY 1, 2 HAVING count(*) >= 200 AND max(last) + 1 >= 1500), k AS (SELECT animal, session, cell_id, row_number() OVER (PARTITION BY animal, session ORDER BY cell_id) AS rk FROM c)""",
    "SELECT s.animal, s.session, s.cell_id, s.frame FROM sessions s JOIN e USING (animal, session) JOIN k ON k.animal = s.animal AND k.session = s.session AND k.cell_id = s.cell_id WHERE rk <= 200 AND s.day < 1500"))
def top_cells(spark, d):
    return C.top_cells(S.sessions(spark, d), ["animal", "session"], "cell_id", "day", 200, 1500).select("animal", "session", "cell_id", "frame")


@query("src_traces", with_views("traces", "c AS (SELECT cell_id FROM activity GROUP BY 1 HAVING sum(n) >= 65)", "SELECT cell_id, frame, round(f, 4) + 0.0 AS f FROM traces WHERE cell_id IN (SELECT cell_id FROM c)"))
def src_traces(spark, d):
    cells = S.activity(spark, d).groupBy("cell_id").agg(F.when(F.sum("n") >= 65, 1).otherwise(0).alias("is_cell"))
    return R.read_traces(S.traces(spark, d), cells, ["cell_id"]).select("cell_id", "frame", r("f", 4).alias("f"))


@query("src_trace_csv", "SELECT event_id, event_id * 5e-2 AS t, CAST(k AS INTEGER) AS cell_id, round((CASE k WHEN 0 THEN value ELSE user_id END) / 1000, 6) + 0.0 AS f FROM events CROSS JOIN (VALUES (0), (1)) v(k)")
def src_trace_csv(spark, d):
    """Lines as a two-cell trace file holds them, header included."""
    ev = S.table(spark, d, "events")
    line = F.concat_ws(",", (F.col("event_id") * F.lit(0.05)).cast("string"), F.col("value").cast("string"), F.col("user_id").cast("string"))
    lines = ev.select("event_id", line.alias("value")).unionByName(ev.agg(F.max("event_id").alias("event_id"), F.first(F.lit("Time(s),accepted,accepted")).alias("value")))
    return R.parse_trace_lines(lines, "value", 2, 1000.0, ["event_id"]).withColumn("f", r("f"))


@query("src_tracking_csv", with_views("tracking", "SELECT unit, ok AS frame, CAST(k AS INTEGER) AS part, CASE k WHEN 0 THEN x ELSE CAST(ln AS DOUBLE) END AS x, CASE k WHEN 0 THEN y ELSE CAST(pk AS DOUBLE) END AS y, CASE k WHEN 0 THEN 0.5::DOUBLE ELSE 1.0 END AS likelihood, t FROM tracking CROSS JOIN (VALUES (0), (1)) v(k)"))
def src_tracking_csv(spark, d):
    c = [F.col(n).cast("string") for n in ("ok", "x", "y")] + [F.lit("0.5")] + [F.col(n).cast("string") for n in ("ln", "pk")] + [F.lit("1.0")]
    lines = S.tracking(spark, d).select("unit", "t", F.concat_ws(",", *c).alias("value"))
    return R.parse_tracking_lines(lines, "value", 2, ["unit", "t"]).select("unit", "frame", "part", "x", "y", "likelihood", "t")


@query("src_belt", with_views("track", """n AS (SELECT session, count(*) AS n FROM track GROUP BY 1), o AS (SELECT session, coalesce(sum(n) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n)""",
    "SELECT session, CAST(frame + off AS BIGINT) AS frame_all, x AS pos FROM track JOIN o USING (session)"))
def src_belt(spark, d):
    return R.concat_belts(S.track(spark, d), [], "session", "frame").select("session", "frame_all", F.col("x").alias("pos"))


@query("src_wheel", with_views("spikes", QS.CLICK, "SELECT unit_id, event_id, CAST(sum(-click) OVER (PARTITION BY unit_id ORDER BY t_us) AS BIGINT) AS position, round(sum(-click) OVER (PARTITION BY unit_id ORDER BY t_us) * 2e-3, 6) + 0.0 AS distance FROM c"))
def src_wheel(spark, d):
    out = R.wheel(QS.clicks(spark, d), ["unit_id"], "t_us", QS.minute(), "click", 0.002)
    return out.select("unit_id", "event_id", "position", r("distance").alias("distance"))


@query("src_spikes", with_views("spikes", "SELECT unit_id, event_id, round(t_us / 1e6 - 86400, 6) + 0.0 AS seconds FROM spikes WHERE t_us / 1e6 >= 86400"))
def src_spikes(spark, d):
    return R.shift_spikes(S.spikes(spark, d), "t_us", 1e6, 86400.0).select("unit_id", "event_id", r("seconds").alias("seconds"))


@query("src_sessions", "SELECT c_custkey AS animal, CAST(k AS INTEGER) AS pos, CASE k WHEN 0 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS session FROM customer CROSS JOIN (VALUES (0), (1)) v(k)")
def src_sessions(spark, d):
    sheet = S.table(spark, d, "customer").select(F.col("c_custkey").alias("animal"), F.concat_ws(" , ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("ids"))
    return R.session_list(sheet, "animal", "ids")


@query("src_sessions_yaml", with_views("sessions", "SELECT animal, session, cell_id, frame FROM sessions WHERE session = 1997"))
def src_sessions_yaml(spark, d):
    return R.select_sessions(S.sessions(spark, d), "session", 1997).select("animal", "session", "cell_id", "frame")


@query("sink_pday", with_views("sessions", "SELECT animal, session, CAST(21 + row_number() OVER (PARTITION BY animal ORDER BY session) - 1 AS INTEGER) AS pday FROM (SELECT DISTINCT animal, session FROM sessions)"))
def sink_pday(spark, d):
    s = S.sessions(spark, d).select("animal", "session").distinct().withColumn("start", F.lit(21))
    return R.number_pdays(s, ["animal"], "session", "start").select("animal", "session", "pday")


def shared_folder(spark, name):
    """A new folder below the shared checkpoint folder of the cluster."""
    import uuid
    from engram.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


LAYERS = ["raw", "filtered", "detrended", "derivative", "scaled"]


@query("sink_activity", QS.recursive_views("traces", QS._LOW, QS.filtered_sql("slow", *QS.low_sql(1, 0.6, 30.0), "low", "cell_id", "low", renorm=True, pad=600),
    "nn AS (SELECT cell_id, (count(*) - 1) / 2.0 AS mid FROM traces GROUP BY 1)",
    "ft AS (SELECT cell_id, avg(slow) AS c0, sum(slow * (frame - mid)) / sum(pow(frame - mid, 2)) AS c1 FROM slow JOIN nn USING (cell_id) GROUP BY 1)",
    "dt AS (SELECT cell_id, frame, f, low, low - c0 - c1 * (frame - mid) AS d FROM low JOIN traces USING (cell_id, frame) JOIN nn USING (cell_id) JOIN ft USING (cell_id))",
    """dv AS (SELECT *, CASE WHEN lag(d) OVER w IS NULL THEN lead(d) OVER w - d WHEN lead(d) OVER w IS NULL THEN d - lag(d) OVER w ELSE (lead(d) OVER w - lag(d) OVER w) / 2 END AS g,
        stddev_pop(d) OVER (PARTITION BY cell_id) AS sd FROM dt WINDOW w AS (PARTITION BY cell_id ORDER BY frame))""",
    """SELECT cell_id, frame, round(f, 4) + 0.0 AS raw, round(low, 4) + 0.0 AS filtered, round(d, 4) + 0.0 AS detrended, round(g, 4) + 0.0 AS derivative, CASE WHEN d >= sd THEN 1 ELSE 0 END AS onphase,
    CASE WHEN d >= sd AND g > 0 THEN 1 ELSE 0 END AS upphase, round(CASE WHEN d >= sd THEN d ELSE 0 END, 4) + 0.0 AS scaled, CAST(cell_id % 7 AS INTEGER) AS session, CAST(0 AS BIGINT) AS written_again FROM dv"""))
def sink_activity(spark, d):
    """All layers of two sessions, then of all sessions, which adds the others only, then once more, which adds nothing."""
    path = shared_folder(spark, "activity")
    traces = S.traces(spark, d).withColumn("session", (F.col("cell_id") % 7).cast("int"))
    layers = lambda t: G.activity_layers(t, ["session", "cell_id"], "frame", "f", 1.0, 0.6, 30.0)
    R.write_layers(traces.filter("session < 2"), path, "session", layers, "low 1.0, trend 0.6")
    R.write_layers(traces, path, "session", layers, "low 1.0, trend 0.6")
    again = R.write_layers(traces, path, "session", layers, "low 1.0, trend 0.6")
    out = spark.read.parquet(f"{path}/layers").withColumns({c: r(c, 4) for c in LAYERS})
    return out.select("cell_id", "frame", *LAYERS, "onphase", "upphase", F.col("session").cast("int").alias("session"), F.lit(again).cast("long").alias("written_again"))


@query("sink_corr", with_views("activity", DAYS, PAIRS, "SELECT a, b, round(r, 6) + 0.0 AS r FROM co"))
def sink_corr(spark, d):
    """The second write finds the correlations of half of the cells in place and adds the others only."""
    path = shared_folder(spark, "corr")
    c = corr(spark, d).select("a", "b", r("r").alias("r"))
    R.write_missing(c.filter("a % 2 = 0"), path, ["a", "b"])
    R.write_missing(c, path, ["a", "b"])
    return spark.read.parquet(path)
