"""Null distributions, population states and decoding."""

from pyspark.sql import functions as F

from engram.functions.exprs import rounded as r
from engram.operators import decode as E, fields as D, joins as J, maps as M, nulls as N, pairs as P, signal as G
from engram.plans.q_pairs import DAYS, predicted, PRED
from engram.operators.filters import mobile_split
from engram.plans.registry import query
from engram.sources import tables as S
from engram.sources.tables import with_views

HOUR = S.HOUR_US
NF = "(SELECT max(frame) + 1 FROM activity)"


def frames_of(activity):
    """Number of frames of the recording as a joined one-row column ``nf``."""
    return activity.crossJoin(F.broadcast(activity.agg((F.max("frame") + 1).alias("nf"))))


SHUFFLES = N.SHUFFLES
DRAW = lambda ids, k="k", seed=0: f"CAST('0x' || left(md5('{seed}:' || {ids} || ':' || {k}), 8) AS BIGINT)"
NUMBERS = lambda lo, hi: f"(SELECT CAST(unnest(range({lo}, {hi + 1})) AS INTEGER) AS k)"
# one shift per cell and shuffle, in the middle three fifths; shuffle 0 is the recording itself
SHIFTS = f"""sh AS (SELECT cell_id, k, nf, CASE WHEN k = 0 THEN 0 ELSE nf // 5 + {DRAW("cell_id")} % greatest(3 * (nf // 5), 1) END AS s
    FROM (SELECT DISTINCT cell_id FROM activity) CROSS JOIN {NUMBERS(0, SHUFFLES)} CROSS JOIN (SELECT {NF} AS nf))"""
SHUF = "sf AS (SELECT cell_id, k AS shuffle, (frame + s) % nf AS frame, f FROM activity JOIN sh USING (cell_id))"


def digest(df, keys, value, *more):
    return df.groupBy(*keys).agg(*more, F.count(F.lit(1)).alias("n"), F.min(value).alias("first"), F.max(value).alias("last"), F.sum(value).alias("total"))


@query("circ_shift", with_views("activity", SHIFTS, SHUF, """SELECT cell_id, shuffle, round(sum(f * frame), 2) + 0.0 AS moment, count(*) AS n, min(frame) AS first, max(frame) AS last,
    CAST(sum(frame) AS BIGINT) AS total FROM sf GROUP BY 1, 2"""))
def circ_shift(spark, d):
    """Every shuffle of every cell, told by its number of rows, first, last and summed frame, and sum of value times frame."""
    rolled = N.circ_shift(frames_of(S.activity(spark, d)), "cell_id", "frame", F.col("nf"))
    return digest(rolled, ["cell_id", "shuffle"], "frame", r(F.sum(F.col("f") * F.col("frame")), 2).alias("moment"))


SPAN = 720 * HOUR
@query("shuffle_times", with_views("spikes", f"""of AS (SELECT unit_id, k AS iteration, {HOUR} + ({DRAW("unit_id")} * 1048576 + {DRAW("unit_id", seed=1)} % 1048576) % {SPAN - 2 * HOUR + 1} AS o
    FROM (SELECT DISTINCT unit_id FROM spikes) CROSS JOIN {NUMBERS(1, SHUFFLES)}),
    i AS (SELECT unit_id, iteration, CASE WHEN t_us + o > {SPAN} THEN t_us + o - {SPAN} ELSE t_us + o END AS t FROM spikes JOIN of USING (unit_id))""",
    "SELECT unit_id, iteration, count(*) AS n, min(t) AS first, max(t) AS last, CAST(sum(t) AS BIGINT) AS total FROM i GROUP BY 1, 2"))
def shuffle_times(spark, d):
    """Every iteration of every spike train, told by its number of spikes and its first, last and summed time."""
    s = S.spikes(spark, d).select("unit_id", "t_us")
    return digest(N.shuffle_times(s, "unit_id", "t_us", HOUR, 0, SPAN), ["unit_id", "iteration"], "t_us")


@query("shuffle_rasters", with_views("activity", f"SELECT cell_id, (frame + (cell_id * 7919 + 104729) % nf) % nf AS frame, n FROM activity CROSS JOIN (SELECT {NF} AS nf)"))
def shuffle_rasters(spark, d):
    return N.shuffle_rasters(frames_of(S.activity(spark, d)), "cell_id", "frame", F.col("nf")).select("cell_id", "frame", "n")


def day_sums(spark, d):
    return S.activity(spark, d).groupBy("cell_id", F.floor(F.col("frame") / 24).alias("bin")).agg(F.sum("f").alias("v"))


def z_sql(weights):
    """z over rolls of the right cell; a weight table w(b, s, w) holds how often each roll is drawn."""
    return (f"""gr AS (SELECT c.cell_id, b.bin, coalesce(dy.v, 0.0) AS v FROM cells c CROSS JOIN bins b LEFT JOIN dy ON dy.cell_id = c.cell_id AND dy.bin = b.bin),
    {weights},
    rr AS (SELECT p.cell_id AS a, q.cell_id AS b, (p.bin - q.bin + 30) % 30 AS s, sum(p.v * q.v) AS c FROM gr p JOIN gr q ON q.cell_id > p.cell_id GROUP BY 1, 2, 3),
    mm AS (SELECT a, b, sum(w * c) / sum(w) AS m, max(c) FILTER (WHERE s = 0) AS c0, max(abs(c)) AS top FROM rr JOIN w USING (b, s) GROUP BY 1, 2),
    vv AS (SELECT a, b, sqrt(sum(w * (c - m) * (c - m)) / sum(w)) AS sd FROM rr JOIN w USING (b, s) JOIN mm USING (a, b) GROUP BY 1, 2)""",
    "SELECT a, b, CASE WHEN sd > 1e-9 * top THEN round((c0 - m) / sd, 5) + 0.0 END AS z FROM mm JOIN vv USING (a, b)")


@query("corr_zscore", with_views("activity", DAYS, *z_sql(f"""w AS (SELECT b, s, count(*) AS w FROM (SELECT cell_id AS b, {DRAW("cell_id")} % 30 AS s FROM cells CROSS JOIN {NUMBERS(1, SHUFFLES)}
    UNION ALL SELECT cell_id, 0 FROM cells) GROUP BY 1, 2)""")))
def corr_zscore(spark, d):
    """1,000 keyed rolls per cell."""
    return N.corr_zscore(day_sums(spark, d), [], "cell_id", "bin", "v", 30).select("a", "b", r("z", 5).alias("z"))


@query("corr_zscore_full", with_views("activity", DAYS, *z_sql("w AS (SELECT cell_id AS b, bin AS s, 1 AS w FROM cells CROSS JOIN bins)")))
def corr_zscore_full(spark, d):
    """Every roll of the recording once."""
    return N.corr_zscore(day_sums(spark, d), [], "cell_id", "bin", "v", 30, rolls=None).select("a", "b", r("z", 5).alias("z"))


# Position of the animal per frame, taken from the whole population of events in that hour.
POS = f"pos AS (SELECT t_us // {HOUR} AS frame, CAST(count(*) % 5 AS INTEGER) AS iy, CAST(least(floor(avg(value) / 10), 9) AS INTEGER) AS ix FROM spikes GROUP BY 1)"
SI = """oc AS (SELECT iy, ix, count(*) AS seconds, sum(count(*)) OVER () AS total FROM pos GROUP BY 1, 2),
    mp AS (SELECT cell_id, shuffle, iy, ix, sum(f) AS f FROM sf JOIN pos USING (frame) GROUP BY 1, 2, 3, 4),
    mn AS (SELECT cell_id, shuffle, sum(f) / max(total) AS m FROM mp JOIN oc USING (iy, ix) GROUP BY 1, 2),
    si AS (SELECT cell_id, shuffle, sum(seconds / total * (f / seconds) * log2(greatest(f / seconds / m, 1))) / max(m) AS si FROM mp JOIN oc USING (iy, ix) JOIN mn USING (cell_id, shuffle) GROUP BY 1, 2),
    zz AS (SELECT cell_id, max(si) FILTER (WHERE shuffle = 0) AS si, (max(si) FILTER (WHERE shuffle = 0) - avg(si)) / stddev_pop(si) AS z FROM si GROUP BY 1)"""
BINS = ["iy", "ix"]


def positions(spark, d):
    return (S.spikes(spark, d).groupBy(F.expr(f"t_us div {HOUR}").alias("frame"))
            .agg((F.count(F.lit(1)) % 5).cast("int").alias("iy"), F.least(F.floor(F.avg("value") / 10), F.lit(9)).cast("int").alias("ix")))


def si_z(spark, d):
    return N.information_null(frames_of(S.activity(spark, d)), positions(spark, d), [], "cell_id", "frame", "f", BINS, F.col("nf"))


@query("si_zscore", with_views("activity", POS, SHIFTS, SHUF, SI, "SELECT cell_id, round(si, 6) + 0.0 AS si, round(z, 5) + 0.0 AS z FROM zz"))
def si_zscore(spark, d):
    """Within 1,000 shuffles."""
    return si_z(spark, d).select("cell_id", r("si").alias("si"), r("z", 5).alias("z"))


@query("place_cells", with_views("activity", POS, SHIFTS, SHUF, SI, "SELECT cell_id, round(z, 5) + 0.0 AS z FROM zz WHERE z > 1.5"))
def place_cells(spark, d):
    from engram.operators.filters import place_cells as keep
    return keep(si_z(spark, d), "z", 1.5).select("cell_id", r("z", 5).alias("z"))


@query("split_half", with_views("activity", f"SELECT cell_id, CASE WHEN frame >= nf // 2 THEN 1 ELSE 0 END AS half, round(sum(f), 4) + 0.0 AS f FROM activity CROSS JOIN (SELECT {NF} AS nf) GROUP BY 1, 2"))
def split_half(spark, d):
    h = N.split_half(frames_of(S.activity(spark, d)), "frame", F.col("nf"))
    return h.groupBy("cell_id", "half").agg(r(F.sum("f"), 4).alias("f"))


@query("split_half_minutes", with_views("activity", "SELECT cell_id, CAST(frame // 20 % 2 AS INTEGER) AS half, round(sum(f), 4) + 0.0 AS f FROM activity GROUP BY 1, 2"))
def split_half_minutes(spark, d):
    h = N.split_half(S.activity(spark, d), "frame", F.lit(0), 20)
    return h.groupBy("cell_id", "half").agg(r(F.sum("f"), 4).alias("f"))


@query("place_cell_test")
def place_cell_test(spark, d):
    """Information z over {all, halves, 1,000 shuffles}, overlap of the fields and coherence of the halves."""
    pos = positions(spark, d)
    occ = N.occupancy_of(pos, BINS)
    act = frames_of(S.activity(spark, d))
    z = N.information_null(act, pos, [], "cell_id", "frame", "f", BINS, F.col("nf"), halves=True)
    half = N.split_half(act, "frame", F.col("nf")).select("cell_id", (-1 - F.col("half")).alias("variant"), "frame", "f")
    maps = (half.join(pos, "frame").groupBy("cell_id", "variant", *BINS).agg(F.sum("f").alias("_f"))
                .join(occ, BINS).withColumn("rate", F.col("_f") / F.col("seconds")).select("cell_id", "variant", *BINS, "rate"))
    keys = ["cell_id", "variant"]
    # Bins the animal visited without activity of the cell are part of its map with rate 0; the visited bins are as many as the arena has.
    visited = occ.agg(F.collect_list(F.struct(*BINS)).alias("_bins"))
    full = (maps.select(*keys).distinct().crossJoin(F.broadcast(visited)).select(*keys, F.inline("_bins")).join(maps, [*keys, *BINS], "left")
                 .withColumn("rate", F.coalesce("rate", F.lit(0.0))))
    sm = G.gauss_smooth(full, keys, "rate", 1.0, (5, 10)).select(*keys, *BINS, "smooth")
    fields = D.place_fields(sm, keys, "smooth", (5, 10), start=0.98, min_bins=5, min_peak=0.001, min_mean=0.1, relative=True, clear=0)
    overlap = P.field_overlap(fields, ["cell_id"], "variant", -1, -2)
    coh = (M.coherence(sm, keys, "smooth", (5, 10)).groupBy("cell_id")
            .agg(F.max(F.when(F.col("variant") == -1, F.col("coherence"))).alias("coherence1"), F.max(F.when(F.col("variant") == -2, F.col("coherence"))).alias("coherence2")))
    out = z.join(overlap, "cell_id", "left").join(coh, "cell_id", "left")
    return out.select("cell_id", *[r(c, 5).alias(c) for c in ("si", "z", "overlap", "coherence1", "coherence2")])


@query("match_null", with_views("track", PRED, """sz AS (SELECT session, count(*) AS n FROM track GROUP BY 1)""",
    f"""sh AS (SELECT session, n, k, 1000 + {DRAW("session")} % 9000 AS s FROM sz CROSS JOIN {NUMBERS(1, 500)})""",
    """far AS (SELECT * FROM pd WHERE sqrt((px - x) * (px - x) + (py - y) * (py - y)) > 10),
    ar AS (SELECT session, list(x ORDER BY frame) AS xs, list(y ORDER BY frame) AS ys FROM track GROUP BY 1),
    nn AS (SELECT session, k, frame, list_min(list_transform(range(least(20, n - frame)), lambda j: pow(xs[(frame + j - s + 100 * n) % n + 1] - px, 2) + pow(ys[(frame + j - s + 100 * n) % n + 1] - py, 2))) AS m
        FROM far JOIN sh USING (session) JOIN ar USING (session))""",
    "SELECT session, k AS shuffle, count(*) AS total, count(*) FILTER (WHERE m < 16) AS hits FROM nn GROUP BY 1, 2"))
def match_null(spark, d):
    """500 rolls of the trajectory by 1,000 to 9,999 frames."""
    p = predicted(spark, d)
    far = F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2) > 10
    asked = p.withColumn("px", F.when(far, F.col("px"))).withColumn("py", F.when(far, F.col("py")))
    return N.match_null(asked, ["session"], "frame", "x", "y", "px", "py", 20, 4.0)


@query("random_distance", with_views("track", PRED, "sz AS (SELECT session, count(*) AS n FROM track GROUP BY 1)",
    """SELECT p.session, p.frame, round(sqrt((p.px - t.x) * (p.px - t.x) + (p.py - t.y) * (p.py - t.y)), 6) + 0.0 AS error FROM pd p JOIN sz USING (session)
    JOIN track t ON t.session = p.session AND t.frame = (p.frame * CASE WHEN n % 7919 = 0 THEN 104729 ELSE 7919 END + 13) % n"""))
def random_distance(spark, d):
    return N.random_distance(predicted(spark, d), ["session"], "frame", "x", "y", "px", "py").withColumn("error", r("error"))


@query("decoder_error_profile", with_views("track", PRED, """e AS (SELECT session, CAST(floor(sqrt((px - x) * (px - x) + (py - y) * (py - y))) AS BIGINT) AS bin, count(*) AS c FROM pd GROUP BY 1, 2),
    t AS (SELECT session, sum(c) AS t FROM e GROUP BY 1), g AS (SELECT t.session, b.bin, coalesce(c, 0) / t AS p FROM t CROSS JOIN (SELECT DISTINCT bin FROM e) b LEFT JOIN e ON e.session = t.session AND e.bin = b.bin)""",
    "SELECT bin, round(avg(p), 6) + 0.0 AS mean, round(stddev_pop(p), 6) + 0.0 AS sd FROM g GROUP BY 1"))
def decoder_error_profile(spark, d):
    err = F.sqrt((F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y")))
    out = E.decoder_error_profile(predicted(spark, d).withColumn("e", err), "session", "e")
    return out.select("bin", r("mean").alias("mean"), r("sd").alias("sd"))


@query("position_state_mean", with_views("states", "SELECT position, dim, round(median(v), 6) + 0.0 AS median, round(stddev_pop(v), 6) + 0.0 AS sd FROM states GROUP BY 1, 2"))
def position_state_mean(spark, d):
    return E.position_state_mean(S.states(spark, d), "position", "dim", "v").select("position", "dim", r("median").alias("median"), r("sd").alias("sd"))


NEAR = """ce AS (SELECT position AS label, dim, median(v) AS c FROM states GROUP BY 1, 2),
    di AS (SELECT s.frame, ce.label, sum(abs(s.v - ce.c)) AS dist FROM states s JOIN ce USING (dim) GROUP BY 1, 2),
    ne AS (SELECT frame, label AS nearest, dist, row_number() OVER (PARTITION BY frame ORDER BY dist, label) AS rk FROM di)"""


def located(spark, d):
    med = E.position_state_mean(S.states(spark, d), "position", "dim", "v")
    cent = E.as_vectors(med, ["position"], "dim", "median", "c")
    return E.nearest_centroid(S.state_vectors(spark, d), "vec", cent, "position", "c")


@query("nearest_centroid", with_views("states", NEAR, "SELECT frame, nearest, round(dist, 6) + 0.0 AS distance FROM ne WHERE rk = 1"))
def nearest_centroid(spark, d):
    return located(spark, d).select("frame", "nearest", r("distance").alias("distance"))


TRAN = "tr AS (SELECT nearest AS src, lead(nearest) OVER (ORDER BY frame) AS dst FROM ne WHERE rk = 1)"


@query("transition_matrix", with_views("states", NEAR, TRAN, "SELECT src, dst, count(*) AS n FROM tr WHERE dst IS NOT NULL GROUP BY 1, 2"))
def transition_matrix(spark, d):
    return E.transition_matrix(located(spark, d), "frame", "nearest")


@query("state_graph", with_views("states", NEAR, TRAN, "SELECT src, dst, count(*) AS w FROM tr WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2"))
def state_graph(spark, d):
    from engram.operators.graph import state_graph as build
    return build(E.transition_matrix(located(spark, d), "frame", "nearest"), "src", "dst", "n")


@query("knn_triage", with_views("states", """pr AS (SELECT a.frame, b.frame AS other, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist FROM states a JOIN states b ON a.dim = b.dim GROUP BY 1, 2),
    rk AS (SELECT frame, dist, row_number() OVER (PARTITION BY frame ORDER BY dist) AS rk FROM pr), s AS (SELECT frame, sum(dist) AS knn FROM rk WHERE rk <= 6 GROUP BY 1)""",
    "SELECT frame, round(knn, 5) + 0.0 AS knn FROM s WHERE knn <= (SELECT quantile_cont(knn, 0.9) FROM s)"))
def knn_triage(spark, d):
    return E.knn_triage(S.state_vectors(spark, d), "frame", "vec", 0.1, slab_rows=200).select("frame", r("knn", 5).alias("knn"))


@query("pca")
def pca(spark, d):
    return E.pca(S.state_vectors(spark, d), "frame", "vec", 64)[0].select("component", r("explained").alias("explained"))


@query("pca95")
def pca95(spark, d):
    return E.pca95(S.state_vectors(spark, d), "frame", "vec", 64).select("frame", F.size("pcs").alias("kept"), r(F.col("pcs")[0] * F.col("pcs")[0], 4).alias("first_squared"))


@query("projection_decoder")
def projection_decoder(spark, d):
    return E.projection_decoder(S.state_vectors(spark, d), "frame", "position", "vec", 10)


SPEC = "sp AS (SELECT row_number() OVER (ORDER BY v DESC, dim) AS i, v / sum(v) OVER () AS share FROM (SELECT dim, var_pop(v) AS v FROM states GROUP BY 1))"


def spectrum(spark, d):
    """Variance shares of the state dimensions in falling order: one short row per dimension."""
    from pyspark.sql import Window as W
    v = S.states(spark, d).groupBy("dim").agg(F.var_pop("v").alias("v"))
    one = W.partitionBy(F.lit(1))
    return v.select(F.row_number().over(one.orderBy(F.desc("v"), "dim")).alias("i"), (F.col("v") / F.sum("v").over(one)).alias("share"))


@query("dim_variance_auc", with_views("states", SPEC, "c AS (SELECT i, sum(share) OVER (ORDER BY i) AS c FROM sp), s AS (SELECT c, lag(c) OVER (ORDER BY i) AS p FROM c)",
    "SELECT round(sum((c + p) / 2) / count(*), 6) + 0.0 AS auc FROM s"))
def dim_variance_auc(spark, d):
    return E.auc_variance(spectrum(spark, d), [], "i", "share").select(r("auc").alias("auc"))


@query("dim_variance_slope", with_views("states", SPEC, "SELECT round(regr_slope(ln(sqrt(share)), i), 6) + 0.0 AS slope FROM sp"))
def dim_variance_slope(spark, d):
    return E.eigen_slope(spectrum(spark, d).withColumn("s", F.sqrt("share")), [], "i", "s").select(r("slope").alias("slope"))


def eigen_shares(spark, d):
    """Explained shares of all principal components: one short row per dimension."""
    return E.pca(S.state_vectors(spark, d), "frame", "vec", 64)[0].select((F.col("component") + 1).alias("i"), F.col("explained").alias("share"))


@query("auc_variance")
def auc_variance(spark, d):
    return E.auc_variance(eigen_shares(spark, d), [], "i", "share").select(r("auc").alias("auc"))


@query("eigen_slope")
def eigen_slope(spark, d):
    return E.eigen_slope(eigen_shares(spark, d).withColumn("s", F.sqrt("share")), [], "i", "s").select(r("slope").alias("slope"))


def place_counts(spark, d):
    pos = positions(spark, d).select("frame", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    return E.poisson_counts(S.activity(spark, d), pos, "cell_id", "frame", "n", "x", "y"), pos


def _newton_sql(rounds=14):
    out = ["""pl AS (SELECT CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w FROM pos GROUP BY 1, 2),
        fi AS (SELECT cell_id, CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y, sum(n) AS s FROM activity JOIN pos USING (frame) GROUP BY 1, 2, 3),
        ss AS (SELECT c.cell_id, pl.x, pl.y, pl.w, CAST(coalesce(fi.s, 0) AS DOUBLE) AS s FROM (SELECT DISTINCT cell_id FROM activity) c CROSS JOIN pl LEFT JOIN fi ON fi.cell_id = c.cell_id AND fi.x = pl.x AND fi.y = pl.y),
        be0 AS (SELECT cell_id, ln(sum(s) / sum(w)) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM ss GROUP BY 1)"""]
    for k in range(rounds):
        out.append(f"""eq{k} AS (SELECT cell_id, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(m) AS a, sum(m * x) AS b, sum(m * y) AS c, sum(m * x * x) AS e, sum(m * x * y) AS f,
            sum(m * y * y) AS i, sum(s - m) AS p, sum((s - m) * x) AS q, sum((s - m) * y) AS r FROM (SELECT *, w * exp(b0 + b1 * x + b2 * y) AS m FROM ss JOIN be{k} USING (cell_id)) GROUP BY 1),
        be{k + 1} AS (SELECT cell_id, b0 + (p * (e * i - f * f) - b * (q * i - f * r) + c * (q * f - e * r)) / det AS b0, b1 + (a * (q * i - f * r) - p * (b * i - f * c) + c * (b * r - q * c)) / det AS b1,
            b2 + (a * (e * r - q * f) - b * (b * r - q * c) + p * (b * f - e * c)) / det AS b2 FROM (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM eq{k}))""")
    return ",\n".join(out)


@query("poisson_tuning", with_views("activity", POS, _newton_sql(), "SELECT cell_id, round(b0, 5) + 0.0 AS b0, round(b1, 5) + 0.0 AS b1, round(b2, 5) + 0.0 AS b2, true AS converged FROM be14"))
def poisson_tuning(spark, d):
    beta = E.poisson_tuning(place_counts(spark, d)[0], "cell_id")
    return beta.select("cell_id", *[r(c, 5).alias(c) for c in ("b0", "b1", "b2")], "converged")


LAM = """lm AS (SELECT c.cell_id, o.iy, o.ix, (coalesce(m.n, 0) + 0.5) / o.seconds AS lam FROM (SELECT DISTINCT cell_id FROM activity) c CROSS JOIN (SELECT iy, ix, count(*) AS seconds FROM pos GROUP BY 1, 2) o
    LEFT JOIN (SELECT cell_id, iy, ix, sum(n) AS n FROM activity JOIN pos USING (frame) GROUP BY 1, 2, 3) m ON m.cell_id = c.cell_id AND m.iy = o.iy AND m.ix = o.ix)"""


def empirical_tuning(spark, d):
    """Rate per cell and bin with half a spike added."""
    st, _ = place_counts(spark, d)
    return st.select("cell_id", F.col("y").cast("int").alias("iy"), F.col("x").cast("int").alias("ix"), ((F.col("s") + 0.5) / F.col("w")).alias("lam"))


@query("bayes_decode", with_views("activity", POS, LAM, """bs AS (SELECT iy, ix, sum(lam) AS base FROM lm GROUP BY 1, 2),
    ll AS (SELECT frame, iy, ix, sum(n * ln(greatest(lam, 1e-12))) AS ll FROM activity JOIN lm USING (cell_id) GROUP BY 1, 2, 3),
    rk AS (SELECT frame, iy, ix, ll - base AS s, row_number() OVER (PARTITION BY frame ORDER BY round(ll - base, 9) DESC, iy, ix) AS rk FROM ll JOIN bs USING (iy, ix))""",
    """SELECT frame, iy, ix, round(s, 5) + 0.0 AS loglik FROM rk WHERE rk = 1 UNION ALL
    SELECT frame, iy, ix, round(-base, 5) + 0.0 FROM (SELECT DISTINCT frame FROM pos) CROSS JOIN (SELECT * FROM bs ORDER BY round(-base, 9) DESC, iy, ix LIMIT 1)
    WHERE frame NOT IN (SELECT frame FROM rk)"""))
def bayes_decode(spark, d):
    frames = positions(spark, d).select("frame").unionByName(S.activity(spark, d).select("frame"))
    return E.bayes_decode(S.activity(spark, d), empirical_tuning(spark, d), "cell_id", "frame", "n", frames=frames).withColumn("loglik", r("loglik", 5))


def _decoded(spark, d, pos, fit_on):
    """(frame, px, py, error) of the test frames: 80/20 split -> active cells -> Poisson fit on the frames of ``fit_on`` -> decoding."""
    from engram.functions.blocks import frame_block
    from engram.operators.filters import active_cells, train_test_split
    parts = train_test_split(pos, [], ["frame"], frame_block(), 0.8)
    train, test = fit_on(parts.filter("part = 'train'").drop("part")), parts.filter("part = 'test'").drop("part")
    act = active_cells(S.activity(spark, d), ["cell_id"], ["frame"], "n", 25).select("cell_id", "frame", "n")
    places = train.select("frame", "x", "y")
    beta = E.poisson_tuning(E.poisson_counts(act.join(places.select("frame"), "frame", "left_semi"), places, "cell_id", "frame", "n", "x", "y"), "cell_id")
    tuning = E.tuning_on_grid(beta, E.place_grid(places, "x", "y", 10), "cell_id")
    got = E.bayes_decode(act.join(test.select("frame"), "frame", "left_semi"), tuning, "cell_id", "frame", "n", frames=test)
    err = F.sqrt((F.col("gx") - F.col("x")) ** 2 + (F.col("gy") - F.col("y")) ** 2)
    return (got.join(E.place_grid(places, "x", "y", 10), ["iy", "ix"]).join(test, "frame")
            .select("frame", r("gx", 4).alias("px"), r("gy", 4).alias("py"), r(err, 4).alias("error"), *[c for c in test.columns if c == "mobile"]))


def _places(spark, d):
    return positions(spark, d).select("frame", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))


@query("bayes_run")
def bayes_run(spark, d):
    """Decoding of the test frames by a fit on all training frames."""
    return _decoded(spark, d, _places(spark, d), lambda train: train)


@query("bayes_pipeline")
def bayes_pipeline(spark, d):
    """Speed -> mobile split -> fit on the mobile training frames -> decoding and error of all test frames, mobile or not."""
    pos = _places(spark, d)
    before = pos.select((F.col("frame") + 1).alias("frame"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    step = F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2)
    moving = mobile_split(pos.join(before, "frame", "left").withColumn("speed", F.coalesce(step, F.lit(0.0))), "speed", 1.5)
    return _decoded(spark, d, moving.select("frame", "x", "y", "mobile"), lambda train: train.filter("mobile"))
