"""Population states: steps, centroids, neighbours, transitions, PCA and Bayesian decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from engram.functions.blocks import frame_block, sequence, spread
from engram.functions.exprs import ratio
from engram.functions.quantiles import exact_quantile
from engram.session import cut_lineage


def state_steps(df: DataFrame, frame: str, vec: str) -> DataFrame:
    """Euclidean step to each state from the one before (NULL on the first)."""
    s = sequence(df, [], [frame], frame_block(frame), lag={"_p": vec})
    sq = F.aggregate(F.zip_with(vec, "_p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    return s.withColumn("step", F.sqrt(sq)).drop("_p")


def position_state_mean(states: DataFrame, position: str, dim: str, value: str) -> DataFrame:
    """Median and sd of the state per position and dimension."""
    med = exact_quantile(states, [position, dim], value, 0.5, "median")
    sd = states.groupBy(position, dim).agg(F.stddev_pop(value).alias("sd"))
    return med.join(sd, [position, dim])


def as_vectors(long: DataFrame, keys: list[str], dim: str, value: str, out: str = "vec") -> DataFrame:
    """Long rows to one array per key, ordered by dimension; the length is the number of dimensions."""
    return (long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(dim, value))).alias("_v"))
                .withColumn(out, F.transform("_v", lambda s: s[value])).drop("_v"))


CHUNK = 4096       # centroids of a tile
ROWS = 1 << 16     # states of a tile


def nearest_centroid(states: DataFrame, vec: str, centroids: DataFrame, label: str, cvec: str) -> DataFrame:
    """Closest centroid in L1 (tie: smallest label), adding ``nearest`` and ``distance``.

    Tiles of states meet tiles of centroids, both of bounded size, and the least (distance, label) of each state is kept; centroids are rows
    like the states and never leave the executors. Equal states are compared once. A null state has no nearest centroid.
    """
    points = states.filter(F.col(vec).isNotNull()).select(F.col(vec).alias("_x")).distinct()
    held = centroids.filter(F.col(cvec).isNotNull() & F.col(label).isNotNull())
    # two counts size the tiles
    over, along = (max(1, -(-n // size)) for n, size in ((points.count(), ROWS), (held.count(), CHUNK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = points.withColumn("_s", F.pmod(F.xxhash64("_x"), F.lit(over)).cast("int")).withColumn("_c", every(along))
    there = (held.select(F.col(label).alias("_l"), F.col(cvec).alias("_y")).withColumn("_c2", F.pmod(F.xxhash64("_l"), F.lit(along)).cast("int")).withColumn("_s2", every(over)))
    schema = T.StructType([T.StructField("_x", states.schema[vec].dataType), T.StructField("_d", T.DoubleType()), T.StructField("_l", centroids.schema[label].dataType)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([left["_x"].slice(0, 0), pa.array([], pa.float64()), right["_l"].slice(0, 0)], names=schema.names)
        right = right.sort_by("_l")
        grid = right["_y"].combine_chunks().flatten().to_numpy().astype(float).reshape(right.num_rows, -1)
        x = left["_x"].combine_chunks().flatten().to_numpy().astype(float).reshape(left.num_rows, -1)
        best, at = np.full(len(x), np.inf), np.zeros(len(x), int)
        for j, c in enumerate(grid):
            d = np.abs(x - c).sum(1)
            closer = d < best
            best[closer], at[closer] = d[closer], j
        return pa.table([left["_x"], pa.array(best), right["_l"].take(pa.array(at))], names=schema.names)

    met = asked.groupBy("_s", "_c").cogroup(there.groupBy("_s2", "_c2")).applyInArrow(run, schema)
    best = met.groupBy("_x").agg(F.min(F.struct("_d", "_l")).alias("_best"))
    return states.join(best, F.col(vec) == F.col("_x"), "left").select(*states.columns, F.col("_best._l").alias("nearest"), F.col("_best._d").alias("distance"))


def transition_matrix(located: DataFrame, frame: str, label: str) -> DataFrame:
    """Counts of (state at k, state at k + 1) along the frames that are present."""
    s = sequence(located.select(frame, label), [], [frame], frame_block(frame), lead={"_to": label})
    return (s.filter("_to is not null").groupBy(F.col(label).alias("src"), F.col("_to").alias("dst"))
             .agg(F.count(F.lit(1)).alias("n")))


PIVOTS = 4096      # cells of the quantiser at most; their centres are sent to every task
ASKED = 8          # pieces that a state asks on average, up to which it travels to each of them
MEET = 16384       # states of a tile that meets others
PART = 1024        # states of a tile that are compared at once, with twice as many
MEASURED = 1 << 16 # pairs whose distance is made from differences at once


def knn_sum(states: DataFrame, frame: str, vec: str, k: int = 6, slab_rows: int = 4096) -> DataFrame:
    """Sum of the distances to the k nearest states, the state itself included.  Exact.

    Equal states are counted once with their number.  States belong to the nearest of some pivots (up to PIVOTS of them, drawn by a hash);
    a crowded cell is cut in pieces of about ``slab_rows``.  The neighbours in its own piece bound how far a state can look.  What
    lies in another cell is at least as far as the distance to its pivot less the radius of the cell, and as half of what that
    pivot is farther away than the own one; only what lies within reach is compared.  Where the states ask few pieces, they travel to
    these.  Else neighbouring cells share a tile of about MEET states, and a state travels once per tile within reach of its own.
    """
    points = cut_lineage(states.groupBy(vec).agg(F.count(F.lit(1)).alias("_c"), F.min(frame).cast("long").alias("_id")))
    total = points.count()
    drawn = points.select("_id", vec).orderBy(F.xxhash64("_id"), "_id").limit(min(PIVOTS, max(1, -(-2 * total // slab_rows)))).collect()
    spark = states.sparkSession
    centres = np.array([r[1] for r in drawn], dtype=float)
    pivots = spark.sparkContext.broadcast(centres)
    array = points.schema[vec].dataType

    def to(x: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in some], axis=1)

    def assign(batches):
        for batch in batches:
            x = batch.column(vec).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            for lo in range(0, batch.num_rows, PART):
                away = to(x[lo:lo + PART], pivots.value)
                part = batch.slice(lo, PART)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(away.argmin(axis=1).astype(np.int32)), pa.array(away.min(axis=1))], names=[*batch.schema.names, "_cell", "_away"])

    placed = cut_lineage(points.select("_id", vec, "_c").mapInArrow(assign, T.StructType([T.StructField("_id", T.LongType()), T.StructField(vec, array), T.StructField("_c", T.LongType()),
                                                                                          T.StructField("_cell", T.IntegerType()), T.StructField("_away", T.DoubleType())])))
    cells = placed.groupBy("_cell").agg(F.max("_away").alias("_radius"), F.count(F.lit(1)).alias("_size"), F.ceil(F.count(F.lit(1)) / slab_rows).cast("int").alias("_pieces"))
    points = placed.join(F.broadcast(cells), "_cell").withColumn("_piece", F.pmod(F.xxhash64("_id"), F.col("_pieces")).cast("int")).drop("_pieces", "_radius", "_size")
    place = ["_cell", "_piece"]

    def nearest(x, y, count):
        d = np.sqrt(np.maximum(((x[:, None, :] - y[None, :, :]) ** 2).sum(2), 0)) if len(x) * len(y) * x.shape[1] < 2e7 else \
            np.stack([np.sqrt(((y - row) ** 2).sum(1)) for row in x])
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return several(np.take_along_axis(d, order, 1), count[order])

    def several(dist, count):
        """The k least of distances in order, each as often as its state occurs."""
        return [[float(v) for v, c in zip(dr, cr) for _ in range(min(int(c), k))][:k] for dr, cr in zip(dist, count)]

    own_schema = f"`_id` bigint, `{vec}` array<double>, `_c` bigint, `_cell` int, `_piece` int, `_near` array<double>"

    def own(pdf):
        x = np.stack(pdf[vec].to_numpy())
        return pdf[["_id", vec, "_c", *place]].assign(_near=nearest(x, x, pdf["_c"].to_numpy()))

    first = cut_lineage(points.groupBy(*place).applyInPandas(own, own_schema))
    reach = F.when(F.size("_near") >= k, F.element_at("_near", k)).otherwise(F.lit(float("inf")))
    asked = first.select("_id", vec, "_c", *place, reach.alias("_reach"))
    # at most PIVOTS rows: cells along the widest axis of their pivots, the states before each, and how far its own can look
    known = cells.join(asked.groupBy("_cell").agg(F.max("_reach").alias("_far")), "_cell").select("_cell", "_radius", "_size", "_pieces", "_far").collect()
    cell, radius, size, pieces, far = (np.array(v) for v in zip(*known)) if known else (np.zeros(0, int),) * 5
    along = np.argsort(centres[cell][:, centres.std(axis=0).argmax()], kind="stable") if known else cell
    cell, radius, size, pieces, far = (v[along] for v in (cell, radius, size, pieces, far))
    answer = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_near", T.ArrayType(T.DoubleType()))])
    def meet_in_tiles() -> DataFrame:
        ahead = np.cumsum(size) - size
        tiles = int((ahead + (pieces - 1) * slab_rows).max(initial=0)) // MEET + 1
        there = np.zeros((len(cell), tiles), np.float32)
        for row, lo, n in zip(there, ahead, pieces):
            row[lo // MEET:(lo + (n - 1) * slab_rows) // MEET + 1] = 1
        met = np.zeros((tiles, tiles), bool)
        for i in range(len(cell)):
            gap = np.sqrt(((centres[cell] - centres[cell[i]]) ** 2).sum(1)) - radius - radius[i]
            near = gap <= np.maximum(far, far[i]) * (1 + 1e-9) + 1e-9
            met |= (there[i][:, None] > 0) & (there[near].max(axis=0) > 0)[None, :]
        pairs = spark.createDataFrame([(int(t), int(o), int(min(t, o)), int(max(t, o))) for t, o in np.argwhere(met | met.T)], "_t int, _o int, _ti int, _tj int")
        start = spark.createDataFrame([(int(c), int(n)) for c, n in zip(cell, ahead)], "_cell int, _ahead long")
        bounds = spark.sparkContext.broadcast({int(c): float(v) for c, v in zip(cell, radius)})
        tiled = asked.join(F.broadcast(start), "_cell").withColumn("_t", F.floor((F.col("_ahead") + F.col("_piece") * slab_rows) / MEET).cast("int")).drop("_ahead")
        sent = spread(tiled.join(F.broadcast(pairs), "_t").drop("_o"), "_ti", "_tj")

        def meet(table: pa.Table) -> pa.Table:
            table = table.sort_by([("_cell", "ascending"), ("_piece", "ascending")])
            x = table[vec].combine_chunks().flatten().to_numpy().astype(float).reshape(table.num_rows, -1)
            ids, count, home, piece, look, tile = (table[c].to_numpy() for c in ("_id", "_c", "_cell", "_piece", "_reach", "_t"))
            z = x - x.mean(axis=0)
            norm = (z * z).sum(1)
            ti, tj = table["_ti"][0].as_py(), table["_tj"][0].as_py()
            slack = 1e-13 * float(norm.max())       # of a squared distance that is made from products
            out_ids, out = [], []
            for mine, other in {(ti, tj), (tj, ti)}:
                rows, cols = np.flatnonzero(tile == mine), np.flatnonzero(tile == other)
                if not len(rows) or not len(cols):
                    continue
                met, at = np.unique(home[cols], return_inverse=True)
                wide = np.array([bounds.value[c] for c in met])
                for lo in range(0, len(rows), PART):
                    q = rows[lo:lo + PART]
                    limit = look[q] * (1 + 1e-9) + 1e-9
                    away = to(x[q], pivots.value[met])
                    base = np.sqrt(((x[q] - pivots.value[home[q]]) ** 2).sum(1))
                    live = (np.maximum(away - wide[None, :], (away - base[:, None]) / 2) <= limit[:, None]).any(axis=0)
                    p = cols[live[at]]
                    best, who = np.full((len(q), k), np.inf), np.zeros((len(q), k), int)
                    bound = limit * limit
                    for j in range(0, len(p), 2 * PART):
                        some = p[j:j + 2 * PART]
                        d = norm[q][:, None] + norm[some][None, :] - 2 * (z[q] @ z[some].T)
                        if ti == tj:
                            d[(home[q][:, None] == home[some][None, :]) & (piece[q][:, None] == piece[some][None, :])] = np.inf   # its own piece is known
                        hit = np.flatnonzero((d <= bound[:, None] + slack).any(axis=1))
                        if len(hit):
                            # products choose, differences measure: what may be among the k least is measured
                            both = np.concatenate([best[hit], d[hit]], axis=1)
                            most = np.minimum(np.partition(both, k - 1, axis=1)[:, k - 1] + 2 * slack, bound[hit] + slack)
                            i, c = np.nonzero((both[:, k:] <= most[:, None]) & np.isfinite(both[:, k:]))
                            both[:, k:] = np.inf
                            for e in range(0, len(i), MEASURED):
                                one, two = i[e:e + MEASURED], c[e:e + MEASURED]
                                both[one, k + two] = ((x[q[hit[one]]] - x[some[two]]) ** 2).sum(1)
                            names = np.concatenate([who[hit], np.broadcast_to(some, (len(hit), len(some)))], axis=1)
                            least = np.argpartition(both, k - 1, axis=1)[:, :k]
                            best[hit], who[hit] = np.take_along_axis(both, least, 1), np.take_along_axis(names, least, 1)
                            bound[hit] = np.minimum(bound[hit], best[hit].max(axis=1))
                    found = np.flatnonzero(np.isfinite(best).any(axis=1))
                    dist = np.sqrt(best[found])
                    order = np.argsort(dist, axis=1, kind="stable")
                    dist, named = np.take_along_axis(dist, order, 1), np.take_along_axis(who[found], order, 1)
                    out_ids.append(ids[q[found]])
                    out += several(dist, np.where(np.isfinite(dist), count[named], 0))
            return pa.table([pa.array(np.concatenate(out_ids) if out_ids else [], pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=answer.names)
        return sent.groupBy("_ti", "_tj").applyInArrow(meet, answer)

    shape = spark.sparkContext.broadcast((cell, radius, pieces))

    def asks(batch):
        """(rows, row, cell) of parts of a batch: which cells are within reach of which state."""
        cell, radius, _ = shape.value
        for lo in range(0, batch.num_rows, PART):
            part = batch.slice(lo, PART)
            away = to(part.column(vec).flatten().to_numpy().astype(float).reshape(part.num_rows, -1), pivots.value)
            mine = part.column("_cell").to_numpy()
            at_least = np.maximum(away[:, cell] - radius[None, :], (away[:, cell] - away[np.arange(len(mine)), mine][:, None]) / 2)
            yield part, *np.nonzero(at_least <= (part.column("_reach").to_numpy() * (1 + 1e-9) + 1e-9)[:, None])

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(shape.value[2][j].sum()) for _, _, j in asks(batch))], pa.int64())], names=["n"])

    if (asked.mapInArrow(counted, "n long").agg(F.sum("n")).first()[0] or 0) > ASKED * total:
        rest = meet_in_tiles()
    else:
        plain = T.StructType([T.StructField("_id", T.LongType()), T.StructField(vec, T.ArrayType(T.DoubleType())), T.StructField("_cell", T.IntegerType()), T.StructField("_piece", T.IntegerType())])

        def visits(batches):
            cell, _, pieces = shape.value
            for batch in batches:
                for rows, row, j in asks(batch):
                    # every piece of a cell within reach, but the own one
                    row, at = np.repeat(row, pieces[j]), np.repeat(j, pieces[j])
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces[j]) - pieces[j], pieces[j])
                    keep = (cell[at] != rows.column("_cell").to_numpy()[row]) | (piece != rows.column("_piece").to_numpy()[row])
                    row, at, piece = row[keep], at[keep], piece[keep]
                    for lo in range(0, len(row), MEET):
                        some = pa.array(row[lo:lo + MEET])
                        yield pa.RecordBatch.from_arrays([rows.column("_id").take(some), rows.column(vec).take(some), pa.array(cell[at[lo:lo + MEET]].astype(np.int32)),
                                                          pa.array(piece[lo:lo + MEET].astype(np.int32))], names=plain.names)

        sent = cut_lineage(asked.mapInArrow(visits, plain))
        # A piece asked by many is copied once per slab_rows questions, so every group stays small.
        parts = sent.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / slab_rows).cast("int").alias("_nq"))
        sent = sent.join(parts, place).withColumn("_q", F.pmod(F.xxhash64("_id"), F.col("_nq")).cast("int")).drop("_nq")
        held = points.join(parts, place).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nq")

        def other(q, p):
            if not len(q) or not len(p):
                return pd.DataFrame({"_id": [], "_near": []})
            return pd.DataFrame({"_id": q["_id"].to_numpy(), "_near": nearest(np.stack(q[vec].to_numpy()), np.stack(p[vec].to_numpy()), p["_c"].to_numpy())})

        rest = sent.groupBy(*place, "_q").cogroup(held.groupBy(*place, "_q")).applyInPandas(other, "`_id` bigint, `_near` array<double>")
    merged = (first.select("_id", "_near").unionByName(rest).groupBy("_id")
              .agg(F.slice(F.sort_array(F.flatten(F.collect_list("_near"))), 1, k).alias("_near")))
    sums = points.select("_id", vec).join(merged, "_id").select(vec, F.aggregate("_near", F.lit(0.0), lambda t, v: t + v).alias("knn"))
    return states.join(sums, vec).select(frame, "knn")


def knn_triage(states: DataFrame, frame: str, vec: str, triage: float, k: int = 6, slab_rows: int = 4096) -> DataFrame:
    """Frames whose neighbour sum is within the (1 - triage) quantile."""
    s = cut_lineage(knn_sum(states, frame, vec, k, slab_rows))
    cut = exact_quantile(s, [], "knn", 1 - triage, "_cut")
    return s.crossJoin(F.broadcast(cut)).filter(F.col("knn") <= F.col("_cut")).drop("_cut")


def fit_pca(vectors: DataFrame, vec: str, k: int):
    """Spark ML PCA of centred vectors: (model, mean vector column)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    dims = vectors.select(F.posexplode(vec).alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m"))
    mean = [r["m"] for r in dims.orderBy("d").collect()]   # one number per dimension
    centre = F.zip_with(vec, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    data = vectors.withColumn("_x", array_to_vector(centre))
    return PCA(k=k, inputCol="_x", outputCol="_pc").fit(data), data


def pca(vectors: DataFrame, frame: str, vec: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(component, explained share) and (frame, pcs) of the first k components."""
    from pyspark.ml.functions import vector_to_array
    model, data = fit_pca(vectors, vec, k)
    share = [(i, float(v)) for i, v in enumerate(model.explainedVariance)]
    spectrum = vectors.sparkSession.createDataFrame(share, "component int, explained double")
    scores = model.transform(data).withColumn("pcs", vector_to_array("_pc")).drop("_x", "_pc")
    return spectrum, scores


def pca95(vectors: DataFrame, frame: str, vec: str, n_dims: int, share: float = 0.95) -> DataFrame:
    """Scores on the components before the cumulative share first passes ``share``."""
    from pyspark.ml.functions import vector_to_array
    model, data = fit_pca(vectors, vec, n_dims)
    keep = int(np.argmax(np.cumsum(model.explainedVariance.toArray()) > share))
    scored = model.transform(data).withColumn("pcs", F.slice(vector_to_array("_pc"), 1, max(keep, 1)))
    return scored.drop("_x", "_pc")


def projection_decoder(vectors: DataFrame, frame: str, position: str, vec: str, k: int) -> DataFrame:
    """Position of every state by the nearest median state of a position in PCA space."""
    scores = cut_lineage(pca(vectors, frame, vec, k)[1].select(frame, position, "pcs"))
    long = scores.select(position, F.posexplode("pcs").alias("dim", "v"))
    centre = as_vectors(exact_quantile(long, [position, "dim"], "v", 0.5, "median"), [position], "dim", "median", "_c")
    return nearest_centroid(scores, "pcs", centre, position, "_c").select(frame, position, F.col("nearest").alias("predicted"))


def auc_variance(spectrum: DataFrame, keys: list[str], index: str, share: str) -> DataFrame:
    """Trapezoid area under the cumulative explained share against i/n; one row per component."""
    w = W.partitionBy(*keys).orderBy(index) if keys else W.partitionBy(F.lit(1)).orderBy(index)
    upto = spectrum.withColumn("_c", F.sum(share).over(w.rowsBetween(W.unboundedPreceding, 0)))
    seg = upto.withColumn("_p", F.lag("_c").over(w))
    return seg.groupBy(*keys).agg(F.sum((F.col("_c") + F.col("_p")) / 2).alias("_a"), F.count(F.lit(1)).alias("_n")).select(
        *keys, ratio("_a", "_n").alias("auc"))


def eigen_slope(spectrum: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Slope of the log singular values against their index."""
    return spectrum.groupBy(*keys).agg(F.regr_slope(F.log(value), F.col(index).cast("double")).alias("slope"))


def decoder_error_profile(errors: DataFrame, session: str, error: str, width: float = 1.0) -> DataFrame:
    """Share of frames per error bin, mean and sd over the sessions."""
    h = errors.groupBy(session, F.floor(F.col(error) / width).alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    tot = h.groupBy(session).agg(F.sum("_c").alias("_t"))
    n = tot.agg(F.count(F.lit(1)).alias("_n"))
    p = h.join(tot, session).withColumn("_p", ratio("_c", "_t"))
    # A session without the bin counts with share 0.
    agg = p.groupBy("bin").agg(F.sum("_p").alias("_s"), F.sum(F.col("_p") * F.col("_p")).alias("_q")).crossJoin(F.broadcast(n))
    mean = F.col("_s") / F.col("_n")
    return agg.select("bin", mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("sd"))


def place_grid(df: DataFrame, x: str, y: str, res: int = 10) -> DataFrame:
    """Evaluation grid over the arena: steps of round(range / res) per axis."""
    ext = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    step = lambda a, b: F.greatest(F.round((F.col(b) - F.col(a)) / res), F.lit(1.0))
    axis = lambda a, b: F.sequence(F.lit(0), F.floor((F.col(b) + 0.01 - F.col(a)) / step(a, b)).cast("int"))
    return (ext.withColumn("iy", F.explode(axis("y0", "y1"))).withColumn("ix", F.explode(axis("x0", "x1")))
               .select(F.col("iy"), F.col("ix"), (F.col("x0") + F.col("ix") * step("x0", "x1")).alias("gx"),
                       (F.col("y0") + F.col("iy") * step("y0", "y1")).alias("gy")))


def poisson_counts(activity: DataFrame, positions: DataFrame, cell: str, frame: str, count: str, x: str, y: str) -> DataFrame:
    """Sufficient statistics of the Poisson fit: frames and spikes per cell and place, silent frames included."""
    places = positions.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    fired = activity.join(positions, frame).groupBy(cell, x, y).agg(F.sum(count).alias("s"))
    # Every cell sees every place: places are few and fixed by the arena, cells come from the recording.
    tiles = 8
    spread = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    cells = activity.select(cell).distinct().withColumn("_t", spread)
    grid = places.withColumn("_t", F.pmod(F.xxhash64(x, y), F.lit(tiles)).cast("int"))
    return (cells.join(grid, "_t").join(fired, [cell, x, y], "left")
            .select(cell, F.col(x).alias("x"), F.col(y).alias("y"), F.col("w").cast("double").alias("w"),
                    F.coalesce(F.col("s"), F.lit(0)).cast("double").alias("s")))


def poisson_tuning(stats: DataFrame, cell: str, tolerance: float = 1e-8, rounds: int = 100) -> DataFrame:
    """Coefficients of log rate = b0 + b1 x + b2 y per cell by Newton steps.

    All cells are fitted together: a round is one aggregation of the 3x3 normal equations per cell
    and their closed-form solution.  Rounds go on until no coefficient moves by more than ``tolerance``.
    ``converged`` is false for a cell whose equations are singular or that still moves after ``rounds``
    rounds; such a cell has no finite answer (its spikes lie on one side of a line).
    """
    stats = cut_lineage(stats)
    beta = stats.groupBy(cell).agg(F.log(F.sum("s") / F.sum("w")).alias("b0"), F.lit(0.0).alias("b1"), F.lit(0.0).alias("b2"), F.lit(False).alias("converged"))
    x, y = F.col("x"), F.col("y")
    for _ in range(rounds):
        m = F.col("w") * F.exp(F.col("b0") + F.col("b1") * x + F.col("b2") * y)
        d = F.col("s") - m
        eq = stats.join(beta, cell).groupBy(cell).agg(
            F.sum(m).alias("a"), F.sum(m * x).alias("b"), F.sum(m * y).alias("c"), F.sum(m * x * x).alias("e"),
            F.sum(m * x * y).alias("f"), F.sum(m * y * y).alias("i"), F.sum(d).alias("p"), F.sum(d * x).alias("q"), F.sum(d * y).alias("r"),
            *[F.max(k).alias(k) for k in ("b0", "b1", "b2")])
        a, b, c, e, f, i, p, q, r = (F.col(k) for k in "a b c e f i p q r".split())
        det = a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c)
        d0 = p * (e * i - f * f) - b * (q * i - f * r) + c * (q * f - e * r)
        d1 = a * (q * i - f * r) - p * (b * i - f * c) + c * (b * r - q * c)
        d2 = a * (e * r - q * f) - b * (b * r - q * c) + p * (b * f - e * c)
        step = lambda k, n: (F.col(k) + F.coalesce(F.try_divide(n, det), F.lit(0.0))).alias(k)
        still = F.greatest(*[F.abs(F.try_divide(n, det)) for n in (d0, d1, d2)])
        beta = cut_lineage(eq.select(cell, step("b0", d0), step("b1", d1), step("b2", d2), F.coalesce(still <= tolerance, F.lit(False)).alias("converged"),
                                     F.coalesce(det == 0, F.lit(True)).alias("_stuck")))
        moving = beta.filter("NOT converged AND NOT _stuck").limit(1).count()
        beta = beta.drop("_stuck")
        if not moving:
            break
    return beta


def tuning_on_grid(beta: DataFrame, grid: DataFrame, cell: str) -> DataFrame:
    """Expected count of every cell on every grid point; the grid has a fixed number of points."""
    g = grid.select(F.array_agg(F.struct("iy", "ix", "gx", "gy")).alias("_g"))
    return (beta.crossJoin(F.broadcast(g)).select("*", F.inline("_g")).drop("_g")
            .select(cell, "iy", "ix", "gx", "gy", F.exp(F.col("b0") + F.col("b1") * F.col("gx") + F.col("b2") * F.col("gy")).alias("lam")))


def bayes_decode(activity: DataFrame, tuning: DataFrame, cell: str, frame: str, count: str, parts: int | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Most likely grid point of every frame under independent Poisson cells.

    ``frames`` names the frames to decode; those without a spike get the point where silence is most likely.  Without it only frames with
    spikes are decoded.

    log p = sum over active cells of count * ln(lambda) minus the sum of all lambdas, which does not
    depend on the frame.  Ties go to the first grid point in row order.
    """
    lam = tuning.select(cell, "iy", "ix", F.log(F.greatest("lam", F.lit(1e-12))).alias("_ln"))
    base = tuning.groupBy("iy", "ix").agg(F.sum("lam").alias("_base"))
    act = activity.select(cell, frame, count)
    # The frames are placed first; with a small tuning table the join and the sums then need no further shuffle.
    act = act.repartition(parts, frame) if parts else act.repartition(frame)
    ll = act.join(lam, cell).groupBy(frame, "iy", "ix").agg(F.sum(F.col(count) * F.col("_ln")).alias("_ll"))
    score = F.round(F.col("_ll") - F.col("_base"), 9)
    best = lambda s: F.max(F.struct(s.alias("s"), (-F.col("iy")).alias("y"), (-F.col("ix")).alias("x"))).alias("_b")
    found = ll.join(base, ["iy", "ix"]).groupBy(frame).agg(best(score))
    if frames is not None:
        silent = base.agg(best(F.round(-F.col("_base"), 9)))
        wanted = frames.select(frame).distinct()
        rest = wanted.join(found.select(frame), frame, "left_anti")
        found = found.join(wanted, frame, "left_semi").unionByName(rest.crossJoin(F.broadcast(silent)))   # silent: one row
    return (found.select(frame, (-F.col("_b.y")).alias("iy"), (-F.col("_b.x")).alias("ix"), F.col("_b.s").alias("loglik")))
