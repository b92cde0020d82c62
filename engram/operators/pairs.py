"""Correlations and overlaps of cell pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from engram.functions.exprs import pearson_agg, pearson_from_sums, ratio
from engram.functions.pairs import ENTRIES, STRIP, _products, deal_pieces, exceeds, pair_products, sides, tile_count, to_pieces, unpack
from engram.functions.pvalue import pearson_p, pearson_pvalue


def cell_moments(activity: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    v = F.col(value)
    return activity.groupBy(*keys, item).agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_ss"),
                                             F.count(F.when(v != 0, 1)).alias("_bursts"))


def _with_moments(pairs: DataFrame, moments: DataFrame, keys: list[str], item: str) -> DataFrame:
    for side in ("a", "b"):
        m = moments.select(*keys, F.col(item).alias(side), F.col("_s").alias(f"s_{side}"), F.col("_ss").alias(f"ss_{side}"),
                           F.col("_bursts").alias(f"bursts_{side}"))
        pairs = pairs.join(m, [*keys, side])
    return pairs


def pearson_pairs(activity: DataFrame, keys: list[str], item: str, coord: str, value: str, n_coords: int | Column,
                  min_bursts: int = 0, tiles: int | None = None, with_p: bool = False, r_min: float | None = None) -> DataFrame:
    """r of every cell pair over ``n_coords`` bins (a number, or a column of the keys); bins without a row count as zero.

    A cell travels with its moments as one array per tile it meets, and a task makes r (and p) of all pairs of two tiles, so pairs are
    neither joined nor shuffled. A constant cell, or one with too few active bins, gives r NULL (and p 1). With ``r_min`` pairs below it,
    or without r, never leave their task. Null cells and recordings have no pairs.
    """
    v = F.col(value)
    n = F.lit(n_coords) if isinstance(n_coords, int) else n_coords
    activity = activity.select(*keys, item, coord, value).filter(v != 0).dropna(subset=[*keys, item])
    entry = F.when(F.col(coord).isNotNull(), F.struct(F.col(coord).cast("long").alias("_c"), v.cast("double").alias("_v")))
    m = activity.groupBy(*keys, item).agg(F.collect_list(entry).alias("_e"), F.sum(v).cast("double").alias("_s"), F.sum(v * v).cast("double").alias("_ss"),
                                          F.count(F.lit(1)).alias("_bursts"))
    if tiles is None:
        most, entries = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.sum("_bursts").alias("_m")).agg(F.max("_k"), F.max("_m")).first()   # one row sizes the tiles
        tiles = tile_count(most or 1, ENTRIES * (most or 1) // (entries or 1))
    sent = to_pieces(m.select(*keys, item, F.col("_e._c").alias("_c"), F.col("_e._v").alias("_v"), "_s", "_ss", "_bursts", n.cast("double").alias("_n")), item, tiles)
    kind = activity.schema[item].dataType
    schema = T.StructType([*[activity.schema[k] for k in keys], T.StructField("a", kind), T.StructField("b", kind), *[T.StructField(c, T.DoubleType()) for c in ["r"] + ["p"] * with_p]])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ids, at, code, c, x = unpack(rows, item)
        n, s, ss, bursts = (rows[name].to_numpy()[at] for name in ("_n", "_s", "_ss", "_bursts"))
        square = n * ss - s * s      # as in pearson_from_sums
        live = exceeds(square, 1e-12 * n * ss) & (bursts >= min_bursts)
        norm = np.sqrt(np.abs(square))
        left, right, entries = sides(rows, at, code, x, np.unique(c, return_inverse=True)[1])
        same = [pa.scalar(rows[k][0].as_py(), rows.schema.field(k).type) for k in keys]
        once = rows["_ti"][0].as_py() == rows["_tj"][0].as_py()
        step = max(1, BATCH // max(len(right), 1))
        for first, _, products in _products(*entries, VECTOR, True):
            for lo in range(0, len(products), step):
                xy = products[lo:lo + step]
                mine = left[first + lo:first + lo + len(xy)]      # a strip may end before a step does
                known = live[mine][:, None] & live[right][None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = (n[mine][:, None] * xy - s[mine][:, None] * s[right][None, :]) / (norm[mine][:, None] * norm[right][None, :])
                    keep = np.ones(xy.shape, bool) if r_min is None else known & ((r >= r_min) | np.isnan(r))
                i, j = np.nonzero(keep & (mine[:, None] < right[None, :]) if once else keep)
                one, two = np.minimum(mine[i], right[j]), np.maximum(mine[i], right[j])
                r, known = r[i, j], known[i, j]
                out = [pa.repeat(k, len(i)) for k in same] + [ids.take(pa.array(one)), ids.take(pa.array(two)), pa.array(r, mask=~known)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(pearson_p(np.where(known, r, np.nan), n[one]))] * with_p, names=schema.names)

    full = deal_pieces(sent, tiles, *keys, "_ti", "_tj").groupBy(*keys, "_ti", "_tj").applyInArrow(meet, schema)
    return full.select(*keys, "a", "b", n.alias("n"), "r", *["p"] * with_p)


HELD = 1 << 23    # numbers of one tile of cells that a task may hold
GROUPS = 16       # parts of the recording whose norms bound a correlation
VECTOR = 4096     # bins of a cell that travel as one array
BATCH = 1 << 17   # pairs that leave a task together


def pearson_above(activity: DataFrame, keys: list[str], item: str, coord: str, value: str, n, r_min: float, min_bursts: int = 0) -> DataFrame:
    """(keys, a, b, n, r, p) of the cell pairs a < b with r >= ``r_min``; no other pair leaves its task.

    ``n`` is the number of bins, an int or a column that is constant for a recording; bins without a row are zero. Cells that are constant or
    have too few active bins have no r. A cell travels as one array per tile it meets, and a task holds two tiles of cells over the whole
    recording. The norms of GROUPS parts of the recording bound r from above (a product of parts is at most the product of their norms),
    and cells that no bound reaches are not multiplied.
    """
    act = (activity.select(*keys, item, F.col(coord).cast("long").alias("_c"), F.col(value).cast("double").alias("_v"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("_n"))
           .filter(F.col(item).isNotNull() & (F.col("_v") != 0) & (F.col("_c") >= 0) & (F.col("_c") < F.col("_n"))))
    cells = act.groupBy(*keys, item).agg(F.max("_n").alias("_n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.max("_n").alias("bins"))
    most = cells.agg(F.max("cells"), F.max("bins")).first()      # one row sizes the tiles
    tiles = tile_count(most[0] or 1, HELD // (most[1] or 1))
    packed = act.groupBy(*keys, item).agg(F.collect_list(F.struct(F.col("_c").cast("int").alias("_c"), "_v")).alias("_e"), F.max("_n").alias("_n"))
    sent = to_pieces(packed.select(*keys, item, "_n", F.col("_e._c").alias("_c"), F.col("_e._v").alias("_v")), item, tiles)
    kind = activity.schema[item].dataType
    schema = T.StructType([*[activity.schema[k] for k in keys], T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ids, at, code, c, v = unpack(rows, item)
        bins = rows["_n"][0].as_py()
        x = np.zeros((len(ids), bins))
        np.add.at(x, (code, c), v)
        tile = rows["_t"].to_numpy()[at]
        bursts = (x != 0).sum(axis=1)
        x -= x.mean(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        live = (norm > 1e-9 * np.abs(x).max(axis=1, initial=0) * np.sqrt(bins)) & (norm > 0) & (bursts >= min_bursts)
        x /= np.where(live, norm, 1.0)[:, None]
        edges = np.linspace(0, bins, min(GROUPS, bins) + 1).astype(int)[:-1]
        parts = np.sqrt(np.add.reduceat(x * x, edges, axis=1))
        ti, tj = rows["_ti"][0].as_py(), rows["_tj"][0].as_py()
        left, right = np.flatnonzero(live & (tile == ti)), np.flatnonzero(live & (tile == tj))
        same = [pa.scalar(rows[k][0].as_py(), rows.schema.field(k).type) for k in keys]
        held, facing, far = x[right], parts[right].T, right
        for lo in range(0, len(left), STRIP):
            near = left[lo:lo + STRIP]
            if bins > 4 * GROUPS:      # short recordings are multiplied as fast as they are bounded
                reach = parts[near] @ facing >= r_min - 1e-9
                near, some = near[reach.any(axis=1)], reach.any(axis=0)
                held, far = x[right[some]], right[some]
            r = x[near] @ held.T
            i, j = np.nonzero(r >= r_min)
            r, i, j = r[i, j], near[i], far[j]
            if ti == tj:
                i, j, r = i[i < j], j[i < j], r[i < j]
            if len(r):
                out = [pa.repeat(k, len(r)) for k in same] + [ids.take(pa.array(np.minimum(i, j))), ids.take(pa.array(np.maximum(i, j)))]
                r, n = np.clip(r, -1, 1), np.full(len(r), bins)
                yield pa.RecordBatch.from_arrays([*out, pa.array(n), pa.array(r), pa.array(pearson_p(r, n))], names=schema.names)

    return deal_pieces(sent, tiles, *keys, "_ti", "_tj").groupBy(*keys, "_ti", "_tj").applyInArrow(run, schema)


def pearson_of(pairs: DataFrame, activity: DataFrame, keys: list[str], item: str, coord: str, value: str, n: int | Column, with_p: bool = False) -> DataFrame:
    """(keys, a, b, n, r[, p]) of the given pairs (keys, a, b) alone: sampled products of the vectors of both cells.

    A vector travels in arrays of VECTOR bins, one row per (pair, array), never one per (pair, bin). Constant cells give r NULL.
    """
    act = activity.select(*keys, item, F.col(coord).cast("long").alias("_c"), F.col(value).cast("double").alias("_v")).filter(F.col("_v") != 0)
    wanted = pairs.select(*keys, "a", "b").distinct()
    blocks = (act.groupBy(*keys, item, F.floor(F.col("_c") / VECTOR).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_c", "_v"))).alias("_e"))
              .select(*keys, item, "_b", F.col("_e._c").alias("_c"), F.col("_e._v").alias("_v")))
    side = lambda s: blocks.select(*keys, F.col(item).alias(s), "_b", F.col("_c").alias(f"_c{s}"), F.col("_v").alias(f"_v{s}"))
    met = wanted.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b", "_b"]).select(*keys, "a", "b", "_ca", "_va", "_cb", "_vb")
    schema = T.StructType([f for f in met.schema.fields if f.name not in ("_ca", "_va", "_cb", "_vb")] + [T.StructField("_xy", T.DoubleType())])

    def dots(batches):
        for batch in batches:
            out = []
            cols = [batch.column(k) for k in ("_ca", "_va", "_cb", "_vb")]
            for ca, va, cb, vb in zip(*cols):
                x, y = ca.values.to_numpy(), cb.values.to_numpy()
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                out.append(float((va.values.to_numpy() * np.where(y[at] == x, vb.values.to_numpy()[at], 0.0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in schema.fields[:-1]] + [pa.array(out, pa.float64())], names=schema.names)

    shared = met.mapInArrow(dots, schema).groupBy(*keys, "a", "b").agg(F.sum("_xy").alias("_xy"))
    full = _with_moments(wanted.join(shared, [*keys, "a", "b"], "left"), cell_moments(act, keys, item, "_v"), keys, item)
    n = F.lit(n) if isinstance(n, int) else n
    out = full.select(*keys, "a", "b", n.alias("n"), pearson_from_sums(n, "s_a", "s_b", "ss_a", "ss_b", F.coalesce("_xy", F.lit(0.0))).alias("r"))
    return out.withColumn("p", pearson_pvalue("r", F.col("n").cast("double"))) if with_p else out


def overlap_pixels(pixels: DataFrame, keys: list[str], cell: str, width: int, tiles: int | None = None, least: float | None = None) -> DataFrame:
    """Shared pixels of two footprints and their share of each; with ``least`` only pairs with such a share of either, others are never written."""
    flat = pixels.select(*keys, cell, (F.col("y") * width + F.col("x")).alias("_at"), F.lit(1.0).alias("_one"))
    shared = pair_products(flat, None, keys, cell, "_at", "_one", tiles=tiles, sums=False, sizes=True, least=least)
    return shared.select(*keys, F.col("a").alias("cell1"), F.col("b").alias("cell2"), F.col("n").alias("pixels_overlap"),
                         ratio("n", "n_a").alias("percent_cell1"), ratio("n", "n_b").alias("percent_cell2"))


def candidate_pairs_overlap(overlaps: DataFrame, threshold: float, corr: DataFrame | None = None, r_min: float | None = None) -> DataFrame:
    kept = overlaps.filter(F.greatest("percent_cell1", "percent_cell2") >= threshold)
    if corr is not None:
        kept = kept.join(corr.filter(F.col("r") >= r_min).select(F.col("a").alias("cell1"), F.col("b").alias("cell2")),
                         ["cell1", "cell2"], "left_semi")
    return kept.select(F.col("cell1").alias("src"), F.col("cell2").alias("dst"))


def candidate_pairs_center(distances: DataFrame, activity: DataFrame, keys: list[str], item: str, coord: str, value: str, n, max_distance: float, r_min: float) -> DataFrame:
    """(keys, src, dst) of the cells at most ``max_distance`` apart with r >= ``r_min``.

    ``distances`` (a < b, distance) holds for all recordings unless it has the keys. Where most cells are near one another a row per near
    pair, recording and vector is the larger side by far, so the tile tasks of ``pearson_pairs`` make r and let out the pairs from ``r_min`` on."""
    on = [*[k for k in keys if k in distances.columns], "a", "b"]
    near = distances.filter(F.col("distance") <= max_distance).select(*on)
    alike = pearson_pairs(activity, keys, item, coord, value, n, r_min=r_min)
    return alike.join(near, on, "left_semi").select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"))


def corr_graph(corr: DataFrame, r_min: float = 0.3, p_max: float | None = 0.1) -> DataFrame:
    keep = F.col("r") >= r_min
    if p_max is not None:
        keep = keep & (F.col("p") < p_max)
    more = [c for c in corr.columns if c not in ("a", "b", "n", "r", "p")]
    return corr.filter(keep).select(*more, F.col("a").alias("src"), F.col("b").alias("dst"), F.col("r").alias("w"))


def map_cross_corr(left: DataFrame, right: DataFrame, keys: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """Pearson of two maps over the bins both have visited, overall or per row or column."""
    a = left.select(*keys, "iy", "ix", F.col(value).alias("_a"))
    b = right.select(*keys, "iy", "ix", F.col(value).alias("_b"))
    return a.join(b, [*keys, "iy", "ix"]).groupBy(*keys, *(by or [])).agg(
        pearson_agg("_a", "_b").alias("r"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n"))


def session_pair_corr(maps: DataFrame, cell: str, session: str, pos: str, value: str, n_bins: int, alpha: float = 0.05, r_min: float = 0.0, offset: int = 0) -> DataFrame:
    """(cell, first, second, r, p, peak_first, peak_second, shift, best_shift, best_r) of each cell in every pair of its sessions, earlier first.

    Maps are circular tracks of ``n_bins`` bins (bins without a row are 0); r and the peaks leave out the first ``offset`` bins, and only pairs with
    p < ``alpha`` and |r| > ``r_min`` stay. best_shift is the roll of the second map that correlates best with the first (ties: the
    smallest roll), best_r that correlation. A map travels as one array, so a cell joins its sessions, not their bins. Maps that are
    constant have no r. Null cells, sessions and bins outside the track take no part.
    """
    own = maps.filter(F.col(session).isNotNull() & F.col(pos).between(0, n_bins - 1)).groupBy(cell, session).agg(F.collect_list(F.struct(F.col(pos).cast("int").alias("b"), F.col(value).cast("double").alias("v"))).alias("m"))
    side = lambda s: own.select(cell, F.col(session).alias(s), F.col("m.b").alias(f"_b_{s}"), F.col("m.v").alias(f"_v_{s}"))
    met = side("first").join(side("second"), cell).filter("first < second")
    out = ["r", "peak_first", "peak_second", "best_shift", "best_r"]
    schema = T.StructType([met.schema[c] for c in (cell, "first", "second")] + [T.StructField(c, T.DoubleType() if c in ("r", "best_r") else T.IntegerType()) for c in out])

    def dense(at, v):
        x = np.zeros(n_bins)
        np.add.at(x, at.values.to_numpy(), np.nan_to_num(v.values.to_numpy(zero_copy_only=False).astype(float)))
        return x

    def r_of(x, y):
        x, y = x - x.mean(), y - y.mean()
        norm = np.sqrt((x * x).sum() * (y * y).sum())
        return (float((x * y).sum() / norm) if norm > 1e-12 else None), x, y, norm

    def run(batches):
        for batch in batches:
            got: dict[str, list] = {c: [] for c in out}
            for b1, v1, b2, v2 in zip(*(batch.column(c) for c in ("_b_first", "_v_first", "_b_second", "_v_second"))):
                x, y = dense(b1, v1), dense(b2, v2)
                got["r"].append(r_of(x[offset:], y[offset:])[0])
                got["peak_first"].append(int(np.argmax(x[offset:])) + offset)
                got["peak_second"].append(int(np.argmax(y[offset:])) + offset)
                _, cx, cy, norm = r_of(x, y)
                sums = np.fft.irfft(np.fft.rfft(cx) * np.fft.rfft(cy).conj(), n_bins)
                best = int(np.argmax(sums >= sums.max() - 1e-9 * max(norm, 1e-300)))
                got["best_shift"].append(best if norm > 1e-12 else None)
                got["best_r"].append(float(sums[best] / norm) if norm > 1e-12 else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (cell, "first", "second")]
                                             + [pa.array(got[c], pa.float64() if c in ("r", "best_r") else pa.int32()) for c in out], names=schema.names)

    compared = met.mapInArrow(run, schema).withColumn("p", pearson_pvalue("r", F.lit(float(n_bins - offset))))
    return (compared.filter((F.col("p") < alpha) & (F.abs("r") > r_min))
            .select(cell, "first", "second", "r", "p", "peak_first", "peak_second", (F.col("peak_first") - F.col("peak_second")).alias("shift"), "best_shift", "best_r"))


def pv_corr(left: DataFrame, right: DataFrame, cell: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Population vector correlation of two map stacks: per row over cells and bins, and per bin over cells."""
    j = (left.select(cell, "iy", "ix", F.col(value).alias("_a"))
             .join(right.select(cell, "iy", "ix", F.col(value).alias("_b")), [cell, "iy", "ix"]))
    return (j.groupBy("iy").agg(pearson_agg("_a", "_b").alias("r"), F.count(F.lit(1)).alias("n")),
            j.groupBy("iy", "ix").agg(pearson_agg("_a", "_b").alias("r"), F.count(F.lit(1)).alias("n")))


def pv_matrix(left: DataFrame, right: DataFrame, cell: str, value: str) -> DataFrame:
    """Correlation over cells of every bin of one map stack with every bin of the other: (iy, ix, iy2, ix2, r, n).

    The number of bins is fixed by the arena; a cell gives bins squared rows, which are added up before they are shuffled.
    """
    a = left.select(cell, "iy", "ix", F.col(value).alias("_a"))
    b = right.select(cell, F.col("iy").alias("iy2"), F.col("ix").alias("ix2"), F.col(value).alias("_b"))
    return a.join(b, cell).groupBy("iy", "ix", "iy2", "ix2").agg(pearson_agg("_a", "_b").alias("r"), F.count(F.lit(1)).alias("n"))


def field_overlap(fields: DataFrame, keys: list[str], variant: str, first, second) -> DataFrame:
    """Shared bins over the larger of two binary field maps."""
    per = fields.filter(F.col(variant).isin(first, second)).groupBy(*keys, "iy", "ix").agg(
        F.max(F.when(F.col(variant) == first, 1).otherwise(0)).alias("_a"),
        F.max(F.when(F.col(variant) == second, 1).otherwise(0)).alias("_b"))
    return per.groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("shared"),
                                  ratio(F.sum(F.col("_a") * F.col("_b")), F.greatest(F.sum("_a"), F.sum("_b"))).alias("overlap"))


def field_redundancy(fields: DataFrame, keys: list[str], cell: str) -> tuple[DataFrame, DataFrame]:
    """Number of cells with a field on each bin, and its histogram."""
    per = fields.select(*keys, cell, "iy", "ix").distinct().groupBy(*keys, "iy", "ix").agg(F.count(F.lit(1)).alias("cells"))
    return per, per.groupBy(*keys, "cells").agg(F.count(F.lit(1)).alias("bins"))
