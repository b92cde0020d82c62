"""Sums of products for all pairs of items that share coordinates.

An item travels as arrays of its coordinates and values, once per tile it meets, and a task multiplies two tiles of items in dense
blocks of coordinates. Only a coordinate axis longer than a task may hold is cut in slabs whose results Spark adds. No row per (pair,
coordinate) is ever made, and a coordinate shared by every item stays inside one bounded piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

TILE = 256         # items of a tile where a task needs room for more than products
NARROW = 2048      # items of a tile while there are few of them, so that all cores have pieces
WIDE = 16384       # items of a tile that only travels and multiplies; a task holds a strip of its products
FEW = 8            # tiles, and so copies of an item, up to which tiles stay narrow
HELD = 1 << 23     # numbers of a tile (items x coordinates) that a task may hold
ENTRIES = 1 << 22  # entries of a tile that a task may hold
STRIP = 256        # items of a tile that are multiplied with the other tile at once


def _tile(item: Column, tiles: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(tiles)).cast("int")


def tile_count(items: int, per_tile: int) -> int:
    """Tiles for so many items when a task can hold ``per_tile`` of them: narrow ones for few items, else as wide as they may be,
    because every item is copied once per tile."""
    widest = -(-items // max(1, min(WIDE, per_tile)))
    return max(1, widest, min(FEW, -(-items // NARROW)))


def to_pieces(items: DataFrame, item: str, tiles: int) -> DataFrame:
    """Every row goes to the pieces (``_ti`` <= ``_tj``) of its tile ``_t``."""
    out = items.withColumn("_t", _tile(F.col(item), tiles)).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return out.withColumn("_ti", F.least("_t", "_o")).withColumn("_tj", F.greatest("_t", "_o")).drop("_o")


def deal_pieces(pieces: DataFrame, tiles: int, *cols: str) -> DataFrame:
    """Shuffle pieces of so many tiles to several partitions each, so that no heavy piece waits behind others in one task."""
    configured = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(max(configured, min(4 * (tiles * (tiles + 1) // 2), 1024)), *cols)


def sides(rows: pa.Table, at: np.ndarray, code: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(left items, right items, arguments of ``_products``: item, value, coordinate, number) of a piece ``_ti``, ``_tj``, from the entries' items and (value, coordinate) ``of``."""
    tile = rows["_t"].to_numpy()[at]
    left, right = (np.flatnonzero(tile == rows[t][0].as_py()) for t in ("_ti", "_tj"))
    entries = []
    for some in (left, right):
        to = np.full(len(at), -1)
        to[some] = np.arange(len(some))
        own = to[code] >= 0
        entries += [to[code[own]], *(x[own] for x in of), len(some)]
    return left, right, entries


def exceeds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x > y as Spark has it, where NaN is above all numbers."""
    return (x > y) | (np.isnan(x) & ~np.isnan(y))


def unpack(rows: pa.Table, item: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted items, their row numbers, item number, coordinate and value of every entry) of rows with arrays ``_c`` and ``_v``."""
    at = pc.sort_indices(rows[item].combine_chunks()).to_numpy()
    place = np.empty(len(at), int)
    place[at] = np.arange(len(at))
    c, v = rows["_c"].combine_chunks(), rows["_v"].combine_chunks()
    code = np.repeat(place, pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(int))
    return rows[item].combine_chunks().take(pa.array(at)), at, code, c.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).astype(float)


def _products(ca: np.ndarray, va: np.ndarray, xa: np.ndarray, na: int, cb, vb, xb, nb: int, block: int, sums: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(first item, shared coordinates, sums of products) of strips of the na items with all nb items, from their entries (item, value, coordinate)."""
    there = np.zeros(int(max(xa.max(initial=-1), xb.max(initial=-1))) + 1, bool)
    there[xa] = True
    place = np.cumsum(there, dtype=np.int32) - np.int32(1)
    on = there[xb]       # the right side may lie where the left has nothing
    cb, vb, xb = cb[on], vb[on], place[xb[on]]
    xa = place[xa]
    order = np.argsort(xb, kind="stable")
    cb, vb, xb = cb[order], vb[order], xb[order]
    order = np.argsort(ca, kind="stable")
    ca, va, xa = ca[order], va[order], xa[order]
    width = int(there.sum())
    wide = max(1, min(block, HELD // max(nb, 1)))      # the right side is made dense so many coordinates at a time
    many = max(STRIP, HELD // max(nb, 1))              # and multiplied with so many items, whose sums are held
    for first in range(0, na, many):
        k = min(many, na - first)
        mine = slice(*np.searchsorted(ca, (first, first + k)))
        c, v, x = ca[mine] - first, va[mine], xa[mine]
        order = np.argsort(x, kind="stable")
        c, v, x = c[order], v[order], x[order]
        n, xy = np.zeros((k, nb), np.int32), np.zeros((k, nb)) if sums else None
        for lo in range(0, width, wide):
            dense = []
            for cs, vs, xs, rows in ((c, v, x, k), (cb, vb, xb, nb)):
                part = slice(*np.searchsorted(xs, (lo, lo + wide)))
                hit = np.zeros((rows, wide), np.float32)     # whole numbers up to the block size are exact
                hit[cs[part], xs[part] - lo] = 1.0
                m = None
                if sums:
                    m = np.zeros((rows, wide))
                    m[cs[part], xs[part] - lo] = vs[part]
                dense.append((hit, m))
            n += (dense[0][0] @ dense[1][0].T).astype(np.int32)
            if sums:
                xy += dense[0][1] @ dense[1][1].T
        yield first, n, xy


def pair_products(left: DataFrame, right: DataFrame | None, keys: list[str], item: str, coord: str,
                  value: str, *, coord_block: int = 2048, tiles: int | None = None,
                  ordered: bool = False, sums: bool = True, sizes: bool = False, least: float | None = None) -> DataFrame:
    """``keys, a, b, n, sxy`` summed over shared coordinates, for a < b (or a != b when two sides are given, unless ``ordered``).

    ``(keys, item, coord)`` must be unique on each side and ``coord`` a long.  Pairs without a shared coordinate give no row. Without
    ``sums`` there is no sxy. ``sizes`` adds n_a and n_b, the rows of each item, and ``least`` leaves only pairs that share at least this
    part of the smaller item; on an axis of one slab no other pair leaves its task. A null item has no pairs.
    """
    both = right is not None
    sizes = sizes or least is not None

    def shape(df, side):
        return df.filter(F.col(item).isNotNull()).select(*keys, F.col(item).alias("item"), F.col(coord).cast("long").alias("coord"), F.col(value).cast("double").alias("v"), F.lit(side).alias("_s"))

    every = shape(left, 0).unionByName(shape(right, 1)) if both else shape(left, 0)
    # One row on the driver sizes the tiles and slabs; it holds data volume, not data.
    per = every.groupBy(*keys, "_s", "item").agg(F.min("coord").alias("_lo"), F.max("coord").alias("_hi"), F.count(F.lit(1)).alias("_m"))
    most = (per.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_k"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_m").alias("_m"))
            .agg(F.max("_k"), F.min("_lo"), F.max("_hi"), F.max("_m")).first())
    cells, lo, hi = most[0] or 1, most[1] or 0, most[2] or 0
    if tiles is None:
        per_tile = NARROW
        if cells > NARROW * FEW:      # tiles may become wide; a long axis is cut in slabs
            per_tile = max(NARROW, ENTRIES * cells // most[3])
        tiles = tile_count(cells, per_tile)
    width = max(coord_block, HELD // min(NARROW, -(-cells // tiles)))
    whole = hi - lo < width
    slab = F.lit(0) if whole else F.coalesce(F.floor((F.col("coord") - lo) / width), F.lit(0))
    every = every.withColumn("_cb", slab.cast("long")).withColumn("_at", (F.col("coord") - lo - F.col("_cb") * width).cast("smallint" if width <= 1 << 15 else "int"))
    entry = F.when(F.col("_at").isNotNull(), F.struct("_at", "v")) if sums else F.col("_at")
    coords, values = (F.col("_e._at"), F.col("_e.v")) if sums else (F.col("_e"), F.array().cast("array<double>"))
    packed = (every.groupBy(*keys, "_s", "item", "_cb").agg(F.collect_list(entry).alias("_e"), F.count(F.lit(1)).alias("_n"))
              .select(*keys, "_s", "item", "_cb", coords.alias("_c"), values.alias("_v"), "_n"))
    pieces = to_pieces(packed, "item", tiles)
    if both:   # the left meets all right tiles and the right all left ones
        other = F.col("_ti") + F.col("_tj") - F.col("_t")
        pieces = pieces.withColumn("_x", other).withColumn("_ti", F.when(F.col("_s") == 0, F.col("_t")).otherwise(F.col("_x"))).withColumn("_tj", F.when(F.col("_s") == 0, F.col("_x")).otherwise(F.col("_t"))).drop("_x")
    kind = left.schema[item].dataType
    more = [T.StructField("sxy", T.DoubleType())] * sums + [T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType())] * sizes
    schema = T.StructType([*[left.schema[k] for k in keys], T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType()), *more])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ids, at, code, x, v = unpack(rows, "item")
        v = v if sums else np.zeros(len(x), bool)
        side, tile, count = (rows[c].to_numpy()[at] for c in ("_s", "_t", "_n"))
        ti, tj = rows["_ti"][0].as_py(), rows["_tj"][0].as_py()
        lefts, rights = (np.flatnonzero((tile == t) & ((side == s) | (not both))) for t, s in ((ti, 0), (tj, 1)))
        entries = []
        for some in (lefts, rights):
            to = np.full(len(at), -1)
            to[some] = np.arange(len(some))
            own = to[code] >= 0
            entries += [to[code[own]], v[own], x[own], len(some)]
        same = [pa.scalar(rows[k][0].as_py(), rows.schema.field(k).type) for k in keys]
        rank = pc.rank(ids, tiebreaker="dense").to_numpy() if both else None
        some = max(1, HELD // (8 * max(len(rights), 1)))      # items whose pairs leave as one batch
        for first, products, sxy in _products(*entries, coord_block, sums):
            for lo in range(0, len(products), some):
                n = products[lo:lo + some]
                mine = lefts[first + lo:first + lo + len(n)]      # a strip may end before a batch does
                keep = n > 0
                if both:
                    ra, rb = rank[mine][:, None], rank[rights][None, :]
                    keep &= (ra < rb) if ordered else (ra != rb)
                elif ti == tj:
                    keep &= mine[:, None] < rights[None, :]
                if least is not None and whole:
                    keep &= n / np.minimum(count[mine][:, None], count[rights][None, :]) >= least
                i, j = np.nonzero(keep)
                a, b = mine[i], rights[j]
                one, two = (a, b) if both else (np.minimum(a, b), np.maximum(a, b))
                out = [pa.repeat(k, len(i)) for k in same]
                out += [ids.take(pa.array(one)), ids.take(pa.array(two)), pa.array(n[i, j].astype(np.int64))] + ([pa.array(sxy[lo:lo + some][i, j])] if sums else [])
                out += [pa.array(count[one]), pa.array(count[two])] if sizes else []
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    found = deal_pieces(pieces, tiles, *keys, "_cb", "_ti", "_tj").groupBy(*keys, "_cb", "_ti", "_tj").applyInArrow(multiply, schema)
    if whole:
        return found
    found = found.groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"), *[F.sum("sxy").alias("sxy")] * sums)
    if not sizes:
        return found
    size = every.groupBy(*keys, "_s", "item").agg(F.count(F.lit(1)).alias("_n"))
    for name, s in (("a", 0), ("b", 1 if both else 0)):
        own = size.filter(F.col("_s") == s).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("item").alias("_item"), F.col("_n").alias(f"n_{name}"))
        on = F.col(name) == F.col("_item")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        found = found.join(own, on).drop("_item", *[f"_k{i}" for i in range(len(keys))])
    return found if least is None else found.filter(F.col("n") / F.least("n_a", "n_b") >= least)
