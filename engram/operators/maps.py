"""Geometry of rate maps: coherence, walls, field properties.

Map operators work on sparse maps (keys, iy, ix, value) with a known shape (ny, nx).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from engram.functions.exprs import pearson_from_sums, ratio


def coherence(maps: DataFrame, keys: list[str], value: str, shape: tuple[int, int]) -> DataFrame:
    """Pearson of the map with the mean of its 8 neighbours; bins without a value count as 0."""
    ny, nx = shape
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sent = (maps.withColumn("_k", F.explode(steps))
            .select(*keys, (F.col("iy") + F.col("_k.dy")).alias("iy"), (F.col("ix") + F.col("_k.dx")).alias("ix"),
                    F.when((F.col("_k.dy") == 0) & (F.col("_k.dx") == 0), F.col(value)).otherwise(0.0).alias("_own"),
                    F.when((F.col("_k.dy") == 0) & (F.col("_k.dx") == 0), 0.0).otherwise(F.col(value) / 8).alias("_near"))
            .filter((F.col("iy") >= 0) & (F.col("iy") < ny) & (F.col("ix") >= 0) & (F.col("ix") < nx)))
    bins = sent.groupBy(*keys, "iy", "ix").agg(F.sum("_own").alias("_o"), F.sum("_near").alias("_m"))
    o, m = F.col("_o"), F.col("_m")
    sums = bins.groupBy(*keys).agg(F.sum(o).alias("so"), F.sum(m).alias("sm"), F.sum(o * o).alias("soo"),
                                   F.sum(m * m).alias("smm"), F.sum(o * m).alias("som"))
    return sums.select(*keys, pearson_from_sums(F.lit(ny * nx), "so", "sm", "soo", "smm", "som").alias("coherence"))


def field_props(fields: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Area, bounding box, centroid, peak and rates of every labelled field."""
    return (fields.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"), F.min("iy").alias("y0"), F.min("ix").alias("x0"), (F.max("iy") + 1).alias("y1"),
        (F.max("ix") + 1).alias("x1"), F.avg("iy").alias("cy"), F.avg("ix").alias("cx"), F.avg(value).alias("mean_rate"),
        F.max(F.struct(F.col(value).alias("v"), (-F.col("iy")).alias("y"), (-F.col("ix")).alias("x"))).alias("_p"))
        .withColumn("peak_rate", F.col("_p.v")).withColumn("peak_iy", -F.col("_p.y")).withColumn("peak_ix", -F.col("_p.x")).drop("_p"))


def _to_walls(bins: DataFrame, shape: tuple[int, int], walls: str) -> DataFrame:
    """One row per wanted wall: the line along the wall and the depth from it."""
    ny, nx = shape
    at = {"l": ("iy", F.col("ix")), "r": ("iy", F.lit(nx - 1) - F.col("ix")),
          "b": ("ix", F.col("iy")), "t": ("ix", F.lit(ny - 1) - F.col("iy"))}
    rows = F.array(*[F.struct(F.lit(w).alias("wall"), F.col(at[w][0]).alias("line"), at[w][1].alias("depth"))
                     for w in sorted(set(walls.lower()))])
    return bins.withColumn("_w", F.explode(rows))


def border_coverage(visited: DataFrame, fields: DataFrame, keys: list[str], field: str, shape: tuple[int, int],
                    search_width: int = 8, walls: str = "trbl") -> DataFrame:
    """Largest share of a wall covered by one field.

    Along a wall every line counts by its first visited bin within the search width.
    """
    if not walls or set(walls.lower()) - set("trbl"):
        raise ValueError("walls are named by the letters t, r, b and l")
    lines = (_to_walls(visited.select(*keys, "iy", "ix"), shape, walls).filter(F.col("_w.depth") < search_width)
             .groupBy(*keys, F.col("_w.wall").alias("wall"), F.col("_w.line").alias("line"))
             .agg(F.min("_w.depth").alias("depth")))
    total = lines.groupBy(*keys, "wall").agg(F.count(F.lit(1)).alias("_n"))
    inside = (_to_walls(fields.select(*keys, field, "iy", "ix"), shape, walls)
              .select(*keys, field, F.col("_w.wall").alias("wall"), F.col("_w.line").alias("line"), F.col("_w.depth").alias("depth")))
    hit = inside.join(lines, [*keys, "wall", "line", "depth"]).groupBy(*keys, field, "wall").agg(F.count(F.lit(1)).alias("_c"))
    best = hit.join(total, [*keys, "wall"]).groupBy(*keys).agg(F.max(ratio("_c", "_n")).alias("coverage"))
    units = visited.select(*keys).distinct()
    return units.join(best, keys, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def border_score(visited: DataFrame, fields: DataFrame, keys: list[str], field: str, rate: str, shape: tuple[int, int],
                 search_width: int = 8, walls: str = "trbl") -> DataFrame:
    """(coverage - weighted wall distance) / (their sum); -1 and 0 without a field."""
    ny, nx = shape
    cov = border_coverage(visited, fields, keys, field, shape, search_width, walls)
    dist = F.least(F.col("ix") + 1, F.lit(nx) - F.col("ix"), F.col("iy") + 1, F.lit(ny) - F.col("iy"))
    bins = fields.select(*keys, "iy", "ix", rate).distinct()
    wfd = bins.groupBy(*keys).agg((2 * ratio(F.sum(dist * F.col(rate)), F.sum(rate)) / F.lit(min(shape))).alias("wfd"))
    out = cov.join(wfd, keys, "left")
    score = F.when(F.col("wfd").isNull(), F.lit(-1.0)).otherwise(ratio(F.col("coverage") - F.col("wfd"), F.col("coverage") + F.col("wfd")))
    return out.select(*keys, score.alias("score"), "coverage")


def nearest6(peaks: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """The closest peaks around the centre in order of their angle (``dy``, ``dx`` from the centre)."""
    d = F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    p = peaks.withColumn("distance", d).withColumn("angle", F.atan2("dy", "dx"))
    w = W.partitionBy(*keys).orderBy("distance", "dy", "dx")
    top = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    return top.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("angle", "distance")))


def grid_stats(peaks: DataFrame, keys: list[str], min_orientation: float = 15.0, bin_width: float = 1.0) -> DataFrame:
    """Spacing and orientation from the six peaks around the centre of an autocorrelogram.

    Of two peaks in nearly the same direction the farther one is left out; units with fewer than
    six peaks give nothing.
    """
    # An autocorrelogram has few peaks, so those of a unit are compared as one array; the peaks are made once.
    d = F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    p = peaks.dropna(subset=keys).groupBy(*keys).agg(F.collect_list(F.struct(d.alias("_d"), "dy", "dx", F.atan2("dy", "dx").alias("_a"))).alias("_p")).filter(F.size("_p") >= 6)
    turn = lambda a, b: F.abs(F.atan2(F.sin(a["_a"] - b["_a"]), F.cos(a["_a"] - b["_a"])))
    place = lambda a: F.struct(a["_d"], a["dy"], a["dx"])
    behind = lambda a: F.exists("_p", lambda b: (place(a) > place(b)) & (turn(a, b) < F.lit(min_orientation * 3.141592653589793 / 180)))
    six = nearest6(p.select(*keys, F.inline(F.filter("_p", lambda a: ~behind(a)))).drop("_d", "_a"), keys)
    first = six.filter("rank <= 3")
    o = F.pmod(F.degrees("angle"), F.lit(60.0))
    return (first.withColumn("_o", F.when(60 - o < o, o - 60).otherwise(o)).groupBy(*keys)
            .agg((F.avg("distance") * bin_width).alias("spacing"), F.avg("_o").alias("orientation"),
                 F.stddev_pop("_o").alias("orientation_sd")))


def footprint_maps(pixels: DataFrame, keys: list[str], lam: str) -> DataFrame:
    """Footprint weights scaled to 0..1 per cell."""
    ext = pixels.groupBy(*keys).agg(F.min(lam).alias("_lo"), F.max(lam).alias("_hi"))
    return pixels.join(ext, keys).withColumn("w", ratio(F.col(lam) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def unscramble_segments(maps: DataFrame, pos: str, order: list[int], length: int) -> DataFrame:
    """Move the k-th stretch of the belt to the place it has in ``order``."""
    place = F.array(*[F.lit(order.index(k)) for k in range(len(order))])
    k = F.floor(F.col(pos) / length).cast("int")
    moved = F.element_at(place, k + 1) * length + F.pmod(F.col(pos), F.lit(length))
    return maps.withColumn(pos, F.when(k < len(order), moved).otherwise(F.col(pos)).cast("long"))
