"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a grid, the rows are sorted by the index of their cell on the Hilbert curve and the
sorted run is cut into shards. Neighbours on the curve are neighbours in every dimension, so each shard (and each file in it) spans
narrow ranges of all dimensions and readers can skip files by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.session import cut_lineage

ROW_BITS = 33   # monotonically_increasing_id keeps the row within its partition in the low 33 bits


def log_cell(value: Column, bits: int) -> Column:
    """Cell of a size on a logarithmic scale with four cells per doubling; nulls and sizes below 1 are cell 0.

    Integer arithmetic only: bit length and the two bits after the leading one. Cells beyond the grid share its last cell.
    """
    v = F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    length = F.length(F.bin(v)).cast("int")
    mantissa = F.when(length >= 3, F.call_function("shiftright", v, length - 3).bitwiseAND(F.lit(3))).otherwise(F.lit(0)).cast("int")
    return F.when(v < 1, F.lit(0)).otherwise(F.least(4 * length + mantissa - 3, F.lit((1 << bits) - 1))).cast("int")


def label_cell(value: Column, bits: int) -> Column:
    """Cell of a category: equal categories share one; a null is cell 0."""
    return F.coalesce(F.pmod(F.crc32(value.cast("string").cast("binary")), F.lit(1 << bits)), F.lit(0)).cast("int")


def curve_index(df: DataFrame, cells: list[str], bits: int, out: str) -> DataFrame:
    """Adds the Hilbert index of the grid cell named by the integer columns `cells` (each 0 .. 2^bits - 1).

    One step per bit and axis, from the highest bit down: where an axis has the bit, the first axis is flipped below it,
    otherwise the lower bits of the two are exchanged. A Gray code along the axes then gives the digits of the index.
    """
    n = len(cells)
    x = [f"__x{i}" for i in range(n)]
    df = df.withColumns({x[i]: F.col(c).cast("int") for i, c in enumerate(cells)})
    for b in range(bits - 1, 0, -1):
        low = F.lit((1 << b) - 1)
        for i in range(n):
            has = F.col(x[i]).bitwiseAND(F.lit(1 << b)) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(low)
            first = F.when(has, F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]).bitwiseXOR(swap))
            new = {x[0]: first} if i == 0 else {x[0]: first, x[i]: F.when(has, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))}
            df = df.withColumns(new)
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0)
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[n - 1]).bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__turn", turn)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col("__turn")), b).bitwiseAND(F.lit(1)).cast("long")
            index = index * 2 + bit
    return df.withColumn(out, index).drop(*x, "__turn")


def ranked(df: DataFrame, by: list[str], weight: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `__rank` from 0 and `__before`, the weight before them; totals) over the order of the columns `by`.

    A range shuffle and a local sort give the order; only one count and weight per partition are summed over partitions.
    The ordered rows are checkpointed, so ranks stay as they are when a task is repeated.
    """
    spread = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    spread = cut_lineage(spread.sortWithinPartitions(*by).withColumn("__mid", F.monotonically_increasing_id()))
    spread = spread.withColumn("__pid", F.shiftright("__mid", ROW_BITS))
    parts = spread.groupBy("__pid").agg(F.count("*").alias("__n"), F.sum(weight).alias("__w"))
    ahead = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)   # one row per partition
    starts = parts.select("__pid", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__w").over(ahead), F.lit(0)).alias("__w0"))
    inside = W.partitionBy("__pid").orderBy("__mid").rowsBetween(W.unboundedPreceding, -1)
    rows = (spread.withColumn("__win", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(starts), "__pid")
            .withColumn("__rank", F.col("__n0") + F.col("__mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
            .withColumn("__before", F.col("__w0") + F.col("__win")).drop("__pid", "__mid", "__n0", "__w0", "__win"))
    return rows, parts.agg(F.sum("__n").alias("__n_all"), F.sum("__w").alias("__w_all"))


def shards(df: DataFrame, cells: dict[str, Column], tie: list[str], size: str, n_shards: int, law: str = "rows", bits: int = 5) -> DataFrame:
    """Adds `curve` (Hilbert index), `shard` (0 .. n_shards - 1) and `slot` (gapless position in the shard).

    law "rows": counts differ by one at most. law "bytes": cuts at equal shares of the summed `size`.
    Rows of one cell are ordered by `tie`; fully equal rows are interchangeable. Null metadata are cell 0, an empty table stays empty.
    A hot category is spread by `tie`, so no partition of the sort depends on one value. Helper columns start with two underscores;
    other columns of the input are kept, those named curve, shard or slot as curve_in, shard_in and slot_in.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    df = df.withColumns({f"__c_{k}": v for k, v in cells.items()})
    names = [f"__c_{k}" for k in cells]
    own = {c: f"{c}_in" for c in df.columns if c in ("curve", "shard", "slot")}
    df = curve_index(df.withColumnsRenamed(own), names, bits, "curve").drop(*names)
    rows, totals = ranked(df, ["curve", *[own.get(c, c) for c in tie]], own.get(size, size))
    share = F.expr(f"(__rank * {n_shards}) div __n_all" if law == "rows" else f"(__before * {n_shards}) div __w_all")
    rows = rows.crossJoin(F.broadcast(totals)).withColumn("shard", share.cast("int"))   # totals: one row
    first = rows.groupBy("shard").agg(F.min("__rank").alias("__first"))                  # at most n_shards rows
    return (rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("__rank") - F.col("__first"))
            .drop("__rank", "__before", "__n_all", "__w_all", "__first"))


def write_shards(df: DataFrame, path: str) -> None:
    """Writes rows that carry `shard` and `slot` to one folder per shard, in curve order; a shard's rows keep to their own files."""
    (df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path))
