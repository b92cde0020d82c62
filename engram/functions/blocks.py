"""Ordered work on keys of any size.

A window over one key puts the whole key in one task.  A busy cell may hold a large part of a
recording, so every ordered operator here cuts a key into blocks along its order first:

* ``with_halo`` copies the few rows near a block border into the neighbour block.  Enough for
  everything with a bounded reach (lags on regular frames, rolling windows, kernels).
* ``sequence`` keeps one summary row per block, runs the carry over the summaries only, and joins
  it back.  Needed where the reach is unbounded (running sums, row numbers, last valid value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engram.functions.exprs import col

BLOCK_FRAMES = 4096
TASK_ROWS = 1 << 18   # rows of whole keys that are dealt to one task


def frame_block(frame="frame", size: int = BLOCK_FRAMES) -> Column:
    return F.floor(col(frame) / F.lit(size)).cast("long")


def with_halo(df: DataFrame, frame: str, before: int, after: int, size: int = BLOCK_FRAMES) -> DataFrame:
    """Add ``_b`` (block) and ``_core``; rows within reach of a border appear in both blocks.

    Frames count from 0.
    """
    f = F.col(frame).cast("long")
    lo = F.greatest(F.floor((f - after) / F.lit(size)).cast("long"), F.lit(0).cast("long"))
    hi = F.floor((f + before) / F.lit(size)).cast("long")
    return (df.withColumn("_b", F.explode(F.sequence(lo, hi)))
              .withColumn("_core", F.col("_b") == frame_block(frame, size)))


def block_window(keys: list[str], frame: str):
    return W.partitionBy(*keys, "_b").orderBy(frame)


def core(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_b", "_core")


def _backwards(keys: list, order: list[str], last: int):
    """Everything from the far end down to a row: a running frame, while one that ends at
    "unbounded following" would be summed afresh for every row."""
    return (W.partitionBy(*(keys or [F.lit(1)])).orderBy(*[F.col(c).desc() for c in order])
            .rowsBetween(W.unboundedPreceding, last))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Shuffle to the configured number of partitions; small groups of heavy work are not merged into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def task_count(df: DataFrame, rows: int, size: int | None = None) -> int:
    """Partitions for so many rows, or 0 where the configured ones hold at most ``size`` rows each."""
    n = -(-rows // (size or TASK_ROWS))
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def dealt(df: DataFrame, *keys: str, size: int | None = None) -> tuple[DataFrame, bool]:
    """(rows, whether every key is short): whole keys in as many partitions as the number of rows asks for, so that what a task holds
    does not grow with the table.

    Grouping by these keys and any others then needs no further shuffle.  A table that fits the configured partitions stays as it is, and
    so does one where a single key would fill a task: its keys are cut in blocks, or summed up, before they are shuffled.
    One row on the driver tells the number of rows.
    """
    total, most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    n, short = task_count(df, total or 0, size), (most or 0) <= (size or TASK_ROWS)
    return (df.repartition(n, *keys) if n and short else df), short


def sequence(df: DataFrame, keys: list[str], order: list[str], block: Column, *,
             number: str | None = None, lag: dict | None = None, lead: dict | None = None,
             cumsum: dict | None = None, ffill: dict | None = None, bfill: dict | None = None,
             short: bool = False) -> DataFrame:
    """Unbounded-reach ordered columns.

    ``block`` must not decrease along ``order``; ``order`` must be total inside a key.
    ``lag``/``lead``/``cumsum``/``ffill``/``bfill`` map an output name to an expression. ``short`` keys fit a task each (``dealt``) and
    need no blocks; rows of a null key or block are left out either way, those of a null block after they were counted.
    """
    lag, lead, cumsum, ffill, bfill = (d or {} for d in (lag, lead, cumsum, ffill, bfill))
    keys = list(keys)
    if short:
        rows = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_b", *order)
        upto, onward = rows.rowsBetween(W.unboundedPreceding, 0), _backwards(keys, ["_b", *order], 0)
        outs = [(F.row_number().over(rows) - 1).cast("bigint").alias(number)] if number else []
        outs += [F.lag(col(e)).over(rows).alias(out) for out, e in lag.items()] + [F.lead(col(e)).over(rows).alias(out) for out, e in lead.items()]
        outs += [F.coalesce(F.sum(col(e)).over(upto), F.lit(0)).alias(out) for out, e in cumsum.items()]
        outs += [F.last(col(e), True).over(upto).alias(out) for out, e in ffill.items()] + [F.last(col(e), True).over(onward).alias(out) for out, e in bfill.items()]
        known = df.withColumn("_b", block)
        return (known.dropna(subset=keys) if keys else known).select("*", *outs).filter("_b is not null").drop("_b")
    base = df.withColumn("_b", block)
    kb = [*keys, "_b"]
    pos = F.struct(*[F.col(c) for c in order])
    rows = W.partitionBy(*kb).orderBy(*order)
    upto, onward = rows.rowsBetween(W.unboundedPreceding, 0), _backwards(kb, order, 0)
    along = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_b")
    earlier, later = along.rowsBetween(W.unboundedPreceding, -1), _backwards(keys, ["_b"], -1)

    aggs, carries, outs = [], [], []
    if number:
        aggs.append(F.count(F.lit(1)).alias("_n"))
        carries.append(F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_cn"))
        outs.append((F.row_number().over(rows) - 1 + F.col("_cn")).alias(number))
    for i, (out, e) in enumerate(lag.items()):
        box = F.struct(col(e).alias("v"))
        aggs.append(F.max_by(box, pos).alias(f"_l{i}"))
        carries.append(F.lag(f"_l{i}").over(along).alias(f"_cl{i}"))
        outs.append(F.coalesce(F.lag(box).over(rows), F.col(f"_cl{i}"))["v"].alias(out))
    for i, (out, e) in enumerate(lead.items()):
        box = F.struct(col(e).alias("v"))
        aggs.append(F.min_by(box, pos).alias(f"_d{i}"))
        carries.append(F.lead(f"_d{i}").over(along).alias(f"_cd{i}"))
        outs.append(F.coalesce(F.lead(box).over(rows), F.col(f"_cd{i}"))["v"].alias(out))
    for i, (out, e) in enumerate(cumsum.items()):
        aggs.append(F.sum(col(e)).alias(f"_s{i}"))
        carries.append(F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_cs{i}"))
        outs.append((F.coalesce(F.sum(col(e)).over(upto), F.lit(0)) + F.col(f"_cs{i}")).alias(out))
    for i, (out, e) in enumerate(ffill.items()):
        e = col(e)
        aggs.append(F.max_by(e, F.when(e.isNotNull(), pos)).alias(f"_f{i}"))
        carries.append(F.last(f"_f{i}", True).over(earlier).alias(f"_cf{i}"))
        outs.append(F.coalesce(F.last(e, True).over(upto), F.col(f"_cf{i}")).alias(out))
    for i, (out, e) in enumerate(bfill.items()):
        e = col(e)
        aggs.append(F.min_by(e, F.when(e.isNotNull(), pos)).alias(f"_g{i}"))
        carries.append(F.last(f"_g{i}", True).over(later).alias(f"_cg{i}"))
        outs.append(F.coalesce(F.last(e, True).over(onward), F.col(f"_cg{i}")).alias(out))

    summary = base.groupBy(*kb).agg(*aggs).select(*kb, *carries)
    return base.join(summary, kb).select(*df.columns, *outs)


def run_bounds(df: DataFrame, keys: list[str], order: list[str], block: Column, state: Column, at: str, short: bool = False) -> DataFrame:
    """Gaps and islands without grouping by run: every row learns where its run starts and ends.

    Adds ``state``, ``run_start`` and ``run_end`` (the value of ``at`` on the first and last row of
    the run), ``is_start``, and ``key_start``/``key_end``, the ends of the whole key.  Inside a block a window finds the runs; one summary row per block
    tells the neighbours which run crosses the border.  ``short`` keys fit a task each and are one block, without a summary.  Rows of a null key or block are left out.
    """
    keys = list(keys)
    if short:
        df, block = df.filter(block.isNotNull()).dropna(subset=keys), F.lit(0).cast("bigint")
    kb = [*keys, "_b"]
    rows = W.partitionBy(*kb).orderBy(*order)
    upto, onward = rows.rowsBetween(W.unboundedPreceding, 0), _backwards(kb, order, 0)
    along = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_b")
    earlier, later = along.rowsBetween(W.unboundedPreceding, -1), _backwards(keys, ["_b"], -1)

    box = F.struct(F.col("state").alias("s"))
    near = (df.withColumn("state", state).withColumn("_b", block)
            .withColumn("_prev", F.lag(box).over(rows)).withColumn("_next", F.lead(box).over(rows)))
    near = (near.withColumn("_start", F.when(F.col("_prev").isNotNull() & ~F.col("_prev.s").eqNullSafe(F.col("state")), F.col(at)))
                .withColumn("_end", F.when(F.col("_next").isNotNull() & ~F.col("_next.s").eqNullSafe(F.col("state")), F.col(at))))
    if short:
        every = W.partitionBy(*kb)
        got = (near.withColumn("key_start", F.min(at).over(every)).withColumn("key_end", F.max(at).over(every))
               .withColumn("_opens", F.lit(True)).withColumn("_in", F.col("key_start")).withColumn("_out", F.col("key_end")))
        return _bounds(got, df.columns, upto, onward)
    pos = F.struct(*[F.col(c) for c in order])
    one = near.groupBy(*kb).agg(
        F.min_by(F.struct("state", F.col(at).alias("at")), pos).alias("_first"), F.max_by(F.struct("state", F.col(at).alias("at")), pos).alias("_last"),
        F.max_by("_start", F.when(F.col("_start").isNotNull(), pos)).alias("_ls"), F.min_by("_end", F.when(F.col("_end").isNotNull(), pos)).alias("_fe"))
    before, after = F.lag("_last").over(along), F.lead("_first").over(along)
    opens = before.isNull() | ~before["state"].eqNullSafe(F.col("_first.state"))
    closes = after.isNull() | ~after["state"].eqNullSafe(F.col("_last.state"))
    one = (one.withColumn("_opens", opens).withColumn("_closes", closes)
              .withColumn("_s", F.coalesce("_ls", F.when(F.col("_opens"), F.col("_first.at"))))
              .withColumn("_e", F.coalesce("_fe", F.when(F.col("_closes"), F.col("_last.at")))))
    whole = W.partitionBy(*(keys or [F.lit(1)]))
    one = one.select(*kb, "_opens", F.min("_first.at").over(whole).alias("key_start"), F.max("_last.at").over(whole).alias("key_end"),
                     F.when(F.col("_opens"), F.col("_first.at")).otherwise(F.last("_s", True).over(earlier)).alias("_in"),
                     F.when(F.col("_closes"), F.col("_last.at")).otherwise(F.last("_e", True).over(later)).alias("_out"))
    return _bounds(near.join(one, kb), df.columns, upto, onward)


def _bounds(got: DataFrame, columns: list[str], upto, onward) -> DataFrame:
    return got.select(*columns, "state", "key_start", "key_end",
                      (F.col("_start").isNotNull() | (F.col("_prev").isNull() & F.col("_opens"))).alias("is_start"),
                      F.coalesce(F.last("_start", True).over(upto), F.col("_in")).alias("run_start"),
                      F.coalesce(F.last("_end", True).over(onward), F.col("_out")).alias("run_end"))


def densify(df: DataFrame, keys: list[str], frame: str, values: dict[str, Column | str],
            size: int = BLOCK_FRAMES, task_rows: int | None = None) -> DataFrame:
    """Zero-fill every key on the regular frame axis 0..max(frame) of the whole recording.

    Where the frames would overfill the configured partitions, blocks of frames are dealt out before they are unfolded, to as many partitions
    as the frames ask for; keys of one block stay whole, so that what follows needs no shuffle by key either.
    """
    each = df.groupBy(*keys).agg(F.max(frame).alias("_hi")).agg(F.count(F.lit(1)), F.max("_hi")).first()   # one row sizes the partitions
    n = task_count(df, each[0] * (int(each[1] or 0) + 1), task_rows)
    last = df.agg(F.max(frame).alias("_hi"))
    blocks = (df.select(*keys).distinct().crossJoin(F.broadcast(last))
                .withColumn("_fb", F.explode(F.expr(f"sequence(0L, cast(_hi as bigint) div {size})"))))
    on = list(keys)
    if n:
        if each[1] >= size:
            on, df = [*keys, "_fb"], df.withColumn("_fb", frame_block(frame, size))
        blocks, df = blocks.repartition(n, *on), df.repartition(n, *on)
    grid = blocks.select(*on, F.explode(F.expr(
        f"sequence(_fb * {size}, least(_fb * {size} + {size - 1}, cast(_hi as bigint)))")).alias(frame))
    return (grid.join(df, [*on, frame], "left")
                .select(*keys, frame, *[F.coalesce(col(v), F.lit(0.0)).alias(k) for k, v in values.items()]))
