"""Row numbers over a whole table without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from engram.session import cut_lineage

ROW_BITS = 33   # monotonically_increasing_id keeps the row within its partition in the low 33 bits


def numbered(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds the row number from 0 in the order of ``by``, which should name every row apart.

    Rows are dealt out by ranges and sorted where they are; only one count per partition is summed up.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", ROW_BITS))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)   # one row per partition
    first = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_first"))
    return (rows.join(F.broadcast(first), "_part").withColumn(out, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
            .drop("_part", "_at", "_first"))
