"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, k: int):
    """crc32 of the id as text, modulo k: the folds that hold rows out of training."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(k))


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a (cheap or checkpointed) table of at most `rows` rows; a larger one stays a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, bound: int) -> DataFrame:
    """At most `bound` labelled rows per class outside the held-out fold, chosen by a hash of the id: (doc_id, text, y).

    The chosen ids are at most 2 * bound longs, so they may be broadcast; texts are read for them alone.
    Null ids, null labels and null texts are no training rows. A doc_id that carries several labels counts with the smallest.
    """
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
           .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out)
           .groupBy("doc_id").agg(F.min("y").alias("y")))
    order = F.xxhash64("doc_id", F.lit(17))
    pick = [ids.filter(F.col("y") == y).orderBy(order, "doc_id").limit(bound) for y in (0, 1)]
    chosen = pick[0].unionAll(pick[1])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
            .join(F.broadcast(chosen), "doc_id"))


_owner: list[str] = []
_remembered: dict = {}


def remembered(owner: str, key, make):
    """What an operator keeps in a Python worker from task to task (words it has worked out, vocabularies). Workers outlive stages, so what
    another operator has kept goes when this one starts: a pipeline holds the memory of one operator at a time."""
    if _owner != [owner]:
        _owner[:] = [owner]
        _remembered.clear()
    if key not in _remembered:
        _remembered[key] = make()
    return _remembered[key]
