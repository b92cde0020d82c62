"""Spark session set-up and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("engram")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "localhost")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for local runs that name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="engram-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, used once per round by the iterative operators."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop, each round written below the shared checkpoint folder and read again.

    A table that is read has the size of its files. A checkpoint keeps the size that was estimated for its plan, and where a round
    joins the results of the round before, these estimates multiply until planning alone takes minutes. Rounds that are no longer
    needed are removed."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        self.last: dict[str, str] = {}
        self.count = 0

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """The table in place of the one of the same name, which is removed once this one stands."""
        self.count += 1
        path, before = f"{self.folder}/{name}-{self.count}", self.last.get(name)
        df.write.parquet(path)
        self.last[name] = path
        if before:
            self.remove(before)
        return self.read(path, df)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """The rows put to those that were added under this name before."""
        df.write.mode("append").parquet(f"{self.folder}/{name}")
        return self.read(f"{self.folder}/{name}", df)

    def drop(self, name: str) -> None:
        if name in self.last:
            self.remove(self.last.pop(name))

    def read(self, path: str, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
