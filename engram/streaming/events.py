"""Continuous acquisition: bouts, binned activity and threshold events as streams.

Each stream gives, once its input is drained, the rows of the batch operator that are final at the
watermark.  Rows later than the watermark are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Event files of a folder as a stream with an event time column ``at``."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def stream_bouts(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Closed bouts of a key: events no further than ``gap`` apart."""
    return (events.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"), F.max("at").alias("last"))
            .select(key, F.col("w.start").alias("start"), "last", "events", "value"))


def stream_binned_activity(events: DataFrame, key: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Events and summed value per key and (tumbling or sliding) time bin."""
    win = F.window("at", width, slide) if slide else F.window("at", width)
    return (events.withWatermark("at", delay).groupBy(win.alias("w"), key)
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
            .select(key, F.col("w.start").alias("start"), "events", "value"))


ROW = np.dtype([("at", "<i8"), ("id", "<i8"), ("v", "<f8")])


def stream_threshold_events(events: DataFrame, key: str, threshold: float, delay: str) -> DataFrame:
    """Runs of consecutive events at or above the threshold, sent out when an event below it is final.

    Events may arrive in any order within ``delay``: a key keeps those the watermark has not passed, and its open run. A timer at the earliest
    of them calls the key when the watermark has passed it; then the final ones are taken in order of (time, event_id). Events behind
    the watermark are dropped on arrival. The state of a key is bounded by its events within the delay and one trigger.
    """
    kind = events.schema[key].dataType.simpleString()
    names = [key, "start", "last", "events", "peak"]

    def step(k, batches, state):
        start, last, n, peak, kept = state.get if state.exists else (0, 0, 0, 0.0, b"")
        parts = [np.frombuffer(bytes(kept), ROW)]
        for new in batches:
            rows = np.empty(len(new), ROW)
            rows["at"], rows["id"], rows["v"] = new["_us"], new["event_id"], new["value"]
            parts.append(rows)
        rows = np.sort(np.concatenate(parts), order=["at", "id"])
        mark = state.getCurrentWatermarkMs()
        final = rows["at"] < mark * 1000
        ready, rows = rows[final], rows[~final]
        hit = ready["v"] >= threshold
        # runs of equal flags; the open run of the state goes before the first one
        edge = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]]) if len(hit) else np.zeros(0, int)
        stop = np.r_[edge[1:], len(hit)]
        size = (stop - edge)[hit[edge]]
        on, off = edge[hit[edge]], stop[hit[edge]]
        runs = [(int(ready["at"][i]), int(ready["at"][j - 1]), int(c), float(ready["v"][i:j].max())) for i, j, c in zip(on, off, size)]
        if n and len(hit):
            if hit[0]:
                runs[0] = (start, runs[0][1], n + runs[0][2], max(peak, runs[0][3]))
            else:
                runs.insert(0, (start, last, n, peak))
            n = 0
        if len(hit) and hit[-1]:
            start, last, n, peak = runs.pop()
        if n or len(rows):
            state.update((start, last, n, peak, rows.tobytes()))
            if len(rows):
                state.setTimeoutTimestamp(max(int(rows["at"][0]) // 1000, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(k[0], *r) for r in runs], columns=names)

    runs = (events.withWatermark("at", delay).select(key, "at", F.unix_micros("at").alias("_us"), "event_id", "value").groupBy(key)
            .applyInPandasWithState(step, f"`{key}` {kind}, start bigint, last bigint, events bigint, peak double",
                                    "start bigint, last bigint, n bigint, peak double, kept binary", "append", GroupStateTimeout.EventTimeTimeout))
    return runs.select(key, F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "events", "peak")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over the files that are there, write its output below ``folder`` and read it back."""
    spark = stream.sparkSession
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
