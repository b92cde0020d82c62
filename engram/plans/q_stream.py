"""Streams drained over the event files; the twins give the rows that are final at the watermark."""

from pyspark.sql import functions as F

from engram.functions.exprs import rounded as r
from engram.plans.q_cohort import shared_folder
from engram.plans.registry import query
from engram.sources import tables as S
from engram.streaming import events as T

MAX = "(SELECT max(ts) FROM events)"
US = "CAST(epoch_us({}) AS BIGINT)"


def _us(c):
    return F.unix_micros(c)


@query("stream_bouts", f"""WITH n AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS bout FROM n)
    SELECT user_id, {US.format('min(ts)')} AS start_us, {US.format('max(ts)')} AS last_us, count(*) AS events, round(sum(value), 4) + 0.0 AS value FROM b GROUP BY user_id, bout
    HAVING max(ts) + INTERVAL 6 HOUR <= {MAX} - INTERVAL 1 HOUR""")
def stream_bouts(spark, d):
    out = T.drain(T.stream_bouts(T.read_events(spark, d), "user_id", "6 hours", "1 hour"), shared_folder(spark, "bouts"))
    return out.select("user_id", _us("start").alias("start_us"), _us("last").alias("last_us"), "events", r("value", 4).alias("value"))


@query("stream_binned_activity", f"""SELECT user_id, {US.format("date_trunc('hour', ts)")} AS start_us, count(*) AS events, round(sum(value), 4) + 0.0 AS value FROM events
    GROUP BY 1, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {MAX} - INTERVAL 1 HOUR""")
def stream_binned_activity(spark, d):
    out = T.drain(T.stream_binned_activity(T.read_events(spark, d), "user_id", "1 hour", "1 hour"), shared_folder(spark, "bins"))
    return out.select("user_id", _us("start").alias("start_us"), "events", r("value", 4).alias("value"))


@query("stream_threshold_events", f"""WITH n AS (SELECT user_id, ts, event_id, value, value >= 60 AS hit, lag(value >= 60) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(CASE WHEN hit IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n),
    l AS (SELECT user_id, run, any_value(hit) AS hit, min(ts) AS a, max(ts) AS z, count(*) AS c, max(value) AS pk FROM b GROUP BY 1, 2)
    SELECT l.user_id, {US.format('l.a')} AS start_us, {US.format('l.z')} AS last_us, l.c AS events, l.pk AS peak FROM l JOIN l q ON q.user_id = l.user_id AND q.run = l.run + 1
    WHERE l.hit AND epoch_us(q.a) < (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)""")
def stream_threshold_events(spark, d):
    out = T.drain(T.stream_threshold_events(T.read_events(spark, d), "user_id", 60.0, "1 hour"), shared_folder(spark, "runs"))
    return out.select("user_id", _us("start").alias("start_us"), _us("last").alias("last_us"), "events", "peak")
