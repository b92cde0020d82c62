"""Views that give the star-schema test tables the shape of recordings.

Each view has its SQL twin in ``SQL``; both describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engram.functions.blocks import dealt, densify, sequence

ORIGIN = "2024-01-01 00:00:00"
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
GAIN = 997.0   # recorded counts per unit of signal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark, d) -> DataFrame:
    """unit_id, t_us since the start of the recording, kind, value, event_id."""
    t = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{ORIGIN}', ts)")
    return table(spark, d, "events").select(F.col("user_id").alias("unit_id"), t.alias("t_us"),
                                            F.col("event_type").alias("kind"), "value", "event_id")


def activity(spark, d) -> DataFrame:
    """Sparse rows (cell_id, frame, f, n); one frame is one hour."""
    return (spikes(spark, d).groupBy(F.col("unit_id").alias("cell_id"), F.expr(f"t_us div {HOUR_US}").alias("frame"))
            .agg(F.sum("value").alias("f"), F.count(F.lit(1)).alias("n")))


def traces(spark, d) -> DataFrame:
    """Dense rows (cell_id, frame, f) on a regular frame axis."""
    return densify(activity(spark, d), ["cell_id"], "frame", {"f": "f"})


def tracking(spark, d) -> DataFrame:
    """Unordered position samples with a signal; (ok, ln, pk) names a row inside a unit and day."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.expr("timestampdiff(DAY, timestamp_ntz'1995-01-01 00:00:00', l_shipdate)").alias("t"),
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"),
        (F.col("l_extendedprice") / GAIN).alias("signal"), F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"))


def track(spark, d) -> DataFrame:
    """Regular track (session, frame, x, y, signal, t): samples of a session numbered in time order."""
    # A day of one session is cut further by order key, so no block grows with the session.
    block = F.col("t") * F.lit(1 << 20) + F.shiftright(F.col("ok"), 26)
    samples, short = dealt(tracking(spark, d), "unit")
    return (sequence(samples, ["unit"], ["t", "ok", "ln", "pk"], block, number="frame", short=short)
            .select(F.col("unit").alias("session"), F.col("frame").cast("long").alias("frame"), "x", "y", "signal", "t"))


def short_tracks(spark, d) -> bool:
    """Whether every session fits a task."""
    return dealt(tracking(spark, d), "unit")[1]


def states(spark, d) -> DataFrame:
    """Population states in long form (frame, position, dim, v)."""
    return (table(spark, d, "embeddings")
            .select(F.col("vec_id").alias("frame"), F.col("label").alias("position"), F.posexplode("embedding").alias("dim", "v"))
            .withColumn("v", F.col("v").cast("double")))


def state_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("position"),
                                                F.col("embedding").cast("array<double>").alias("vec"))


def pixels(spark, d) -> DataFrame:
    return (table(spark, d, "lineitem")
            .select(F.col("l_suppkey").alias("cell_id"), F.pmod("l_partkey", F.lit(64)).alias("x"),
                    F.pmod("l_orderkey", F.lit(64)).alias("y")).distinct())


def sessions(spark, d) -> DataFrame:
    """One row per (animal, session, cell): orders of a market segment per year."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("c_mktsegment").alias("animal"), F.year("o_orderdate").alias("session"),
                    F.col("o_custkey").alias("cell_id"), F.col("o_orderkey").alias("frame"),
                    F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("status"),
                    F.expr("timestampdiff(DAY, timestamp_ntz'1995-01-01 00:00:00', o_orderdate)").alias("day")))


SQL = {
    "spikes": f"""spikes AS (SELECT user_id AS unit_id, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}') AS BIGINT) AS t_us,
        event_type AS kind, value, event_id FROM events)""",
    "activity": f"""activity AS (SELECT unit_id AS cell_id, t_us // {HOUR_US} AS frame, sum(value) AS f, count(*) AS n
        FROM spikes GROUP BY 1, 2)""",
    "traces": """traces AS (SELECT c.cell_id, g.frame, coalesce(a.f, 0.0) AS f
        FROM (SELECT DISTINCT cell_id FROM activity) c
        CROSS JOIN (SELECT CAST(unnest(range(0, (SELECT max(frame) + 1 FROM activity))) AS BIGINT) AS frame) g
        LEFT JOIN activity a ON a.cell_id = c.cell_id AND a.frame = g.frame)""",
    "tracking": f"""tracking AS (SELECT l_suppkey AS unit, date_diff('day', TIMESTAMP '1995-01-01 00:00:00', l_shipdate) AS t,
        l_quantity AS x, round(l_discount * 100) AS y, l_extendedprice / {GAIN} AS signal, l_orderkey AS ok,
        l_linenumber AS ln, l_partkey AS pk FROM lineitem)""",
    "track": """track AS (SELECT unit AS session, row_number() OVER (PARTITION BY unit ORDER BY t, ok, ln, pk) - 1 AS frame,
        x, y, signal, t FROM tracking)""",
    "states": """states AS (SELECT vec_id AS frame, label AS position, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim,
        CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""",
    "pixels": """pixels AS (SELECT DISTINCT l_suppkey AS cell_id, l_partkey % 64 AS x, l_orderkey % 64 AS y FROM lineitem)""",
    "sessions": """sessions AS (SELECT c_mktsegment AS animal, CAST(year(o_orderdate) AS INTEGER) AS session, o_custkey AS cell_id,
        o_orderkey AS frame, o_totalprice AS v, o_orderstatus AS status,
        date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS day
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
}
NEEDS = {"activity": ["spikes"], "traces": ["spikes", "activity"], "track": ["tracking"]}


def with_views(names: str, *parts: str) -> str:
    """``WITH`` clause for the named views followed by further CTEs; the last part is the query."""
    order: list[str] = []
    for n in names.split():
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    ctes = [SQL[n] for n in order] + list(parts[:-1])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + parts[-1]
