"""Exact top-k inner products by best-first search in a paged M-tree.

Vectors are quantised to integers. One more coordinate, sqrt(M - |x|^2) with M the greatest squared norm, gives all rows one norm, and
a larger inner product with a query (whose extra coordinate is 0) becomes a smaller Euclidean distance: |q' - x'|^2 = |q|^2 + M - 2 q.x.

The tree has three levels. Leaf nodes are pages: rows of one routing vector, sorted by their distance to it (parent distance) and cut, so a
page knows the least and greatest parent distance in it. Routing vectors come from a bounded sample; each knows its covering radius and
its distance to its parent, one of the few roots, which again have covering radii. Routes and roots are as many as ROUTES says, whatever
the data, and go to every task; pages stay tables.

The search goes best first, in rounds for all queries at once. A query descends from the roots: a root whose ball is out of reach is left out
with all below it, a stored parent distance rules a route out before its distance is computed, and only pages of routes in reach are
looked up. Of the open pages in reach the best ones are read, eight times as many in each round, and the k-th score so far tightens
the reach for the next. It ends when no query has an open page in reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.session import Rounds, cut_lineage

ROUTES = 256               # routing vectors at most: the bounded sample
ROOTS = 16                 # of them, the roots of the tree
WIDEN = 8                  # how many times more pages a round reads than the one before
PAGE = 1024                # rows of a page
BLOCK = 256                # queries of a block
SLACK = 1e-6               # relative slack of bounds, far above the rounding of doubles


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a double. Vectors that are null, empty or hold null, NaN or infinite components
    take no part; neither do rows without id."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (df.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of a with rows of b; doubles hold them while they stay below 2^53."""
    if len(a) and len(b) and float(np.abs(a).sum(axis=1).max()) * float(np.abs(b).max()) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], dtype=np.int64).reshape(len(a), len(b))


def routes_of(rows: DataFrame, dim: int) -> np.ndarray:
    """At most ROUTES distinct rows, chosen by a hash of the vector so that copies count once."""
    some = rows.select("v").groupBy(F.xxhash64("v").alias("h")).agg(F.first("v").alias("v")).orderBy("h").limit(ROUTES).toArrow()
    return matrix(some["v"]) if len(some) else np.zeros((0, dim))


def pages(rows: DataFrame, routes: np.ndarray, norm: float) -> DataFrame:
    """Leaf nodes (page, parent, near, far, ids, data): rows of one parent whose parent distances lie in [near, far].

    Rows are sorted over all tasks by (parent, distance, id), so one frequent vector fills many pages, and a task cuts its run into pages."""
    shared = rows.sparkSession.sparkContext.broadcast(routes)
    lift = lambda x: np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        rx = lift(r)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x = matrix(part.column(1))
                d2 = (x * x).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None, :] - 2 * (x @ r.T) + (lift(x)[:, None] - rx[None, :]) ** 2
                parent = d2.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(parent.astype(np.int32)), pa.array(np.sqrt(np.maximum(d2[np.arange(len(x)), parent], 0)))], names=["vec_id", "v", "parent", "away"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        def node(t: pa.Table) -> pa.RecordBatch:
            away = t["away"].to_numpy()
            return pa.RecordBatch.from_arrays([t["parent"].combine_chunks().slice(0, 1), pa.array([away.min()]), pa.array([away.max()]), pa.array([t["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([matrix(t["v"]).tobytes()], pa.binary())], names=["parent", "near", "far", "ids", "data"])
        for batch in batches:
            t = pa.Table.from_batches([batch])
            parent = t["parent"].to_numpy()
            edges = [0, *(np.flatnonzero(parent[1:] != parent[:-1]) + 1).tolist(), len(parent)]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    have = sum(map(len, held))
                    if held and (held[0]["parent"][0].as_py() != int(parent[a]) or have == PAGE):
                        yield node(pa.concat_tables(held))
                        held, have = [], 0
                    take = min(b - a, PAGE - have)
                    held.append(t.slice(a, take))
                    a += take
        if held:
            yield node(pa.concat_tables(held))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.mapInArrow(assign, "vec_id long, v array<double>, parent int, away double")
    leaves = (placed.repartitionByRange(n, "parent", "away", "vec_id").sortWithinPartitions("parent", "away", "vec_id")
              .mapInArrow(cut, "parent int, near double, far double, ids array<long>, data binary"))
    return cut_lineage(leaves.withColumn("page", F.monotonically_increasing_id()))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: falling score, then rising id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def visit(work: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score): the k best rows of each page for each query of its blocks that reach the query's floor.

    work: (page, ids, data, qs array<struct<qid, floor, q>>)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_q, out_v, out_s = [], [], []
            for i in range(batch.num_rows):
                ids = np.array(batch.column(1)[i].values.to_numpy(zero_copy_only=False))
                data = np.frombuffer(batch.column(2)[i].as_buffer(), np.float64).reshape(len(ids), -1)
                qs = batch.column(3)[i].values
                qid, floor = qs.field("qid").to_numpy(zero_copy_only=False), qs.field("floor").to_pylist()
                scores = products(matrix(qs.field("q")), data)
                for a in range(len(qid)):
                    at = best(scores[a], ids, k)
                    if floor[a] is not None:
                        at = at[scores[a][at] >= floor[a]]
                    out_q += [int(qid[a])] * len(at)
                    out_v += ids[at].tolist()
                    out_s += scores[a][at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.int64())], names=["qid", "vec_id", "score"])
    return work.mapInArrow(run, "qid long, vec_id long, score long")


class Upper:
    """Roots and routes: routing vectors with covering radii and parent distances. Bounded by ROUTES; lives on the driver and in tasks."""

    def __init__(self, routes: np.ndarray, radius: np.ndarray, norm: float):
        self.routes, self.radius, self.norm = routes, radius, norm
        lift = np.sqrt(np.maximum(norm - (routes * routes).sum(axis=1), 0))
        self.square = (routes * routes).sum(axis=1) + lift * lift
        self.roots = np.arange(min(ROOTS, len(routes)))
        full = np.concatenate([routes, lift[:, None]], axis=1)
        away = np.stack([np.sqrt(((full - full[r]) ** 2).sum(axis=1)) for r in self.roots], axis=1) if len(routes) else np.zeros((0, 0))
        self.parent = away.argmin(axis=1) if len(routes) else np.zeros(0, int)
        self.parent_distance = away.min(axis=1) if len(routes) else np.zeros(0)
        used = radius >= 0                              # a route without rows has no ball
        self.root_radius = np.array([(self.parent_distance + radius)[(self.parent == r) & used].max(initial=-np.inf) for r in self.roots])

    def distances(self, q: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.square[to][None, :] - 2 * (q @ self.routes[to].T), 0))

    def descend(self, q: np.ndarray, reach: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, route, distance) of the routes whose balls a query can reach; of queries with unlimited reach the `nearest` ones."""
        limit = reach * (1 + SLACK) + SLACK
        top = self.distances(q, self.roots)
        out = []
        for r in self.roots:
            children = np.flatnonzero((self.parent == r) & (self.radius >= 0))
            who = np.flatnonzero(top[:, r] - self.root_radius[r] <= limit)
            if not len(children) or not len(who):
                continue
            # stored parent distances first: no distance is computed to a route that they rule out for all of these queries
            maybe = np.abs(top[who, r][:, None] - self.parent_distance[children][None, :]) - self.radius[children][None, :] <= limit[who][:, None]
            children, maybe = children[maybe.any(axis=0)], maybe[:, maybe.any(axis=0)]
            d = self.distances(q[who], children)
            i, j = np.nonzero(maybe & (d - self.radius[children][None, :] <= limit[who][:, None]))
            out.append((who[i], children[j], d[i, j]))
        if not out:
            none = np.zeros(0, int)
            return none, none, np.zeros(0)
        query, route, dist = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((route, dist, query))
        query, route, dist = query[order], route[order], dist[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = np.isfinite(reach[query]) | (nth < nearest)
        return query[keep], route[keep], dist[keep]


def top_k(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies `is_query`, its k rows of greatest integer inner product, its own row
    excepted; ties go to the smaller id, fewer rows give fewer ranks.

    Queries with equal vectors are searched once, for k + 1 rows. A shorter vector counts as filled up with zeros to the longest one, which
    is the product over the components that both have. Rows with equal ids are each a candidate but for a query of that id. An empty
    table gives an empty one.
    """
    spark = df.sparkSession
    rows = cut_lineage(quantised(df, id_col, vec_col, scale))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    fill = F.array_repeat(F.lit(0).cast(dict(rows.dtypes)["v"][6:-1]), F.lit(dim) - F.size("v"))
    rows = rows.withColumn("v", F.when(F.size("v") < dim, F.concat("v", fill)).otherwise(F.col("v")))
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    routes = routes_of(rows, dim)
    tree = pages(rows, routes, norm)
    nodes = tree.select("page", "parent", "near", "far")
    radius = np.full(len(routes), -1.0)
    for r in nodes.groupBy("parent").agg(F.max("far").alias("far")).collect():      # at most ROUTES rows
        radius[r["parent"]] = r["far"]
    shared = spark.sparkContext.broadcast(Upper(routes, radius, norm))

    asked = rows.filter(is_query(F.col("vec_id"))).select("vec_id", "v", F.xxhash64("v").alias("h"))
    # equal query vectors are one query, named by its smallest id
    queries = cut_lineage(asked.groupBy("h", "v").agg(F.min("vec_id").alias("qid")).select("qid", "v", "h", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("qq")))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    first = F.row_number().over(W.partitionBy("qid").orderBy("gap", "page"))

    def descent(nearest: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, 4096):
                    part = batch.slice(s, 4096)
                    reach = part.column(2).fill_null(float("inf")).to_numpy()
                    query, route, dist = shared.value.descend(matrix(part.column(1)), reach, nearest)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(query)), pa.array(route.astype(np.int32)), pa.array(dist)], names=["qid", "parent", "dq"])
        return run

    def read(wanted: DataFrame) -> DataFrame:
        """The best rows of pages. wanted: (qid, page, floor)"""
        block = F.pmod(F.xxhash64("qid"), F.ceil(F.lit(0) + F.col("m") / BLOCK))
        sizes = wanted.groupBy("page").agg(F.count("*").alias("m"))
        ready = (wanted.join(sizes, "page").withColumn("block", block).join(queries.select("qid", F.col("v").alias("q")), "qid")
                 .groupBy("page", "block").agg(F.collect_list(F.struct("qid", "floor", "q")).alias("qs")))
        return visit(ready.join(tree.select("page", "ids", "data"), "page").select("page", "ids", "data", "qs"), k + 1)

    rounds = Rounds(spark, "mtree")
    seen = found = None
    many = 1
    while True:
        # a page can hold a score s >= floor only if its bound allows the distance sqrt(qq + norm - 2 s)
        floors = queries.select("qid", "v", "qq")
        floors = (floors.withColumn("floor", F.lit(None).cast("long")) if found is None else
                  floors.join(found.filter(F.col("r") == k + 1).select("qid", F.col("score").alias("floor")), "qid", "left"))
        floors = floors.withColumn("reach", F.when(F.col("floor").isNotNull(), F.sqrt(F.greatest(F.col("qq") + F.lit(norm) - 2 * F.col("floor"), F.lit(0.0)))))
        balls = floors.select("qid", "v", "reach").mapInArrow(descent(many), "qid long, parent int, dq double")
        gap = F.greatest(F.col("near") - F.col("dq"), F.col("dq") - F.col("far"), F.lit(0.0))
        open_ = balls.join(nodes, "parent").select("qid", "page", gap.alias("gap")).join(floors.select("qid", "floor", "reach"), "qid")
        open_ = open_.filter(F.col("reach").isNull() | (F.col("gap") <= F.col("reach") * (1 + SLACK) + SLACK))
        if seen is not None:
            open_ = open_.join(seen, ["qid", "page"], "left_anti")
        now = rounds.write("now", open_.withColumn("nth", first).filter(F.col("nth") <= many).select("qid", "page", "floor"))
        if now.limit(1).count() == 0 and many >= len(routes):
            break
        got = read(now)
        got = got if found is None else got.unionByName(found.select("qid", "vec_id", "score"))
        found = rounds.write("found", got.withColumn("r", place).filter(F.col("r") <= k + 1).select("qid", "vec_id", "score", "r"))
        seen = rounds.add("seen", now.select("qid", "page"))
        many *= WIDEN
    named = asked.select(F.col("vec_id").alias("query_id"), "h", "v").join(queries, ["h", "v"]).select("query_id", "qid")
    if found is None:
        found = named.select("qid", F.col("qid").alias("vec_id"), F.col("qid").alias("score")).filter("false")
    out = named.join(found.select("qid", "vec_id", "score"), "qid").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
