"""Cell graphs: degrees, components and removal of duplicated cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from engram.functions.exprs import ratio
from engram.operators.pairs import pearson_above
from engram.session import Rounds


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return (edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
                 .groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree")))


def degree_dist(edges: DataFrame, width: int = 2, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return (degrees(edges, keys).groupBy(*keys, (F.floor(F.col("degree") / width) * width).alias("degree_from"))
            .agg(F.count(F.lit(1)).alias("nodes")))


def degree_median(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nodes, median_degree, mean_degree) over the nodes that have an edge."""
    return (degrees(edges, keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("nodes"), F.percentile("degree", F.lit(0.5)).alias("median_degree"), F.avg("degree").alias("mean_degree")))


def isolates_ratio(corr: DataFrame, n_cells: DataFrame, thresholds: list[float], keys: list[str] | None = None) -> DataFrame:
    """Share of cells without a partner at each of a few thresholds; ``corr`` needs the pairs from the lowest one on, n_cells is per key."""
    keys = keys or []
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    ends = corr.select(*keys, F.explode(F.array("a", "b")).alias("node"), "r").groupBy(*keys, "node").agg(F.max("r").alias("_r"))
    # A cell is connected at t as soon as its best partner reaches t.
    linked = (ends.withColumn("threshold", grid).groupBy(*keys, "threshold")
                  .agg(F.count(F.when(F.col("_r") >= F.col("threshold"), 1)).alias("_linked")))
    every = n_cells.withColumn("threshold", grid).join(linked, [*keys, "threshold"], "left")
    return every.select(*keys, "threshold", (1 - ratio(F.coalesce("_linked", F.lit(0)), "n_cells")).alias("isolates"))


def graph_density(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    # every edge has two ends, so one aggregation over degrees gives nodes and edges
    per = degrees(edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), F.expr("cast(sum(degree) div 2 as bigint)").alias("edges"))
    return per.withColumn("density", ratio(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node id as label.

    Each round takes the smallest label around a node and then the label of that label, so long
    chains shrink by more than half a round.  Every round is written below the checkpoint folder.
    Labels only fall, so the loop ends.
    """
    rounds = Rounds(edges.sparkSession, "components")
    arcs = rounds.write("arcs", both_ways(edges).distinct())
    labels = rounds.write("labels", arcs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_m"))
                          .select("node", F.col("node").alias("_old"), F.least("node", "_m").alias("component")))
    while True:
        around = (arcs.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("_c")), "dst")
                      .groupBy(F.col("src").alias("node")).agg(F.min("_c").alias("_m")))
        near = labels.join(around, "node").select("node", F.col("component").alias("_old"), F.least("component", "_m").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_far"))
        labels = rounds.write("labels", near.join(jump, "_new", "left").select("node", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("component")))
        if labels.filter("component <> _old").limit(1).count() == 0:
            rounds.drop("arcs")
            return labels.select("node", "component")


def dedup_hub(edges: DataFrame) -> DataFrame:
    """Nodes removed when the node of highest degree (tie: largest id) goes first until no edge is left.

    A node that outranks all its neighbours goes before any of them whatever happens elsewhere, so
    all such nodes go in the same round; the outcome is that of one removal at a time.  The node that
    outranks all others goes in every round, so the loop ends.
    """
    rounds = Rounds(edges.sparkSession, "hubs")
    arcs = rounds.write("arcs", both_ways(edges.filter("src <> dst")).distinct())
    removed = None
    while arcs.limit(1).count():
        deg = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
        rank = deg.select(F.col("src").alias("dst"), F.struct("_d", F.col("src").alias("_i")).alias("_rank"))
        best = arcs.join(rank, "dst").groupBy("src").agg(F.max("_rank").alias("_best"))
        go = rounds.write("go", best.join(deg, "src").filter(F.struct("_d", F.col("src").alias("_i")) > F.col("_best"))
                          .select(F.col("src").alias("node"), F.col("_d").alias("degree")))
        removed = rounds.add("removed", go)
        arcs = rounds.write("arcs", arcs.join(go.select(F.col("node").alias("src")), "src", "left_anti")
                            .join(go.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if removed is None:
        return edges.select(F.col("src").alias("node"), F.lit(0).cast("bigint").alias("degree")).filter("false")
    return removed


def _dedup_ranked(comps: DataFrame, corr: DataFrame, rank, keys: list[str]) -> DataFrame:
    """Remove cells of a component in a fixed order until no pair of ``corr`` is left.

    A pair is gone once its first cell in the order is; so everything up to the latest such first
    cell is removed, which one aggregate finds.
    """
    ranked = comps.withColumn("_rank", rank)
    side = lambda s: ranked.select("component", F.col("node").alias(s), F.col("_rank").alias(f"_r{s}"))
    bad = corr.select(*keys, "component", "a", "b").join(side("a"), ["component", "a"]).join(side("b"), ["component", "b"])
    limit = bad.groupBy(*keys, "component").agg(F.max(F.least("_ra", "_rb")).alias("_limit"))
    return ranked.join(limit, "component").filter(F.col("_rank") <= F.col("_limit")).select(*keys, "node", "component")


def within_components(comps: DataFrame, activity: DataFrame, keys: list[str], item: str, coord: str, value: str, n, r_max: float) -> DataFrame:
    """(keys, component, a, b) of the cells of one component that correlate above ``r_max``; cells of different components never meet."""
    own = activity.join(comps.select(F.col("node").alias(item), "component"), item)
    return pearson_above(own, [*keys, "component"], item, coord, value, n, r_max).filter(F.col("r") > r_max).select(*keys, "component", "a", "b")


def dedup_snr(comps: DataFrame, corr: DataFrame, snr: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lowest signal to noise goes first (tie: smallest id). ``corr`` comes from ``within_components``."""
    return _dedup_ranked(comps.join(snr, "node"), corr, F.struct("snr", "node"), keys or [])


def dedup_hub_snr(comps: DataFrame, corr: DataFrame, snr: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Highest degree goes first, then lowest signal to noise."""
    d = comps.join(snr, "node").join(degrees(edges), "node")
    return _dedup_ranked(d, corr, F.struct((-F.col("degree")).alias("d"), "snr", "node"), keys or [])


def state_graph(transitions: DataFrame, src: str, dst: str, n: str, least: int = 1) -> DataFrame:
    """Edges of the transition matrix without self loops; states without an edge do not occur."""
    return (transitions.filter((F.col(n) >= least) & (F.col(src) != F.col(dst)))
            .select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(n).alias("w")))


def subsample_nodes(nodes: DataFrame, node: str, n: int, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """n nodes of each key in a fixed pseudo-random order."""
    order = (F.pmod(F.col(node) * 7919 + F.lit(seed * 104729), F.lit(1000003)), F.col(node))
    if not keys:
        return nodes.orderBy(*order).limit(n)
    return nodes.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_at") <= n).drop("_at")
