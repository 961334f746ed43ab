"""Graph algorithms as rounds of joins over edge tables, for populations of networks and for networks of any size.

A state is a table keyed by network and node (or pair of nodes); each round is one join with the edges and one
aggregation, written to the shared folder, so plans stay flat and a lost executor costs its own tasks. No matrix, frontier
or component is ever in one task. Edges are (net_id, u, v), each once, without loops; nodes are those with an edge unless
``nodes`` (net_id, i) names more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .setops import both_ways

PAIR = ["net_id", "s", "t"]


def nodes_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """net_id, i of all nodes."""
    found = both_ways(edges.select("net_id", "u", "v")).select("net_id", "i")
    return (found if nodes is None else found.unionByName(nodes.select("net_id", "i"))).distinct()


def search(edges: DataFrame, sources: DataFrame | None = None, nodes: DataFrame | None = None) -> list[DataFrame]:
    """Breadth-first search from all nodes, or from ``sources`` (net_id, i): a written table for each distance, with net_id, s, t and
    sigma, the number of shortest paths (a double; exact to 2 ** 53).

    What is reached from distance d lies at d - 1, d or d + 1, as edges go both ways, so the anti-join that keeps new
    nodes reads two tables, not all that was seen.
    """
    step = written(both_ways(edges.select("net_id", "u", "v")), "search-edges").select("net_id", F.col("i").alias("t"), "j")
    start = nodes_of(edges, nodes) if sources is None else sources.select("net_id", "i").distinct()
    found = [written(start.select("net_id", F.col("i").alias("s"), F.col("i").alias("t"), F.lit(1.0).alias("sigma")), "search-0")]
    while True:
        next_to = found[-1].join(step, ["net_id", "t"]).groupBy("net_id", "s", F.col("j").alias("t")).agg(F.sum("sigma").alias("sigma"))
        known = reduce(DataFrame.unionByName, [x.select(*PAIR) for x in found[-2:]])
        new = written(next_to.join(known, PAIR, "left_anti"), f"search-{len(found)}")
        if new.isEmpty():
            return found
        found.append(new)


def distances(levels: list[DataFrame]) -> DataFrame:
    """net_id, s, t, d, sigma of a search."""
    return reduce(DataFrame.unionByName, [x.select(*PAIR, F.lit(d).alias("d"), "sigma") for d, x in enumerate(levels)])


def portrait(levels: list[DataFrame]) -> DataFrame:
    """net_id, l, k, nodes: how many nodes have exactly k nodes at distance l."""
    shells = distances(levels).groupBy("net_id", "s", F.col("d").alias("l")).agg(F.count("*").alias("k"))
    return shells.groupBy("net_id", "l", "k").agg(F.count("*").alias("nodes"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """net_id, i, betweenness: the shares of shortest paths between other nodes that pass a node, summed over ordered pairs from
    all nodes (or ``sources``) and divided by (n - 1)(n - 2); 0 where n < 3.

    Shares are accumulated backwards over the levels of the search: a node passes on to those one step nearer to the
    source, in the proportion of their path numbers.
    """
    levels = search(edges, sources, nodes)
    step = written(both_ways(edges.select("net_id", "u", "v")), "between-edges")
    passed = levels[-1].select(*PAIR, "sigma", F.lit(0.0).alias("delta"))
    kept = [passed]
    for level in levels[-2::-1]:
        share = passed.select("net_id", "s", F.col("t").alias("i"), ((F.lit(1.0) + F.col("delta")) / F.col("sigma")).alias("share"))
        given = share.join(step, ["net_id", "i"]).select("net_id", "s", F.col("j").alias("t"), "share").join(level, PAIR)
        sums = given.groupBy(*PAIR).agg((F.sum("share") * F.first("sigma")).alias("delta"))
        passed = written(level.join(sums, PAIR, "left").select(*PAIR, "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")), "between-level")
        kept.append(passed)
    of_node = reduce(DataFrame.unionByName, kept).filter("s <> t").groupBy("net_id", F.col("t").alias("i")).agg(F.sum("delta").alias("total"))
    every = nodes_of(edges, nodes)
    n = every.groupBy("net_id").agg(F.count("*").cast("double").alias("n"))
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return every.join(of_node, ["net_id", "i"], "left").join(n, "net_id").select("net_id", "i", F.coalesce(F.try_divide(F.coalesce("total", F.lit(0.0)), pairs), F.lit(0.0)).alias("betweenness"))


def core(edges: DataFrame, k: int = 2) -> DataFrame:
    """The edges that are left when nodes of fewer than ``k`` neighbours are removed until there are none."""
    left = written(edges.select("net_id", "u", "v"), "core-0")
    while True:
        low = both_ways(left).groupBy("net_id", "i").agg(F.count("*").alias("degree")).filter(F.col("degree") < k).select("net_id", "i")
        low = written(low, "core-low")
        if low.isEmpty():
            return left
        after = left.join(low.withColumnRenamed("i", "u"), ["net_id", "u"], "left_anti").join(low.withColumnRenamed("i", "v"), ["net_id", "v"], "left_anti")
        left = written(after.select("net_id", "u", "v"), "core-left")


def core_sizes(edges: DataFrame, k: int = 2) -> DataFrame:
    """net_id, core_nodes, core_edges of every network of ``edges``; 0 where the core is empty."""
    left = core(edges, k)
    n = nodes_of(left).groupBy("net_id").agg(F.count("*").alias("core_nodes"))
    m = left.groupBy("net_id").agg(F.count("*").alias("core_edges"))
    return edges.select("net_id").distinct().join(n, "net_id", "left").join(m, "net_id", "left").na.fill(0)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """net_id, i, component for every node of every network at once; the component is its smallest node.

    Each round a node takes the smallest label next to it, and then the label of that label, so a chain of n nodes needs about
    log n rounds. Labels only fall; the rounds end when none does.
    """
    step = written(both_ways(edges.select("net_id", "u", "v")), "component-edges")
    labels = written(nodes_of(edges, nodes).withColumn("label", F.col("i")), "component-labels")
    while True:
        near = step.join(labels.withColumnRenamed("i", "j"), ["net_id", "j"]).groupBy("net_id", "i").agg(F.min("label").alias("near"))
        taken = labels.join(near, ["net_id", "i"], "left").select("net_id", "i", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select("net_id", F.col("i").alias("to"), F.col("label").alias("far"))
        after = written(taken.join(jump, ["net_id", "to"]).select("net_id", "i", "old", F.least("to", "far").alias("label")), "component-labels")
        labels = after.select("net_id", "i", "label")
        if after.filter("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """net_id, parts, connected of every network."""
    parts = components(edges, nodes).groupBy("net_id").agg(F.count_distinct("component").alias("parts"))
    return parts.withColumn("connected", F.col("parts") == 1)
