"""Functions of adjacency matrices as tables of entries: products are joins, sums are aggregations.

A matrix is (net_id, i, j, x) with the entries that are not zero, for a whole population at once; products are keyed by
network and inner index, so they spread over tasks however large a network is. How many terms a series takes comes from a
bound of what is left out, not from trying.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .setops import both_ways

ENTRY = ["net_id", "i", "j"]


def product(a: DataFrame, b: DataFrame, by=1.0) -> DataFrame:
    """The entries of a times b, each multiplied by ``by``."""
    right = b.select("net_id", F.col("i").alias("k"), F.col("j").alias("to"), F.col("x").alias("y"))
    met = a.withColumnRenamed("j", "k").join(right, ["net_id", "k"])
    return met.groupBy("net_id", "i", F.col("to").alias("j")).agg((F.sum(F.col("x") * F.col("y")) * by).alias("x"))


def total(*matrices: DataFrame) -> DataFrame:
    """The sum of matrices."""
    every = matrices[0].select(*ENTRY, "x")
    for m in matrices[1:]:
        every = every.unionByName(m.select(*ENTRY, "x"))
    return every.groupBy(*ENTRY).agg(F.sum("x").alias("x"))


def adjacency(edges: DataFrame, scale: float = 1.0) -> DataFrame:
    return both_ways(edges.select("net_id", "u", "v")).withColumn("x", F.lit(scale))


def identity(nodes: DataFrame) -> DataFrame:
    return nodes.select("net_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("x"))


def largest_degree(edges: DataFrame) -> int:
    return both_ways(edges.select("net_id", "u", "v")).groupBy("net_id", "i").count().agg(F.max("count")).first()[0] or 0


def exponential_terms(norm: float, tolerance: float) -> int:
    """How many terms of the series of exp leave out at most ``tolerance``, for a matrix of that norm."""
    n, term = 0, 1.0
    while n + 2 <= norm or term * norm / (n + 1) / (1 - norm / (n + 2)) > tolerance:
        n += 1
        term *= norm / n
    return n


def exponential(edges: DataFrame, nodes: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """The entries of the exponential of each adjacency matrix; ``tolerance`` bounds the error against the largest entry.

    The matrix is halved until its norm, at most the largest degree, is below 1; terms are products with the sparse
    matrix; the sum is squared as often as the matrix was halved.
    """
    most = max(1, largest_degree(edges))
    halvings = max(0, math.ceil(math.log2(most)))
    norm = most / 2**halvings
    # squaring carries an error on, times twice the norm of what is squared each time: in all, times 2 ** halvings relative to it
    terms = exponential_terms(norm, tolerance / 2**halvings)
    a = written(adjacency(edges, 2.0**-halvings), "series-edges")
    term = written(identity(nodes), "series-term")
    parts = [term]
    for n in range(1, terms + 1):
        term = written(product(term, a, 1.0 / n), "series-term")
        parts.append(term)
    found = written(total(*parts), "series-sum")
    for _ in range(halvings):
        found = written(product(found, found), "series-square")
    return found


def affinity(edges: DataFrame, nodes: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """The entries of (I + e^2 D - e A)^-1, D the degrees and e = 1 / (1 + the network's largest degree).

    With M = I + e^2 D the inverse is the sum of the powers of B = e M^-1 A, times M^-1. The sum is doubled in each
    round: S_2n = S_n + B^n S_n. The norm of B, at most e d / (1 + e^2 d) for the largest degree d, says after how
    many rounds less than ``tolerance`` is left.
    """
    degree = both_ways(edges.select("net_id", "u", "v")).groupBy("net_id", "i").agg(F.count("*").cast("double").alias("d"))
    degree = nodes.join(degree, ["net_id", "i"], "left").na.fill(0.0)
    e = degree.groupBy("net_id").agg((1 / (1 + F.max("d"))).alias("e"))
    m = written(degree.join(e, "net_id").select("net_id", "i", "e", (1 / (1 + F.col("e") * F.col("e") * F.col("d"))).alias("m")), "affinity-degrees")
    b = both_ways(edges.select("net_id", "u", "v")).join(m, ["net_id", "i"]).select(*ENTRY, (F.col("e") * F.col("m")).alias("x"))
    d = max(1, largest_degree(edges))
    norm = (d / (1 + d)) / (1 + d / (1 + d) ** 2)
    rounds = max(1, math.ceil(math.log2(max(2.0, math.log(tolerance * (1 - norm)) / math.log(norm)))))
    power = written(b, "affinity-power")
    sums = written(total(identity(nodes), power), "affinity-sum")  # I + B
    for _ in range(1, rounds):
        power = written(product(power, power), "affinity-power")
        sums = written(total(sums, product(power, sums)), "affinity-sum")
    return sums.join(m.select("net_id", F.col("i").alias("j"), "m"), ["net_id", "j"]).select(*ENTRY, (F.col("x") * F.col("m")).alias("x"))


def delta_con(edges: DataFrame, reference: DataFrame, nodes: DataFrame, reference_nodes: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """net_id, value: the distance of the square roots of affinities, of each network to the one reference (u, v)."""
    of_all = written(affinity(edges, nodes, tolerance).withColumn("x", F.sqrt(F.greatest("x", F.lit(0.0)))), "affinity-roots")
    one = affinity(reference.withColumn("net_id", F.lit(0).cast("long")), reference_nodes.withColumn("net_id", F.lit(0).cast("long")), tolerance)
    one = written(one.select("i", "j", F.sqrt(F.greatest("x", F.lit(0.0))).alias("y")), "affinity-reference")
    y2 = one.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0
    # entries that only one side has: sums of squares, less what both have
    met = of_all.join(one, ["i", "j"], "left").groupBy("net_id").agg(F.sum((F.col("x") - F.coalesce("y", F.lit(0.0))) ** 2).alias("d"), F.sum(F.col("y") * F.col("y")).alias("seen"))
    return met.select("net_id", F.sqrt(F.col("d") + F.greatest(F.lit(0.0), F.lit(y2) - F.coalesce("seen", F.lit(0.0)))).alias("value"))


def communicability_correlation(edges: DataFrame, reference: DataFrame, nodes: DataFrame, reference_nodes: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """net_id, value: Pearson's r of all entries of the exponentials, of each network with the one reference (u, v), over the n x n
    entries of its nodes; null where a side does not vary.
    """
    zero = F.lit(0).cast("long")
    x = written(exponential(edges, nodes, tolerance), "exponential")
    y = exponential(reference.withColumn("net_id", zero), reference_nodes.withColumn("net_id", zero), tolerance).select("i", "j", F.col("x").alias("y"))
    y = written(y, "exponential-reference")
    sy, syy = (F.lit(v or 0.0) for v in y.agg(F.sum("y"), F.sum(F.col("y") * F.col("y"))).first())
    n = nodes.groupBy("net_id").agg((F.count("*").cast("double") ** 2).alias("n"))
    sums = x.join(y, ["i", "j"], "left").groupBy("net_id").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    top = F.coalesce("sxy", F.lit(0.0)) - F.col("sx") * sy / F.col("n")
    low = (F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (syy - sy**2 / F.col("n"))
    return sums.join(n, "net_id").select("net_id", F.when(low > 0, top / F.sqrt(low)).alias("value"))
