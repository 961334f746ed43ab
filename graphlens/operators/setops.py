"""Edge-set and information measures as DataFrame plans: counts by one join with the broadcast reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _h(*parts: Column) -> Column:
    """Entropy of a distribution that sums to 1; parts that are 0, or below by rounding, give nothing."""
    total = F.lit(0.0)
    for p in parts:
        total = total - F.when(p > 1e-15, p * F.ln(p)).otherwise(0.0)
    return total


def _information(p1: Column, p2: Column, p12: Column) -> tuple[Column, Column, Column]:
    h1, h2 = _h(p1, 1 - p1), _h(p2, 1 - p2)
    return h1, h2, h1 + h2 - _h(p12, p1 - p12, p2 - p12, 1 - p1 - p2 + p12)


def pair_counts(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """net_id, a, r, both: edges of the network, of the reference (one bounded network, broadcast), of both."""
    ref = F.broadcast(reference.withColumn("in_ref", F.lit(1)))
    r = reference.agg(F.count("*").alias("r"))
    return edges.join(ref, ["u", "v"], "left").groupBy("net_id").agg(F.count("*").alias("a"), F.count("in_ref").alias("both")).join(F.broadcast(r))


def set_measures(edges: DataFrame, reference: DataFrame, nodes: int) -> DataFrame:
    """net_id and the measures that four counts decide."""
    pairs = nodes * (nodes - 1) / 2
    c = pair_counts(edges, reference)
    apart = F.col("a") + F.col("r") - 2 * F.col("both")
    p1, p2, p12 = (F.col(x) / F.lit(pairs) for x in ("a", "r", "both"))
    h1, h2, mi = _information(p1, p2, p12)
    return c.select(
        "net_id",
        F.sqrt(2.0 * apart).alias("frobenius"),
        apart.alias("hamming"),
        (2.0 * F.col("both") / (2.0 * (F.col("a") + F.col("r") - F.col("both")) + 1e-10)).alias("jaccard"),
        F.coalesce(F.try_divide(2.0 * F.col("both"), (F.col("a") + F.col("r")).cast("double")), F.lit(0.0)).alias("f1"),
        ((2 * mi + 1e-100) / (h1 + h2 + 1e-100)).alias("network_mutual_information"),
    )


#: What counts as an edge where weights are not 0 and 1, measure by measure.
PREDICATES = {
    "hamming": lambda w: w > 0,
    "portrait": lambda w: w > 0,
    "jaccard": lambda w: w > 0.5,
    "f1": lambda w: w.cast("long") == 1,
    "network_mutual_information": lambda w: w != 0,
    "dc_network_mutual_information": lambda w: w != 0,
}


def edges_for(measure: str, edges: DataFrame) -> DataFrame:
    """The edges, with weights ``w``, that a measure takes for edges; the filter comes before any join."""
    return edges.filter(PREDICATES[measure](F.col("w"))).drop("w")


def weighted_frobenius(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """net_id, frobenius of weighted networks: the sums of squares of both, less twice the products where both have a weight."""
    ref = F.broadcast(reference.select("u", "v", F.col("w").alias("wr")))
    rr = reference.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0
    sums = edges.join(ref, ["u", "v"], "left").groupBy("net_id").agg(F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("w") * F.col("wr")).alias("wr"))
    return sums.select("net_id", F.sqrt(F.greatest(F.lit(0.0), 2.0 * (F.col("ww") + F.lit(rr) - 2 * F.coalesce("wr", F.lit(0.0))))).alias("frobenius"))


def weighted_measure(measure: str, edges: DataFrame, reference: DataFrame, nodes: int) -> DataFrame:
    """net_id and a set or information measure of weighted networks (net_id, u, v, w) and one weighted reference (u, v, w), for
    every network of ``edges``, without edges too.
    """
    if measure == "frobenius":
        return weighted_frobenius(edges, reference)
    own, ref = edges_for(measure, edges), edges_for(measure, reference)
    nets = edges.select("net_id").distinct()
    if measure == "dc_network_mutual_information":
        found, without = degree_corrected(own, ref, nodes), None
    else:
        found = set_measures(own, ref, nodes).select("net_id", measure)
        # a network that keeps no edge: as many differ as the reference has
        r = ref.count()
        without = {"hamming": float(r), "jaccard": 0.0, "f1": 0.0}.get(measure)
    return nets.join(found, "net_id", "left").select("net_id", F.coalesce(F.col(measure).cast("double"), F.lit(without).cast("double")).alias(measure))


def both_ways(edges: DataFrame) -> DataFrame:
    key = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(*key, F.col("u").alias("i"), F.col("v").alias("j")).unionByName(edges.select(*key, F.col("v").alias("i"), F.col("u").alias("j")))


def bit_rows(edges: DataFrame) -> DataFrame:
    """net_id, i, word, bits: the neighbours of a node as words of 32 bits, node 32 * word + k at bit k."""
    n = both_ways(edges.select("net_id", "u", "v")).withColumn("word", F.floor(F.col("j") / 32).cast("int"))
    return n.groupBy("net_id", "i", "word").agg(F.bit_or(F.expr("shiftleft(1L, j % 32)")).alias("bits"))


def edges_of_bits(rows: DataFrame) -> DataFrame:
    """net_id, u, v of ``bit_rows``."""
    set_bits = F.expr("filter(sequence(0, 31), k -> shiftright(bits, k) & 1L = 1L)")
    return rows.select("net_id", F.col("i").alias("u"), "word", F.explode(set_bits).alias("k")).select("net_id", "u", (32 * F.col("word") + F.col("k")).cast("int").alias("v")).filter("u < v")


def degrees(edges: DataFrame) -> DataFrame:
    """net_id, i, degree of nodes with an edge."""
    return both_ways(edges.select("net_id", "u", "v")).groupBy("net_id", "i").agg(F.count("*").alias("degree"))


def degree_corrected(edges: DataFrame, reference: DataFrame, nodes: int) -> DataFrame:
    """net_id, dc_network_mutual_information: the information summed over nodes."""
    ref = both_ways(reference)
    mine = both_ways(edges.select("net_id", "u", "v")).join(F.broadcast(ref.withColumn("in_ref", F.lit(1))), ["i", "j"], "left")
    mine = mine.groupBy("net_id", "i").agg(F.count("*").alias("a"), F.count("in_ref").alias("both"))
    every = edges.select("net_id").distinct().select("net_id", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("i"))
    full = every.join(mine, ["net_id", "i"], "left").join(F.broadcast(ref.groupBy("i").agg(F.count("*").alias("r"))), "i", "left")
    p1, p2, p12 = (F.coalesce(x, F.lit(0)) / F.lit(float(nodes)) for x in ("a", "r", "both"))
    h1, h2, mi = _information(p1, p2, p12)
    return full.groupBy("net_id").agg(((2 * F.sum(mi) + 1e-100) / (F.sum(h1) + F.sum(h2) + 1e-100)).alias("dc_network_mutual_information"))


def triangles(edges: DataFrame) -> DataFrame:
    """net_id, i, triangles: an edge joined with its ends' common neighbours, each triangle found once."""
    e = edges.select("net_id", "u", "v")
    a, b, c = e.alias("a"), e.alias("b"), e.alias("c")
    found = a.join(b, (F.col("a.net_id") == F.col("b.net_id")) & (F.col("a.v") == F.col("b.u"))).join(c, (F.col("a.net_id") == F.col("c.net_id")) & (F.col("a.u") == F.col("c.u")) & (F.col("b.v") == F.col("c.v")))
    return found.select(F.col("a.net_id"), F.explode(F.array("a.u", "a.v", "b.v")).alias("i")).groupBy("net_id", "i").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """net_id, i, degree, triangles, clustering; 0 for nodes with fewer than two neighbours."""
    t = degrees(edges).join(triangles(edges), ["net_id", "i"], "left").fillna(0, ["triangles"])
    return t.withColumn("clustering", F.coalesce(F.try_divide(2.0 * F.col("triangles"), (F.col("degree") * (F.col("degree") - 1)).cast("double")), F.lit(0.0)))


def ego_features(edges: DataFrame) -> DataFrame:
    """net_id, i and seven features of each node."""
    c = clustering(edges)
    n = both_ways(edges.select("net_id", "u", "v"))
    around = n.join(c.select("net_id", F.col("i").alias("j"), F.col("degree").alias("dj"), F.col("clustering").alias("cj")), ["net_id", "j"])
    sums = around.groupBy("net_id", "i").agg(F.avg("dj").alias("mean_degree"), F.avg("cj").alias("mean_clustering"), F.sum("dj").alias("sum_degree"))
    second = n.alias("x").join(n.alias("y"), (F.col("x.net_id") == F.col("y.net_id")) & (F.col("x.j") == F.col("y.i"))).select(F.col("x.net_id"), F.col("x.i"), F.col("y.j")).filter("i <> j").distinct()
    two = second.join(n, ["net_id", "i", "j"], "left_anti").groupBy("net_id", "i").agg(F.count("*").alias("two_away"))
    inside = F.col("degree") + F.col("triangles")
    return c.join(sums, ["net_id", "i"]).join(two, ["net_id", "i"], "left").select(
        "net_id", "i", "degree", "clustering", "mean_degree", "mean_clustering", inside.alias("ego_edges"), (F.col("degree") + F.col("sum_degree") - 2 * inside).alias("ego_leaving"), F.coalesce("two_away", F.lit(0)).alias("two_away")
    )
