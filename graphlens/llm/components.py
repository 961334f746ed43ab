"""Connected components of an edge table by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _renamed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: the edges between the labels of their ends, each once; ends without a label keep their names."""
    for end in ("a", "b"):
        edges = edges.join(labels.select(F.col("v").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    a, b = F.coalesce("a_label", "a"), F.coalesce("b_label", "b")
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()


def _followed(labels: DataFrame, after: DataFrame) -> DataFrame:
    """v, label: each label replaced by its own label in ``after``, where it has one."""
    return labels.join(after.select(F.col("v").alias("label"), F.col("label").alias("next")), "label", "left").select("v", F.coalesce("next", "label").alias("label"))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``edges``: a, b. Returns v, label for every vertex of an edge; the label is the smallest vertex reachable. With the
    labels ``known`` of earlier edges, those of all vertices of both, from the new edges between components alone.

    Each round a vertex points to the least of itself and its neighbours, in an order that a hash deals anew, then to what that one
    points to; vertices that point to one and the same become one and edges inside it go, so what is left falls by a share
    each round and chains are no worse than stars. Minima are combined before the shuffle; in the joins a hub is one row on one
    side, and adaptive execution splits the other side. Rounds are written to the shared folder, which cuts the lineage.
    """
    rest = materialize(edges.select("a", "b") if known is None else _renamed(edges, known), "components-edges")
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("at"), F.col(c).alias("v"))
        both = rest.select("a", order("b").alias("near")).unionByName(rest.select(F.col("b").alias("a"), order("a").alias("near")))
        to = both.groupBy("a").agg(F.min("near").alias("near")).select(F.col("a").alias("v"), F.least("near", order("a")).getField("v").alias("label"))
        to = materialize(to, "components-steps")
        steps.append(materialize(_followed(to, to), "components-steps"))
        rest = materialize(_renamed(rest, steps[-1]), "components-edges")
    if not steps:
        return rest.select(F.col("a").alias("v"), F.col("b").alias("label")) if known is None else known
    labels = steps.pop()
    while steps:
        labels = materialize(_followed(steps.pop(), labels), "components-labels")
    least = labels.groupBy("label").agg(F.min("v").alias("least"))
    labels = labels.join(least, "label").select("v", F.least("least", "label").alias("label"))
    if known is None:
        return materialize(labels, "components-labels")
    labels = materialize(labels, "components-labels")
    return materialize(_followed(known, labels).unionByName(labels.join(known, "v", "left_anti")), "components-labels")
