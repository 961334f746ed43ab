"""The consensus of a set of networks at a fixed number of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(edges: DataFrame, key: list[str], size: int) -> DataFrame:
    """key, u, v, members: of each set of networks (edges with the set's key) the ``size`` edges that most members
    have, ties by u, v.
    """
    seen = edges.groupBy(*key, "u", "v").agg(F.count_distinct("net_id").alias("members"))
    order = Window.partitionBy(*key).orderBy(F.desc("members"), "u", "v")
    return seen.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= size).drop("at")
