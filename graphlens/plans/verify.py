"""Checks of measures: a table of all of them for named pairs, their direction, and errors against known values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import MEASURES, NAMES, SIMILARITIES
from ..operators.scoring import score


def measure_table(pairs: DataFrame, nodes: int, names: dict[int, str], geometry: np.ndarray | None = None, measures: dict[str, Callable] = MEASURES) -> DataFrame:
    """measure, name, similarity and a column for each of the named ``pairs`` (pair_id, a, b: edge codes)."""
    scored = score(pairs.filter(F.col("pair_id").isin(*names)), measures, nodes, geometry)
    wide = scored.groupBy("measure").pivot("pair_id", list(names)).agg(F.first("value")).withColumnsRenamed({str(i): n for i, n in names.items()})
    shown = F.create_map(*[F.lit(x) for k in measures for x in (k, NAMES.get(k, k))])
    return wide.select("measure", shown[F.col("measure")].alias("name"), F.col("measure").isin(*SIMILARITIES).alias("similarity"), *names.values())


def nearer(table: DataFrame, near: str, far: str) -> DataFrame:
    """One row, ``holds``: whether every measure, similarities negated, puts the pair ``near`` before the pair ``far``."""
    sign = F.when(F.col("similarity"), -1).otherwise(1)
    return table.agg(F.every(F.coalesce(sign * F.col(near) < sign * F.col(far), F.lit(False))).alias("holds"))


def errors(values: DataFrame, known: DataFrame) -> DataFrame:
    """measure, max_relative, compared, same_nulls, one_sided of ``values`` against ``known`` (measure, net_id, value); one_sided
    counts the rows that only one of them has.
    """
    own, other = values.select("measure", "net_id", "value", F.lit(1).alias("own")), known.select("measure", "net_id", F.col("value").alias("known"), F.lit(1).alias("other"))
    both = own.join(other, ["measure", "net_id"], "full")
    error = F.abs(F.col("value") - F.col("known")) / F.greatest(F.abs("known"), F.lit(1e-12))
    alone = F.col("own").isNull() | F.col("other").isNull()
    same = F.every((F.col("value").isNull() == F.col("known").isNull()) & ~alone)
    return both.groupBy("measure").agg(F.max(error).alias("max_relative"), F.count(error).alias("compared"), same.alias("same_nulls"), F.count_if(alone).alias("one_sided"))
