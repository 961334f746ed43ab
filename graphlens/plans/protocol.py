"""The benchmark of a user's measure beside the registered ones, and its report."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CRITERIA, READOUTS, Protocol
from ..functions.measures import MEASURES, NAMES, SELECTED, SIMILARITIES
from ..operators.scoring import against, score
from ..sources.tables import written
from . import experiments as x
from . import readouts as r
from .experiments import Recovery


@dataclass
class Report:
    """What a run found.

    ``table`` has a row for each read-out: key, criterion, readout (its label), direction, a column for the new measure
    and each one beside it by display name, and the new measure's rank among them (1 = best). ``values`` is the same,
    long: key, measure, value, rank. ``landscape`` has the measures that were run; ``extras`` the other frames.
    """

    name: str
    table: DataFrame
    values: DataFrame
    landscape: DataFrame | None
    extras: dict = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"Report for {self.name}\n" + self.table.toPandas().to_string()


def landscape(edges: DataFrame, meta: DataFrame, reference: DataFrame, measures: dict[str, Callable], nodes: int, geometry: np.ndarray | None = None) -> DataFrame:
    """measure, net_id, eta, gamma, value, ms of every network against the reference."""
    scored = score(against(edges, reference), measures, nodes, geometry).withColumnRenamed("pair_id", "net_id")
    return scored.join(meta.select("net_id", "eta", "gamma"), "net_id")


def readout_values(
    land: DataFrame | None,
    edges: DataFrame,
    geometry: DataFrame,
    criteria: set[str],
    protocol: Protocol,
    trajectories: DataFrame | None = None,
    draws: DataFrame | None = None,
    effective: DataFrame | None = None,
    recoveries: dict[str, DataFrame] | None = None,
    aucs: DataFrame | None = None,
    others: DataFrame | None = None,
) -> DataFrame:
    """measure, readout, value of the read-outs that the given tables allow; a table that is missing leaves its own out.
    Agreement is with the landscapes in ``others``, by default with each other.
    """
    many, few = protocol.best_cells
    parts: list[DataFrame] = []

    def add(df: DataFrame, **names: str) -> None:
        for column, readout in names.items():
            parts.append(df.select("measure", F.lit(readout).alias("readout"), F.col(column).cast("double").alias("value")))

    if land is not None and "agreement" in criteria:
        add(r.agreement(land, others=others), agreement="agreement", max_abs_r="max_abs_r")
    if land is not None and "plausibility" in criteria:
        add(r.best_cell(land), best_eta="best_eta", best_gamma="best_gamma")
        add(r.eta_positive(land, many), eta_positive="eta_positive_of_100")
        add(r.eta_positive(land, few), eta_positive="eta_positive_of_20")
        add(r.total_variation(land, few, protocol.eta_range, protocol.gamma_range), total_variation="total_variation")
        add(r.connection_length(land, edges, geometry, few, protocol.long_mm), connection_length_mm="connection_length_mm", percent_beyond="percent_beyond_90mm")
        add(r.degree_sd(land, edges, few, protocol.nodes), degree_sd="degree_sd")
    if land is not None and "efficiency" in criteria:
        add(land.groupBy("measure").agg(F.avg("ms").alias("ms")), ms="runtime_ms")
    if "sensitivity" in criteria:
        if land is not None:
            add(r.isnr(land), isnr_db="isnr_db")
        if trajectories is not None:
            add(r.degeneration(trajectories), mae="mae", cv="cv")
        if draws is not None and effective is not None:
            add(r.noise_tolerance(draws, effective, protocol.noise_cutoff), noise_tolerance="noise_tolerance")
    if "accuracy" in criteria:
        for key, distances in (recoveries or {}).items():
            add(r.recovery(distances), error=f"recovery_{key}", r_eta=f"r_eta_{key}")
        if aucs is not None:
            add(aucs, auc="auc", auc_hard="auc_hard")
    if not parts:
        return edges.sparkSession.createDataFrame([], "measure string, readout string, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def published_readouts(tables: dict, edges: DataFrame, geometry: DataFrame, protocol: Protocol = Protocol(), measures: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """readout and one column a measure, in the order of the read-outs, from result tables (see ``read_published``).

    All measures go through one plan. AUCs are taken from their table; what a measure was not run through is NULL.
    """
    values = readout_values(protocol=protocol, edges=edges, geometry=geometry, criteria=set(CRITERIA), **tables).filter(F.col("measure").isin(*measures))
    order = _readouts(edges.sparkSession).select("at", "readout")
    wide = values.groupBy("readout").pivot("measure", list(measures)).agg(F.first("value"))
    return F.broadcast(order).join(wide, "readout", "left").orderBy("at").drop("at")


def _readouts(spark: SparkSession) -> DataFrame:
    """at, readout, criterion, label, direction, as one row of constants taken apart: no Python source to run."""
    rows = [F.struct(F.lit(i).alias("at"), F.lit(k).alias("readout"), F.lit(c).alias("criterion"), F.lit(label).alias("label"), F.lit(d).alias("direction")) for i, (k, c, label, d) in enumerate(READOUTS)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def aucs_of(scores: DataFrame, hard: int) -> DataFrame:
    """measure, auc, auc_hard."""
    return r.discrimination(scores).join(r.discrimination(scores, hard).withColumnRenamed("auc", "auc_hard"), "measure")


def compared(name: str, values: DataFrame, beside: list[str], criteria: set[str]) -> tuple[DataFrame, DataFrame]:
    """The report's table and its long form, from (measure, readout, value) of a new measure and of those beside it."""
    rows = _readouts(values.sparkSession).filter(F.col("criterion").isin(*criteria))
    ranked = r.ranks(values, rows.select("readout", "direction")).select("readout", "measure", "rank")
    long = written(values.join(F.broadcast(rows.select("readout")), "readout").join(ranked, ["readout", "measure"], "left").select(F.col("readout").alias("key"), "measure", "value", "rank"), "compared")
    wide = long.groupBy("key").pivot("measure", [name, *beside]).agg(F.first("value"))
    own = long.filter(F.col("measure") == name).select("key", "rank")
    direction = F.when(F.col("direction") > 0, "higher").when(F.col("direction") < 0, "lower").otherwise("")
    table = rows.select("at", F.col("readout").alias("key"), "criterion", F.col("label").alias("readout"), direction.alias("direction"))
    return table.join(wide, "key", "left").join(own, "key", "left").orderBy("at").drop("at"), long


def evaluate(
    measure: Callable,
    edges: DataFrame,
    meta: DataFrame,
    reference: DataFrame,
    geometry: DataFrame,
    name: str | None = None,
    similarity: bool = False,
    criteria=CRITERIA,
    protocol: Protocol = Protocol(),
    published: dict | None = None,
    beside: tuple[str, ...] = SELECTED,
    recoveries: dict[str, Recovery] | None = None,
    subjects: tuple[DataFrame, DataFrame] | None = None,
    slow: set[str] | None = None,
) -> Report:
    """Rank a measure, a function of two matrices, beside registered ones on one population of networks.

    ``published`` has the result tables of ``read_published``: the registered measures' read-outs come from them, and the
    measure's landscape is correlated with theirs (agreement is the mean over the eight selected). Without it, the
    measures named ``beside`` are run too and stand for them.

    ``similarity`` alone says whether higher values mean more alike, whatever the measure is called. ``recoveries`` has
    the keys wide and window. ``subjects`` are networks and, by the same net_id, the consensus of the
    others; they are compared only when accuracy and another criterion are asked for. ``slow`` names the measures
    for the shorter noise protocol; by default those whose mean time is above the protocol's ``slow_ms``.
    """
    criteria = set(criteria)
    if unknown := criteria - set(CRITERIA):
        raise ValueError(f"unknown criteria: {sorted(unknown)}")
    if (largest := edges.unionByName(reference, allowMissingColumns=True).agg(F.max("v")).first()[0] or 0) >= protocol.nodes:
        raise ValueError(f"node {largest} in networks of {protocol.nodes} nodes; give a protocol of that size")
    name = name or getattr(measure, "__name__", "measure")
    # read-outs know a registered name's direction; where the caller's is the other, values change their sign meanwhile
    turned = similarity != (name in SIMILARITIES)
    own = measure
    if turned:

        @functools.wraps(measure)
        def own(a, b, **more):
            return -measure(a, b, **more)

    measures = {name: own} | ({} if published else {k: MEASURES[k] for k in beside if k != name})
    wide = np.zeros((protocol.nodes, protocol.nodes))
    for row in geometry.collect():
        wide[row["u"], row["v"]] = wide[row["v"], row["u"]] = row["dist"]
    land, extras = None, {}
    if criteria - {"accuracy"}:
        land = written(landscape(edges, meta, reference, measures, protocol.nodes, wide), "landscape")
        missing = land.filter("value is null").count()
        if missing:
            warnings.warn(f"{missing} comparisons gave no value", stacklevel=2)
    if "sensitivity" in criteria:
        extras["trajectories"] = written(x.trajectories(reference, {"hamming": MEASURES["hamming"]} | measures, protocol, wide), "trajectories")
        drawn = written(x.noise_references(reference, protocol), "references")
        if slow is None:
            slow = {row["measure"] for row in land.groupBy("measure").agg(F.avg("ms").alias("ms")).filter(F.col("ms") > protocol.slow_ms).collect()}
        extras["draws"] = written(x.noise_draws(drawn, edges, meta, land, measures, slow, protocol, wide), "draws")
        extras["effective"] = drawn.select("s", "repeat", "eff")
    if "accuracy" in criteria:
        extras["recoveries"] = {k: written(x.recovery_distances(v, measures, protocol, wide), f"recovery-{k}") for k, v in (recoveries or {}).items()}
        if subjects and land is not None:
            extras["aucs"] = aucs_of(written(x.discrimination_scores(land, *subjects, measures, protocol, wide), "scores"), protocol.hard_cases)
    values = readout_values(land, edges, geometry, criteria, protocol, **extras, others=published["land"] if published else None)
    values = values.filter(F.col("measure").isin(*measures))
    shown = {k: NAMES[k] if NAMES[k] != name else f"{NAMES[k]} (published)" for k in (MEASURES if published else measures) if k in NAMES and (published or k != name)}
    by_name = lambda df, names: df.join(F.broadcast(_pairs_of(df.sparkSession, names)), "measure").select(F.col("shown").alias("measure"), "readout", "value")
    if published:
        values = by_name(values, {name: name}).unionByName(by_name(readout_values(edges=edges, geometry=geometry, criteria=criteria, protocol=protocol, **published), shown))
    else:
        values = by_name(values, {name: name} | shown)
    table, long = compared(name, written(values, "readouts"), list(shown.values()), criteria)
    if land is not None and turned:
        land = land.withColumn("value", F.when(F.col("measure") == name, -F.col("value")).otherwise(F.col("value")))
    if land is not None:
        extras["runtime_sd_ms"] = land.filter(F.col("measure") == name).agg(F.stddev_samp("ms")).first()[0]
    return Report(name, table, long, land, extras)


def _pairs_of(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """measure, shown: a few names as rows."""
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])).alias("measure", "shown"))
