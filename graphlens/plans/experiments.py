"""The experiments that score new pairs of networks: degeneration, noise, recovery, discrimination.

Each is one plan for all measures. What meets every network is bounded by the protocol, not by the data: draws of the
reference and the recovery grid are broadcast, networks stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Protocol
from ..operators.rewire import swap_draws
from ..operators.scoring import packed, score
from ..sources.tables import written
from .readouts import oriented

Measures = dict[str, Callable]


@dataclass(frozen=True)
class Recovery:
    """Targets and the grid that they are matched with: edges (net_id, eta, gamma, u, v)."""

    targets: DataFrame
    grid: DataFrame


def trajectories(reference: DataFrame, measures: Measures, protocol: Protocol, geometry: np.ndarray | None = None) -> DataFrame:
    """measure, process_id, step, rewire_fraction, value: every step rewires the reference anew."""
    n = protocol.steps + 1
    step = F.col("draw") % n
    seeds = reference.sparkSession.range(protocol.trajectories * n).select(F.col("id").alias("draw"))
    seeds = seeds.withColumn("s", F.floor(step * protocol.edges / protocol.steps).cast("int"))
    drawn = swap_draws(reference, seeds, protocol.swap_tries, protocol.degeneration_seed)
    original = packed(reference.withColumn("k", F.lit(0)), "k").select(F.col("code").alias("b"))
    scored = score(drawn.select("draw", F.col("code").alias("a")).join(F.broadcast(original)), measures, protocol.nodes, geometry, ("draw",))
    return scored.select("measure", F.floor(F.col("draw") / n).alias("process_id"), step.alias("step"), (step / F.lit(float(protocol.steps))).alias("rewire_fraction"), "value")


def grid_index(meta: DataFrame) -> DataFrame:
    """net_id, i_eta, i_gamma: the positions of a network's parameters on the two axes, which hold few values."""
    out = meta
    for c in ("eta", "gamma"):
        axis = meta.select(c).distinct().withColumn(f"i_{c}", F.row_number().over(Window.orderBy(c)) - 1)
        out = out.join(F.broadcast(axis), c)
    return out.select("net_id", "i_eta", "i_gamma")


def _best(scored: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """by, e, g: the cell with the lowest mean (to so many digits if given), ties by gamma, then eta."""
    mean = F.avg("o") if digits is None else F.round(F.avg("o"), digits)
    cell = oriented(scored).groupBy(*by, "i_gamma", "i_eta").agg(mean.alias("m")).filter("m is not null")
    best = cell.groupBy(*by).agg(F.min(F.struct("m", "i_gamma", "i_eta")).alias("c"))
    return best.select(*by, F.col("c.i_eta").alias("e"), F.col("c.i_gamma").alias("g"))


def noise_references(reference: DataFrame, protocol: Protocol) -> DataFrame:
    """draw, s, repeat, code, eff: the reference after s attempts at swaps that keep it connected."""
    levels, repeats = protocol.noise_levels, protocol.noise_repeats
    level = F.get(F.array(*map(F.lit, levels)), F.floor(F.col("id") / repeats).cast("int"))
    seeds = reference.sparkSession.range(len(levels) * repeats).select(F.col("id").alias("draw"), level.alias("s"))
    drawn = swap_draws(reference, seeds, 1, protocol.noise_seed, protocol.nodes)
    return drawn.select("draw", "s", (F.col("draw") % repeats).cast("int").alias("repeat"), "code", (F.col("lost") / F.lit(float(protocol.edges))).alias("eff"))


def noise_draws(references: DataFrame, edges: DataFrame, meta: DataFrame, land: DataFrame, measures: Measures, slow: set[str], protocol: Protocol, geometry: np.ndarray | None = None, digits: int | None = None) -> DataFrame:
    """measure, s, repeat, drift: how far, in grid steps, the best cell moves when the reference is disturbed.

    Measures in ``slow`` take fewer repeats and only networks near their first best cell. An optimum on the border of
    that window, unless it is the border of the grid, is looked for again everywhere up to the level
    ``slow_full_until``, and counts as ``censored_drift`` above. Means are compared to ``digits`` if given, so that ties are alike
    everywhere.
    """
    at = written(grid_index(meta), "grid")
    first = written(_best(land.select("measure", "net_id", "value").join(at, "net_id"), ["measure"], digits).withColumnsRenamed({"e": "e0", "g": "g0"}), "first")
    nets = written(packed(edges).select("net_id", F.col("code").alias("a")).join(at, "net_id"), "networks")
    draws = references.select("draw", "s", "repeat", F.col("code").alias("b"))
    away = F.hypot((F.col("e") - F.col("e0")).cast("double"), (F.col("g") - F.col("g0")).cast("double"))

    def best(networks: DataFrame, bounded: DataFrame, chosen: Measures) -> DataFrame:
        pairs = networks.select("net_id", "i_eta", "i_gamma", "a").join(F.broadcast(bounded))
        keys = ("draw", "s", "repeat", "i_eta", "i_gamma")
        return _best(score(pairs, chosen, protocol.nodes, geometry, keys), ["measure", "draw", "s", "repeat"], digits)

    parts = []
    if fast := {k: f for k, f in measures.items() if k not in slow}:
        parts.append(best(nets, draws, fast).join(F.broadcast(first), "measure").select("measure", "s", "repeat", away.alias("drift")))
    w = protocol.slow_window
    last = at.agg(F.max("i_eta").alias("last_e"), F.max("i_gamma").alias("last_g"))

    def border(c: str) -> Column:
        low, high = F.col(f"{c}0") - w, F.col(f"{c}0") + w
        return ((F.col(c) == low) & (low > 0)) | ((F.col(c) == high) & (high < F.col(f"last_{c}")))

    for name in sorted(slow & measures.keys()):
        centre, one = first.filter(F.col("measure") == name), {name: measures[name]}
        few = draws.filter(F.col("repeat") < protocol.noise_repeats_slow)
        near = nets.join(F.broadcast(centre)).filter((F.abs(F.col("i_eta") - F.col("e0")) <= w) & (F.abs(F.col("i_gamma") - F.col("g0")) <= w))
        found = best(near, few, one).join(F.broadcast(centre), "measure").join(F.broadcast(last))
        found = written(found.withColumn("edge", border("e") | border("g")), "near")
        again = F.col("edge") & (F.col("s") <= protocol.slow_full_until)
        wide = best(nets, few.join(found.filter(again), "draw", "left_semi"), one).join(F.broadcast(centre), "measure")
        inside = found.filter(~again).withColumn("drift", F.when(F.col("edge"), F.lit(protocol.censored_drift)).otherwise(away))
        parts += [inside.select("measure", "s", "repeat", "drift"), wide.select("measure", "s", "repeat", away.alias("drift"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recovery_distances(recovery: Recovery, measures: Measures, protocol: Protocol, geometry: np.ndarray | None = None) -> DataFrame:
    """measure, tidx, t_eta, t_gamma, gidx, g_eta, g_gamma, value of every target with every network of the grid."""

    def side(df: DataFrame, letter: str, code: str) -> tuple[DataFrame, DataFrame]:
        named = {"net_id": f"{letter}idx", "eta": f"{letter}_eta", "gamma": f"{letter}_gamma"}
        return packed(df).withColumnsRenamed({"net_id": f"{letter}idx", "code": code}), df.select(*named).distinct().withColumnsRenamed(named)

    (t, t_at), (g, g_at) = side(recovery.targets, "t", "a"), side(recovery.grid, "g", "b")
    scored = score(t.join(F.broadcast(g)), measures, protocol.nodes, geometry, ("tidx", "gidx"))
    return scored.drop("ms").join(F.broadcast(t_at), "tidx").join(F.broadcast(g_at), "gidx")


def discrimination_scores(land: DataFrame, subjects: DataFrame, others: DataFrame, measures: Measures, protocol: Protocol, geometry: np.ndarray | None = None) -> DataFrame:
    """measure, real, score: subjects (net_id, u, v) against the consensus of the others, and the networks of the landscape."""
    a, b = (packed(df).withColumnRenamed("code", c) for df, c in ((subjects, "a"), (others, "b")))
    real = score(a.join(b, "net_id"), measures, protocol.nodes, geometry, ("net_id",))
    both = real.select("measure", "value", F.lit(True).alias("real")).unionByName(land.select("measure", "value", F.lit(False).alias("real")))
    return oriented(both).select("measure", "real", (-F.col("o")).alias("score"))
