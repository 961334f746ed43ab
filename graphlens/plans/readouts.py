"""Read-outs of landscapes and result tables, for all measures in one plan.

A landscape is (measure, net_id, eta, gamma, value); ``oriented`` makes lower mean more alike. Missing values are
NULL and take no part. Orders are total: ties go by eta, gamma or by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import SELECTED, SIMILARITIES
from ..sources.tables import written


def oriented(landscape: DataFrame) -> DataFrame:
    return landscape.withColumn("o", F.when(F.col("measure").isin(*SIMILARITIES), -F.col("value")).otherwise(F.col("value")))


def cells(landscape: DataFrame, digits: int | None = None) -> DataFrame:
    """measure, eta, gamma, cell_mean: the mean oriented value; to so many digits if given, so that ties are alike everywhere."""
    mean = F.avg("o") if digits is None else F.round(F.avg("o"), digits)
    return oriented(landscape).groupBy("measure", "eta", "gamma").agg(mean.alias("cell_mean"))


def best_cell(landscape: DataFrame, digits: int | None = None) -> DataFrame:
    c = cells(landscape, digits).filter("cell_mean is not null")
    best = c.groupBy("measure").agg(F.min(F.struct("cell_mean", "eta", "gamma")).alias("b"))
    return best.select("measure", F.col("b.eta").alias("best_eta"), F.col("b.gamma").alias("best_gamma"))


def best_cells(landscape: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    order = Window.partitionBy("measure").orderBy("cell_mean", "eta", "gamma")
    return cells(landscape, digits).filter("cell_mean is not null").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def eta_positive(landscape: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    return best_cells(landscape, k, digits).groupBy("measure").agg(F.count_if(F.col("eta") > 0).alias("eta_positive"))


def total_variation(landscape: DataFrame, k: int, eta_range, gamma_range, digits: int | None = None) -> DataFrame:
    scaled = lambda c, r: (F.col(c) - r[0]) / (r[1] - r[0])
    return best_cells(landscape, k, digits).groupBy("measure").agg((F.var_pop(scaled("eta", eta_range)) + F.var_pop(scaled("gamma", gamma_range))).alias("total_variation"))


def best_networks(landscape: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("measure").orderBy(F.col("o").asc_nulls_last(), "net_id")
    return oriented(landscape).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("measure", "net_id")


def connection_length(landscape: DataFrame, edges: DataFrame, geometry: DataFrame, k: int, beyond: float) -> DataFrame:
    lengths = edges.join(best_networks(landscape, k), "net_id").join(F.broadcast(geometry), ["u", "v"])
    return lengths.groupBy("measure").agg(F.avg("dist").alias("connection_length_mm"), (100 * F.avg((F.col("dist") > beyond).cast("double"))).alias("percent_beyond"))


def degree_sd(landscape: DataFrame, edges: DataFrame, k: int, nodes: int) -> DataFrame:
    """The mean over the best networks of the population SD of degree; nodes without edges count as 0."""
    from ..operators.setops import degrees

    d = degrees(edges.join(best_networks(landscape, k).select("net_id").distinct(), "net_id", "left_semi"))
    per = d.groupBy("net_id").agg(F.sum("degree").alias("s"), F.sum(F.col("degree") * F.col("degree")).alias("s2"))
    sd = F.sqrt(F.col("s2") / F.lit(float(nodes)) - F.pow(F.col("s") / F.lit(float(nodes)), 2))
    return best_networks(landscape, k).join(per, "net_id").groupBy("measure").agg(F.avg(sd).alias("degree_sd"))


def isnr(landscape: DataFrame) -> DataFrame:
    """10 log10 of the variance of cell means over the mean variance within cells, on raw values."""
    c = landscape.groupBy("measure", "eta", "gamma").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    ratio = F.try_divide(F.var_pop("m"), F.avg("v"))
    return c.groupBy("measure").agg((10 * F.log10(ratio)).alias("isnr_db"))


def correlations(landscape: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """measure, other, r: Pearson r of oriented landscapes with those in ``others`` (by default with each other) over
    networks where both are known; NULL if one is constant.
    """
    known = lambda df: oriented(df).filter("o is not null")
    other = known(landscape if others is None else others).select(F.col("measure").alias("other"), "net_id", F.col("o").alias("p"))
    r = F.try_divide(F.covar_pop("o", "p"), F.stddev_pop("o") * F.stddev_pop("p"))
    return known(landscape).select("measure", "net_id", "o").join(other, "net_id").filter("measure <> other").groupBy("measure", "other").agg(r.alias("r"))


def agreement(landscape: DataFrame, selected=SELECTED, others: DataFrame | None = None) -> DataFrame:
    """measure, agreement (mean r with the selected ones), max_abs_r; a measure never stands beside itself."""
    return correlations(landscape, others).groupBy("measure").agg(F.avg(F.when(F.col("other").isin(*selected), F.col("r"))).alias("agreement"), F.max(F.abs("r")).alias("max_abs_r"))


def degeneration(trajectories: DataFrame) -> DataFrame:
    """measure, mae, cv from (measure, process_id, step, rewire_fraction, value), hamming among the measures."""

    ends = trajectories.groupBy("measure").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    g = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    t = trajectories.join(F.broadcast(ends), "measure").withColumn("g", F.when(F.col("measure").isin(*SIMILARITIES), 1 - g).otherwise(g))
    process = Window.partitionBy("measure", "process_id")  # one trajectory, as long as the protocol has steps
    p = F.try_divide(F.col("g") - F.min("g").over(process), F.max("g").over(process) - F.min("g").over(process))
    step = t.withColumn("p", p).groupBy("measure", "step").agg(F.avg("p").alias("y"))
    line = step.filter("measure = 'hamming'").select("step", F.col("y").alias("x"))
    mae = step.join(line, "step").groupBy("measure").agg(F.avg(F.abs(F.col("y") - F.col("x"))).alias("mae"))
    cv = t.groupBy("measure", "rewire_fraction").agg(F.try_divide(F.stddev_samp("g"), F.avg("g")).alias("c")).groupBy("measure").agg(F.avg("c").alias("cv"))
    return mae.join(cv, "measure")


def noise_tolerance(draws: DataFrame, effective: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """measure, noise_tolerance: the mean effective degeneration of the largest level whose median drift is within the cutoff."""
    level = draws.groupBy("measure", "s").agg(F.median("drift").alias("d"))
    eff = effective.groupBy("s").agg(F.avg("eff").alias("eff"))
    best = level.groupBy("measure").agg(F.max(F.when(F.col("d") <= cutoff, F.col("s"))).alias("s"))
    return best.join(F.broadcast(eff), "s", "left").select("measure", F.coalesce("eff", F.lit(0.0)).alias("noise_tolerance"))


def recovery(distances: DataFrame) -> DataFrame:
    """measure, error, r_eta from (measure, t_eta, t_gamma, tidx, g_eta, g_gamma, gidx, value): targets take their best
    grid point; the error is in grid steps on the ranks of the axes.
    """
    best = oriented(distances).filter("o is not null").groupBy("measure", "tidx", "t_eta", "t_gamma").agg(F.min(F.struct("o", "gidx", "g_eta", "g_gamma")).alias("b"))
    axis = lambda c, n: distances.select(F.col(c).alias(n)).distinct().withColumn(f"{n}_at", F.row_number().over(Window.orderBy(n)) - 1)
    eta, gamma = F.broadcast(axis("g_eta", "e")), F.broadcast(axis("g_gamma", "g"))

    def nearest(df: DataFrame, col: str, ax: DataFrame, n: str) -> DataFrame:
        points = ax.agg(F.array_sort(F.collect_list(F.struct(n, f"{n}_at"))).alias("axis"))
        near = F.array_min(F.transform("axis", lambda p: F.struct(F.abs(F.col(col) - p[n]).alias("d"), p[f"{n}_at"].alias("at"))))
        return df.crossJoin(F.broadcast(points)).withColumn(f"{col}_at", near["at"]).drop("axis")

    b = nearest(nearest(best, "t_eta", eta, "e"), "t_gamma", gamma, "g")
    b = b.join(eta.withColumnRenamed("e_at", "re"), F.col("b.g_eta") == F.col("e")).join(gamma.withColumnRenamed("g_at", "rg"), F.col("b.g_gamma") == F.col("g"))
    r = F.try_divide(F.covar_pop(F.col("t_eta").cast("double"), F.col("e").cast("double")), F.stddev_pop("t_eta") * F.stddev_pop("e"))
    return b.groupBy("measure").agg(F.avg(F.hypot((F.col("t_eta_at") - F.col("re")).cast("double"), (F.col("t_gamma_at") - F.col("rg")).cast("double"))).alias("error"), r.alias("r_eta"))


def discrimination(scores: DataFrame, hard: int | None = None) -> DataFrame:
    """measure, auc from (measure, real, score): the share of pairs in which the real one scores higher, ties one half.
    ``hard`` keeps the artificial ones that score highest. Equal scores are counted first, so that only different
    ones are ordered: by ranges of scores, each a task's, whose sums say what lies below a range.
    """
    s = scores.filter("score is not null and not isnan(score)").select("measure", "real", "score")
    if hard:
        order = Window.partitionBy("measure").orderBy(F.desc("score"))
        s = s.filter("real").unionByName(s.filter("not real").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= hard).drop("at"))
    counted = s.groupBy("measure", "score").agg(F.count_if("real").alias("x"), F.count_if(~F.col("real")).alias("y"))
    ranged = written(counted.repartitionByRange("measure", "score").withColumn("part", F.spark_partition_id()), "ranged-scores")
    before = lambda by: F.coalesce(F.sum("y").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("measure", "part").agg(F.sum("y").alias("y"))
    starts = parts.select("measure", "part", before(Window.partitionBy("measure").orderBy("part")).alias("start"))
    within = ranged.withColumn("within", before(Window.partitionBy("measure", "part").orderBy("score")))
    won = F.sum(F.col("x") * (F.col("start") + F.col("within") + F.col("y") / 2.0))
    return within.join(starts, ["measure", "part"]).groupBy("measure").agg(F.try_divide(won, (F.sum("x") * F.sum("y")).cast("double")).alias("auc"))


def ranks(values: DataFrame, directions: DataFrame) -> DataFrame:
    """readout, measure, value, rank: average ranks of known values, best first; none where the direction is 0."""
    known = values.filter("value is not null and not isnan(value)").join(F.broadcast(directions), "readout")
    better = -F.col("direction") * F.col("value")
    w = Window.partitionBy("readout")
    ranked = known.filter("direction <> 0").withColumn("b", better)
    return ranked.withColumn("rank", F.rank().over(w.orderBy("b")) + (F.count("*").over(Window.partitionBy("readout", "b")) - 1) / 2.0).select("readout", "measure", "value", "rank")
