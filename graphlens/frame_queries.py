"""Queries of the graph algorithms that run as joins over edge tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import frames, series, setops
from .queries import ORACLES, N, _info_sql, _nets, query
from .sources import fixture as fx


def _same_as(name: str) -> str:
    """The SQL of another query, for one that computes the same in another way."""
    return ORACLES[name].split(fx.SQL.strip(), 1)[1]


def _every_node(edges: DataFrame) -> DataFrame:
    return edges.select("net_id").distinct().select("net_id", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("i"))


def _heavy(spark, sf) -> DataFrame:
    """The networks without their ring, so that some fall apart."""
    return _nets(spark, sf).select("net_id", "u", "v").filter(f"v <> u + 1 and not (u = 0 and v = {N - 1})")


HEAVY = """,
hv AS (SELECT net_id, u, v FROM edges WHERE v <> u + 1 AND NOT (u = 0 AND v = 24)),
ht AS (SELECT net_id, u AS i, v AS j FROM hv UNION ALL SELECT net_id, v, u FROM hv)"""


@query("portrait_hist_frames", _same_as("portrait_hist"), True)
def portrait_hist_frames(spark, sf):
    return frames.portrait(frames.search(_nets(spark, sf)))


@query("betweenness_frames", _same_as("betweenness"), True)
def betweenness_frames(spark, sf):
    return frames.betweenness(_nets(spark, sf)).withColumn("betweenness", F.round("betweenness", 7))


@query("core2", HEAVY + """,
al(net_id, n, u, v) AS (
  SELECT net_id, 0, u, v FROM hv
  UNION ALL
  SELECT net_id, n + 1, u, v FROM (
    SELECT a.net_id, a.n, a.u, a.v, (SELECT count(*) FROM al x WHERE x.net_id = a.net_id AND (x.u = a.u OR x.v = a.u)) AS du, (SELECT count(*) FROM al x WHERE x.net_id = a.net_id AND (x.u = a.v OR x.v = a.v)) AS dv FROM al a) z
  WHERE du > 1 AND dv > 1 AND n < 25),
cr AS (SELECT net_id, u, v FROM al WHERE n = 25),
cn AS (SELECT net_id, count(DISTINCT i) AS c FROM (SELECT net_id, u AS i FROM cr UNION ALL SELECT net_id, v FROM cr) z GROUP BY ALL)
SELECT net_id, coalesce(c, 0)::BIGINT AS core_nodes, (SELECT count(*) FROM cr WHERE cr.net_id = d.net_id) AS core_edges FROM (SELECT DISTINCT net_id FROM hv) d LEFT JOIN cn USING (net_id)""", True)
def core2(spark, sf):
    """The 2-cores of networks without their ring, empty ones too."""
    return frames.core_sizes(_heavy(spark, sf))


REACH = HEAVY + """,
nd AS (SELECT net_id, i::INT AS i FROM (SELECT DISTINCT net_id FROM hv) d, range(25) t(i)),
rc(net_id, i, j) AS (SELECT net_id, i, i FROM nd UNION SELECT rc.net_id, rc.i, ht.j FROM rc JOIN ht ON ht.net_id = rc.net_id AND ht.i = rc.j),
co AS (SELECT net_id, i, min(j) AS component FROM rc GROUP BY ALL)"""


@query("network_components", REACH + " SELECT net_id, i, component FROM co", True)
def network_components(spark, sf):
    e = _heavy(spark, sf)
    return frames.components(e, _every_node(e))


@query("network_connected", REACH + " SELECT net_id, count(DISTINCT component) AS parts, count(DISTINCT component) = 1 AS connected FROM co GROUP BY ALL", True)
def network_connected(spark, sf):
    """Into how many parts the networks fall without their ring."""
    e = _heavy(spark, sf)
    return frames.connected(e, _every_node(e))


def _against(spark, sf, measure) -> DataFrame:
    e, ref = _nets(spark, sf).select("net_id", "u", "v"), fx.reference(spark, sf)
    one = spark.range(N).select(F.col("id").cast("int").alias("i"))
    return measure(e, ref, _every_node(e), one).withColumn("value", F.round("value", 6))


@query("m_delta_con_frames", _same_as("m_delta_con"), True)
def m_delta_con_frames(spark, sf):
    return _against(spark, sf, series.delta_con)


@query("m_communicability_corr_frames", _same_as("m_communicability_corr"), True)
def m_communicability_corr_frames(spark, sf):
    return _against(spark, sf, series.communicability_correlation)


#: Weighted networks and reference, and which weights each measure takes for edges.
WEIGHTED = """,
wn AS MATERIALIZED (SELECT net_id, u, v, cents % 500 / 100.0::DOUBLE - 1 AS w FROM w JOIN nets USING (eta, gamma, rep)),
wr AS MATERIALIZED (SELECT u, v, cents % 500 / 100.0::DOUBLE - 1 AS w FROM rw),
wc AS (SELECT d.net_id, (SELECT count(*) FROM wn WHERE wn.net_id = d.net_id AND {0}) AS a, (SELECT count(*) FROM wr WHERE {0}) AS r,
              (SELECT count(*) FROM (SELECT net_id, u, v FROM wn WHERE {0}) x JOIN (SELECT u, v FROM wr WHERE {0}) y USING (u, v) WHERE x.net_id = d.net_id) AS b
       FROM (SELECT DISTINCT net_id FROM wn) d)"""
_WEIGHTED = {
    "hamming": ("w > 0", "SELECT net_id, (a + r - 2 * b)::DOUBLE AS value FROM wc"),
    "jaccard": ("w > 0.5", "SELECT net_id, round(2.0::DOUBLE * b / (2.0::DOUBLE * (a + r - b) + 1e-10), 9) AS value FROM wc"),
    "f1": ("trunc(w) = 1", "SELECT net_id, round(coalesce(2.0::DOUBLE * b / nullif(a + r, 0), 0), 9) AS value FROM wc"),
    "network_mutual_information": ("w <> 0", f""", p AS (SELECT net_id, a / 300.0::DOUBLE AS p1, r / 300.0::DOUBLE AS p2, b / 300.0::DOUBLE AS p12 FROM wc),
i AS (SELECT net_id, {_info_sql('p')}) SELECT net_id, round((2 * (h1 + h2 - h12) + 1e-100) / (h1 + h2 + 1e-100), 8) AS value FROM i"""),
    "frobenius": ("true", """, f AS (SELECT d.net_id, (SELECT sum(w * w) FROM wn WHERE wn.net_id = d.net_id) AS ww, (SELECT sum(w * w) FROM wr) AS rr,
  (SELECT coalesce(sum(wn.w * wr.w), 0) FROM wn JOIN wr USING (u, v) WHERE wn.net_id = d.net_id) AS x FROM (SELECT DISTINCT net_id FROM wn) d)
SELECT net_id, round(sqrt(2.0::DOUBLE * (ww + rr - 2 * x)), 7) AS value FROM f"""),
}


def _weighted(name: str, predicate: str, sql: str):
    @query(f"m_{name}_weighted", WEIGHTED.format(predicate) + (sql if sql.startswith(",") else f" {sql}"))
    def f(spark, sf):
        digits = {"frobenius": 7, "network_mutual_information": 8}.get(name, 9)
        found = setops.weighted_measure(name, fx.weighted(spark, sf), fx.weighted_reference(spark, sf), N)
        return found.select("net_id", F.round(name, digits).alias("value"))


for _name, _of in _WEIGHTED.items():
    _weighted(_name, *_of)
