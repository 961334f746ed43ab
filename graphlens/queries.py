"""The query catalogue on networks derived from the trade tables, and the same queries in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SMALL
from .functions import kernels as k
from .functions import symmetry as sym
from .functions.measures import COMPONENTS, MEASURES
from .operators import setops
from .operators.consensus import consensus
from .operators.rewire import drawn_edges, lost_edges, swap_draws
from .operators.scoring import against, matrix, packed, score
from .plans import experiments as x
from .plans import readouts as r
from .sources import fixture as fx
from .sources.readers import validate
from .sources.tables import written

N = fx.NODES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SETS = ("frobenius", "hamming", "jaccard", "f1")


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{fx.SQL.strip()}{sql}"
        return f

    return add


def _nets(spark, sf):
    return fx.networks(spark, sf)


def _meta(spark, sf):
    return _nets(spark, sf).select("net_id", "eta", "gamma", "rep").distinct()


def _lattice() -> np.ndarray:
    at = np.array([(30 * (i % 5), 30 * (i // 5)) for i in range(N)], float)
    return np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))


def _land(spark, sf) -> DataFrame:
    """measure, net_id, eta, gamma, rep, value of the set measures, to nine digits."""
    wide = setops.set_measures(_nets(spark, sf), fx.reference(spark, sf), N).select("net_id", *[F.round(F.col(m).cast("double"), 9).alias(m) for m in SETS])
    return fx.kept(spark, sf, "land", lambda: wide.unpivot("net_id", list(SETS), "measure", "value").join(_meta(spark, sf), "net_id"))


LAND = """,
cnt AS (SELECT net_id, eta, gamma, rep, count(*) AS a, count(ref.u) AS b, (SELECT count(*) FROM ref) AS r
        FROM edges LEFT JOIN ref USING (u, v) GROUP BY ALL),
land AS (
  SELECT net_id, eta, gamma, rep, m AS measure, round(CASE m WHEN 'frobenius' THEN sqrt(2.0 * (a + r - 2 * b)) WHEN 'hamming' THEN (a + r - 2 * b)::DOUBLE
         WHEN 'jaccard' THEN 2.0::DOUBLE * b / (2.0::DOUBLE * (a + r - b) + 1e-10) ELSE 2.0::DOUBLE * b / (a + r) END, 9) AS value
  FROM cnt, (VALUES ('frobenius'), ('hamming'), ('jaccard'), ('f1')) AS t(m)),
ori AS (SELECT *, CASE WHEN measure IN ('jaccard', 'f1') THEN -value ELSE value END AS o FROM land),
cell AS (SELECT measure, eta, gamma, round(avg(o), 9) AS cell_mean FROM ori GROUP BY ALL)"""


@query("networks_edges", " SELECT net_id, eta::INT AS eta, gamma::INT AS gamma, rep, u, v FROM edges")
def networks_edges(spark, sf):
    return _nets(spark, sf)


@query("network_validate", """, bad AS (
  SELECT net_id, u, v FROM edges
  UNION ALL SELECT net_id + 1000, u, v FROM edges WHERE net_id < 20 UNION ALL SELECT net_id + 1000, u, v FROM edges WHERE net_id < 20 AND u = 0
  UNION ALL SELECT net_id + 2000, v, u FROM edges WHERE net_id < 20
  UNION ALL SELECT net_id + 3000, u, v + CASE WHEN v = 24 AND net_id % 2 = 0 THEN 1 ELSE 0 END FROM edges WHERE net_id < 20)
SELECT net_id, count(*) AS n_edges, bool_and(u < v AND u >= 0 AND v < 25) AND count(*) = count(DISTINCT u * 100 + v) AS ok FROM bad GROUP BY net_id""")
def network_validate(spark, sf):
    """Sound networks; some with an edge twice, with ends turned round, with a node too many."""
    e = _nets(spark, sf).select("net_id", "u", "v")
    few, shift = e.filter("net_id < 20"), lambda df, n: df.withColumn("net_id", F.col("net_id") + n)
    twice = shift(few.unionByName(few.filter("u = 0")), 1000)
    turned = shift(few.select("net_id", F.col("v").alias("u"), F.col("u").alias("v")), 2000)
    beyond = shift(few.withColumn("v", F.when((F.col("v") == N - 1) & (F.col("net_id") % 2 == 0), N).otherwise(F.col("v"))), 3000)
    return validate(e.unionByName(twice).unionByName(turned).unionByName(beyond), N)


@query("bitset_roundtrip", " SELECT net_id, u, v FROM edges")
def bitset_roundtrip(spark, sf):
    return setops.edges_of_bits(setops.bit_rows(_nets(spark, sf)))


TWO = """,
two AS (SELECT net_id, u AS i, v AS j FROM edges UNION ALL SELECT net_id, v, u FROM edges)"""


@query("degree_sequence", TWO + " SELECT net_id, i, count(*) AS degree FROM two GROUP BY ALL")
def degree_sequence(spark, sf):
    return setops.degrees(_nets(spark, sf))


@query("landscape_hamming", LAND + " SELECT eta::INT AS eta, gamma::INT AS gamma, cell_mean FROM cell WHERE measure = 'hamming'")
def landscape_hamming(spark, sf):
    return r.cells(_land(spark, sf).filter("measure = 'hamming'"), 9).select("eta", "gamma", "cell_mean")


def _set_query(name: str):
    @query(f"m_{name}", LAND + f" SELECT net_id, value FROM land WHERE measure = '{name}'")
    def f(spark, sf):
        return _land(spark, sf).filter(F.col("measure") == name).select("net_id", "value")


for _name in SETS:
    _set_query(_name)

_H = "-(CASE WHEN {0} > 1e-15 THEN ({0}) * ln({0}) ELSE 0 END)"


def _info_sql(n: str) -> str:
    h = lambda *p: "(" + " + ".join(_H.format(x) for x in p) + ")"
    return f"{h('p1', '(1 - p1)')} AS h1, {h('p2', '(1 - p2)')} AS h2, {h('p12', '(p1 - p12)', '(p2 - p12)', '(1 - p1 - p2 + p12)')} AS h12 FROM {n}"


@query("m_nmi", LAND + f""", p AS (SELECT net_id, a / 300.0::DOUBLE AS p1, r / 300.0::DOUBLE AS p2, b / 300.0::DOUBLE AS p12 FROM cnt),
i AS (SELECT net_id, {_info_sql('p')}) SELECT net_id, round((2 * (h1 + h2 - h12) + 1e-100) / (h1 + h2 + 1e-100), 9) AS value FROM i""")
def m_nmi(spark, sf):
    return setops.set_measures(_nets(spark, sf), fx.reference(spark, sf), N).select("net_id", F.round("network_mutual_information", 9).alias("value"))


@query("m_dc_nmi", TWO + f""", rt AS (SELECT u AS i, v AS j FROM ref UNION ALL SELECT v, u FROM ref),
p AS (SELECT net_id, two.i, count(*) / 25.0::DOUBLE AS p1, (SELECT count(*) FROM rt x WHERE x.i = two.i) / 25.0::DOUBLE AS p2, count(rt.i) / 25.0::DOUBLE AS p12
      FROM two LEFT JOIN rt ON rt.i = two.i AND rt.j = two.j GROUP BY net_id, two.i),
q AS (SELECT net_id, {_info_sql('p')}) SELECT net_id, round((2 * sum(h1 + h2 - h12) + 1e-100) / (sum(h1) + sum(h2) + 1e-100), 9) AS value FROM q GROUP BY net_id""")
def m_dc_nmi(spark, sf):
    return setops.degree_corrected(_nets(spark, sf), fx.reference(spark, sf), N).select("net_id", F.round("dc_network_mutual_information", 9).alias("value"))


_CLUST = """,
deg AS (SELECT net_id, i, count(*) AS d FROM two GROUP BY ALL),
tri AS (SELECT a.net_id, a.i, count(*) // 2 AS t FROM two a JOIN two b ON a.net_id = b.net_id AND a.i = b.i JOIN two c ON c.net_id = a.net_id AND c.i = a.j AND c.j = b.j GROUP BY ALL),
clu AS (SELECT deg.net_id, deg.i, d, coalesce(t, 0)::BIGINT AS t, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS c FROM deg LEFT JOIN tri USING (net_id, i))"""
CLUST = TWO + _CLUST


@query("clustering", CLUST + " SELECT net_id, i, d AS degree, t AS triangles, round(c, 9) AS clustering FROM clu")
def clustering(spark, sf):
    return setops.clustering(_nets(spark, sf)).withColumn("clustering", F.round("clustering", 9))


_EGO = """,
nb AS (SELECT two.net_id, two.i, avg(d) AS md, avg(c) AS mc, sum(d)::BIGINT AS sd FROM two JOIN clu ON clu.net_id = two.net_id AND clu.i = two.j GROUP BY ALL),
sec AS (SELECT net_id, i, count(*) AS n2 FROM (
  SELECT DISTINCT a.net_id, a.i, b.j FROM two a JOIN two b ON a.net_id = b.net_id AND a.j = b.i WHERE a.i <> b.j) s ANTI JOIN two USING (net_id, i, j) GROUP BY ALL),
ego AS (SELECT clu.net_id, clu.i, d, c, md, mc, d + t AS e_in, d + sd - 2 * (d + t) AS e_out, coalesce(n2, 0)::BIGINT AS n2
        FROM clu JOIN nb USING (net_id, i) LEFT JOIN sec USING (net_id, i))"""
EGO = CLUST + _EGO


@query("ego_features", EGO + """ SELECT net_id, i, d AS degree, round(c, 9) AS clustering, round(md, 9) AS mean_degree, round(mc, 9) AS mean_clustering,
e_in::BIGINT AS ego_edges, e_out::BIGINT AS ego_leaving, n2 AS two_away FROM ego""")
def ego_features(spark, sf):
    e = setops.ego_features(_nets(spark, sf))
    return e.select("net_id", "i", "degree", *[F.round(c, 9).alias(c) for c in ("clustering", "mean_degree", "mean_clustering")], F.col("ego_edges").cast("long").alias("ego_edges"), F.col("ego_leaving").cast("long").alias("ego_leaving"), "two_away")


def _kernel(name: str, sql: str | None = None, recursive: bool = False, digits: int = 7):
    @query(f"m_{name}", sql, recursive)
    def f(spark, sf):
        s = score(against(_nets(spark, sf), fx.reference(spark, sf)), {name: MEASURES[name]}, N, _lattice())
        return s.select(F.col("pair_id").alias("net_id"), F.round("value", digits).alias("value"))


ALL = """,
g AS (SELECT net_id, u, v FROM edges UNION ALL SELECT -1, u, v FROM ref),
gt AS (SELECT net_id, u AS i, v AS j FROM g UNION ALL SELECT net_id, v, u FROM g)"""
PATHS = ALL + """,
walk(net_id, s, t, d, sigma) AS (
  SELECT DISTINCT net_id, i, i, 0, 1::DOUBLE FROM gt
  UNION ALL
  SELECT walk.net_id, s, gt.j, d + 1, sum(sigma) FROM walk JOIN gt ON gt.net_id = walk.net_id AND gt.i = walk.t WHERE d < 8 GROUP BY ALL),
paths AS (SELECT net_id, s, t, d, sigma FROM walk QUALIFY d = min(d) OVER (PARTITION BY net_id, s, t))"""


@query("portrait_hist", PATHS + """, sh AS (SELECT net_id, s, d, count(*) AS n FROM paths WHERE net_id >= 0 GROUP BY ALL)
SELECT net_id, d AS l, n AS k, count(*) AS nodes FROM sh GROUP BY ALL""", True)
def portrait_hist(spark, sf):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [(n, l, kk, c) for n, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for (l, kk), c in k.portrait(matrix(code, N)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["net_id", "l", "k", "nodes"])

    return packed(_nets(spark, sf)).mapInArrow(run, "net_id long, l int, k long, nodes long")


_kernel("portrait", PATHS + """, sh AS (SELECT net_id, s, d, count(*) AS n FROM paths GROUP BY ALL),
hist AS (SELECT net_id, d, n, (n * c)::DOUBLE AS w FROM (SELECT net_id, d, n, count(*) AS c FROM sh GROUP BY ALL) z),
pr AS (SELECT net_id, d, n, w / sum(w) OVER (PARTITION BY net_id) AS p FROM hist),
jn AS (SELECT k.net_id, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q
  FROM (SELECT DISTINCT a.net_id, b.d, b.n FROM (SELECT DISTINCT net_id FROM pr WHERE net_id >= 0) a JOIN pr b ON b.net_id IN (a.net_id, -1)) k
  LEFT JOIN pr x ON x.net_id = k.net_id AND x.d = k.d AND x.n = k.n LEFT JOIN pr y ON y.net_id = -1 AND y.d = k.d AND y.n = k.n)
SELECT net_id, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 7) AS value FROM jn GROUP BY net_id""", True)


def _features(spark, sf, f, ddl: str, names: list[str]) -> DataFrame:
    """Rows (net_id, node, values) of a function of one matrix."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [(n, i, *map(float, row)) for n, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, row in enumerate(f(matrix(code, N)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), *[pa.array([x[2 + i] for x in out], pa.float64()) for i in range(len(names))]], names=["net_id", "i", *names])

    return packed(_nets(spark, sf)).mapInArrow(run, f"net_id long, i int, {ddl}")


@query("betweenness", PATHS + """ SELECT p.net_id, v.t AS i, round(coalesce(sum(CASE WHEN p.s <> v.t AND p.t <> v.t AND p.s <> p.t AND a.d + v.d = p.d THEN a.sigma * v.sigma / p.sigma END), 0) / (24 * 23), 7) AS betweenness
FROM paths p JOIN paths a ON a.net_id = p.net_id AND a.s = p.s JOIN paths v ON v.net_id = p.net_id AND v.s = p.t AND v.t = a.t WHERE p.net_id >= 0 GROUP BY ALL""", True)
def betweenness(spark, sf):
    return _features(spark, sf, lambda a: k.betweenness(a)[:, None], "betweenness double", ["betweenness"]).withColumn("betweenness", F.round("betweenness", 7))


SERIES = ALL + """,
dg AS (SELECT net_id, i, count(*) AS d FROM gt GROUP BY ALL), ep AS (SELECT net_id, 1.0::DOUBLE / (1 + max(d)) AS e FROM dg GROUP BY ALL),
mt AS ({matrix}),
ser(net_id, n, i, j, x) AS (
  SELECT net_id, 0, i, i, 1.0::DOUBLE FROM dg
  UNION ALL SELECT ser.net_id, n + 1, ser.i, mt.j, sum(ser.x * mt.x / {by}) FROM ser JOIN mt ON mt.net_id = ser.net_id AND mt.i = ser.j WHERE n < {terms} GROUP BY ALL),
sm AS (SELECT net_id, i, j, sum(x) AS x FROM ser GROUP BY ALL)"""
AFFINITY = SERIES.format(matrix="SELECT gt.net_id, i, j, e AS x FROM gt JOIN ep USING (net_id) UNION ALL SELECT net_id, i, i, -e * e * d FROM dg JOIN ep USING (net_id)", by="1", terms=90)
EXPONENTIAL = SERIES.format(matrix="SELECT net_id, i, j, 1.0::DOUBLE AS x FROM gt", by="(n + 1)", terms=45)
_kernel("delta_con", AFFINITY + " SELECT a.net_id, round(sqrt(sum((sqrt(greatest(a.x, 0)) - sqrt(greatest(b.x, 0))) ** 2)), 6) AS value FROM sm a JOIN sm b ON b.net_id = -1 AND a.i = b.i AND a.j = b.j WHERE a.net_id >= 0 GROUP BY ALL", True, 6)
_kernel("communicability_corr", EXPONENTIAL + " SELECT a.net_id, round(corr(a.x, b.x), 6) AS value FROM sm a JOIN sm b ON b.net_id = -1 AND a.i = b.i AND a.j = b.j WHERE a.net_id >= 0 GROUP BY ALL", True, 6)
_kernel("communicability_jsd", EXPONENTIAL + """, pm AS (SELECT net_id, i, j, x / sum(x) OVER (PARTITION BY net_id) AS p FROM sm)
SELECT a.net_id, round(sum(a.p * log2(2 * a.p / (a.p + b.p)) + b.p * log2(2 * b.p / (a.p + b.p))) / 2, 6) AS value FROM pm a JOIN pm b ON b.net_id = -1 AND a.i = b.i AND a.j = b.j WHERE a.net_id >= 0 GROUP BY ALL""", True, 6)
BOTH = ", two AS (SELECT * FROM gt)" + _CLUST
_kernel("net_simile", ALL + BOTH + _EGO + """,
ft AS (SELECT net_id, f, x FROM (SELECT net_id, i, d::DOUBLE AS f1, c::DOUBLE AS f2, md::DOUBLE AS f3, mc::DOUBLE AS f4, e_in::DOUBLE AS f5, e_out::DOUBLE AS f6, n2::DOUBLE AS f7 FROM ego)
       UNPIVOT (x FOR f IN (f1, f2, f3, f4, f5, f6, f7))),
mo AS (SELECT net_id, f, avg(x) AS m, median(x) AS h, stddev_pop(x) AS s FROM ft GROUP BY ALL),
sg AS (SELECT net_id, f, min(m) AS s1, min(h) AS s2, min(s) AS s3, avg(CASE WHEN s > 1e-12 THEN ((x - m) / s) ** 3 END) AS s4, avg(CASE WHEN s > 1e-12 THEN ((x - m) / s) ** 4 END) - 3 AS s5
       FROM ft JOIN mo USING (net_id, f) GROUP BY ALL),
sl AS (SELECT net_id, f, p, x FROM sg UNPIVOT INCLUDE NULLS (x FOR p IN (s1, s2, s3, s4, s5)))
SELECT a.net_id, CASE WHEN count(a.x + b.x) = 35 THEN round(sum(CASE WHEN abs(a.x) + abs(b.x) > 0 THEN abs(a.x - b.x) / (abs(a.x) + abs(b.x)) ELSE 0 END), 6) END AS value
FROM sl a JOIN sl b ON b.net_id = -1 AND a.f = b.f AND a.p = b.p WHERE a.net_id >= 0 GROUP BY ALL""", digits=6)
_kernel("resistance", ALL + """,
dg AS (SELECT net_id, i, count(*) AS d FROM gt GROUP BY ALL), cc AS (SELECT net_id, 2.0::DOUBLE * max(d) AS c FROM dg GROUP BY ALL),
mt AS (SELECT a.net_id, a.i, b.i AS j, (CASE WHEN a.i = b.i THEN a.d ELSE 0 END - (gt.i IS NOT NULL)::INT + 1 / 25.0::DOUBLE) / c AS x
       FROM dg a JOIN dg b ON a.net_id = b.net_id JOIN cc ON cc.net_id = a.net_id LEFT JOIN gt ON gt.net_id = a.net_id AND gt.i = a.i AND gt.j = b.i),
dbl(net_id, n, k, i, j, x) AS (
  SELECT net_id, 0, k, i, j, (CASE WHEN i = j THEN 1 ELSE 0 END - CASE k WHEN 'power' THEN x ELSE 0 END)::DOUBLE FROM mt, (VALUES ('power'), ('sum')) t(k)
  UNION ALL
  SELECT a.net_id, a.n + 1, a.k, a.i, b.j, sum(a.x * (b.x + CASE WHEN a.k = 'sum' AND b.i = b.j THEN 1 ELSE 0 END)) FROM dbl a JOIN dbl b ON b.k = 'power' AND a.net_id = b.net_id AND a.j = b.i
  WHERE a.n < 12 GROUP BY a.net_id, a.n, a.k, a.i, b.j),
iv AS (SELECT net_id, i, j, x / c AS x FROM dbl JOIN cc USING (net_id) WHERE n = 12 AND k = 'sum'),
dia AS (SELECT net_id, i, x FROM iv WHERE i = j),
rs AS (SELECT iv.net_id, iv.i, iv.j, a.x + b.x - 2 * iv.x AS x FROM iv JOIN dia a ON a.net_id = iv.net_id AND a.i = iv.i JOIN dia b ON b.net_id = iv.net_id AND b.i = iv.j)
SELECT a.net_id, round(sqrt(sum((a.x - b.x) ** 2)), 6) AS value FROM rs a JOIN rs b ON b.net_id = -1 AND a.i = b.i AND a.j = b.j WHERE a.net_id >= 0 GROUP BY ALL""", True, 6)
KS = PATHS + BOTH + """,
bt AS (SELECT p.net_id, v.t AS i, round(coalesce(sum(CASE WHEN p.s <> v.t AND p.t <> v.t AND p.s <> p.t AND a.d + v.d = p.d THEN a.sigma * v.sigma / p.sigma END), 0) / (24 * 23), 9) AS x
       FROM paths p JOIN paths a ON a.net_id = p.net_id AND a.s = p.s JOIN paths v ON v.net_id = p.net_id AND v.s = p.t AND v.t = a.t GROUP BY ALL),
vl AS (SELECT net_id, 'degree' AS f, d::DOUBLE AS x FROM clu UNION ALL SELECT net_id, 'clustering', round(c, 9)::DOUBLE FROM clu UNION ALL SELECT net_id, 'betweenness', x FROM bt
       UNION ALL SELECT net_id, 'length', round(dist, 9) FROM g JOIN geo USING (u, v)),
sm AS (SELECT net_id, true AS own, f, x FROM vl WHERE net_id >= 0 UNION ALL SELECT nets.net_id, false, f, x FROM nets, vl WHERE vl.net_id = -1),
pt AS (SELECT DISTINCT net_id, f, x FROM sm),
df AS (SELECT pt.net_id, pt.f, pt.x, abs(avg(CASE WHEN own THEN (sm.x <= pt.x)::INT END) - avg(CASE WHEN NOT own THEN (sm.x <= pt.x)::INT END)) AS d FROM pt JOIN sm ON sm.net_id = pt.net_id AND sm.f = pt.f GROUP BY ALL),
ks AS (SELECT net_id, f, max(d) AS d FROM df GROUP BY ALL)"""
_kernel("energy", KS + " SELECT net_id, round(max(d), 7) AS value FROM ks GROUP BY net_id", True)


@query("ks_components", KS + """ SELECT net_id, round(max(d) FILTER (f = 'degree'), 7) AS ks_degree, round(max(d) FILTER (f = 'clustering'), 7) AS ks_clustering,
round(max(d) FILTER (f = 'betweenness'), 7) AS ks_betweenness, round(max(d) FILTER (f = 'length'), 7) AS ks_edge_length FROM ks GROUP BY net_id""", True)
def ks_components(spark, sf):
    s = score(against(_nets(spark, sf), fx.reference(spark, sf)), COMPONENTS, N, _lattice())
    return s.groupBy(F.col("pair_id").alias("net_id")).pivot("measure", list(COMPONENTS)).agg(F.first(F.round("value", 7)))


for _name in ("spectral_distance_adjacency", "spectral_distance_norm_laplacian", "netrd_non_backtracking_spectral"):
    _kernel(_name)


#: Cycles, complete graphs and stars of the nations and suppliers of each region, whose spectra, resistances and portraits are known
#: in closed form.
KNOWN = """,
size AS (SELECT n_regionkey::INT AS region, (count(DISTINCT n_nationkey) + count(s_suppkey))::INT AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
known AS (SELECT kind, region, n FROM size, (VALUES ('complete'), ('cycle'), ('star')) AS t(kind))"""
KINDS = ("complete", "cycle", "star")


def known(kind: str, n: int) -> sym.Graph:
    i = np.arange(n)
    u, v = {"complete": (i[:0], i[:0]), "cycle": (i, (i + 1) % n), "star": (0 * i[1:], i[1:])}[kind]
    return sym.Graph(n, u, v, missing=kind == "complete")


def _sizes(spark, sf) -> DataFrame:
    """region, n: how many nations and suppliers it has."""
    nation, supplier = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "supplier"))
    met = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").cast("int").alias("region"))
    return met.agg((F.count_distinct("n_nationkey") + F.count("s_suppkey")).cast("int").alias("n"))


def _known(spark, sf, f, ddl: str, kinds=KINDS) -> DataFrame:
    """kind, region, n and what ``f`` makes of each kind and graph whose form is known."""
    made = _sizes(spark, sf).withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))

    def run(batches):
        import pandas as pd

        for b in batches:
            names = [x.split()[0] for x in ddl.split(", ")]
            rows = [(kind, region, n, *f(kind, known(kind, n))) for kind, region, n in zip(b["kind"], b["region"], b["n"])]
            yield pd.DataFrame(rows, columns=["kind", "region", "n", *names])

    return made.select("kind", "region", "n").repartition("kind", "region").mapInPandas(run, f"kind string, region int, n int, {ddl}")


@query("resistance_closed_form", KNOWN + """ SELECT kind, region, n, round(CASE kind WHEN 'complete' THEN n - 1 WHEN 'cycle' THEN n * (n * n - 1) / 12.0 ELSE (n - 1) ** 2 END::DOUBLE, 4) AS total FROM known""")
def resistance_closed_form(spark, sf):
    return _known(spark, sf, lambda _, g: [sym.total_resistance(g)], "total double").withColumn("total", F.round("total", 4))


#: Spectra of the known graphs with a path-free partner of their size: another star, cycle or complete graph.
SPECTRA = KNOWN + """,
idx AS (SELECT kind, region, n, unnest(range(n)) AS i FROM known),
adj AS (SELECT kind, region, n, i, CASE kind WHEN 'complete' THEN CASE WHEN i = 0 THEN n - 1.0 ELSE -1.0 END
               WHEN 'cycle' THEN 2 * cos(2 * pi() * i / n) ELSE CASE i WHEN 0 THEN sqrt(n - 1.0) WHEN 1 THEN -sqrt(n - 1.0) ELSE 0.0 END END::DOUBLE AS x FROM idx),
kept AS (SELECT kind, region, n, x FROM adj QUALIFY row_number() OVER (PARTITION BY kind, region ORDER BY round(abs(x), 9) DESC, x) <= least(50, n - 2)),
a_at AS (SELECT kind, region, n, x, row_number() OVER (PARTITION BY kind, region ORDER BY x DESC) AS pos FROM kept),
lap AS (SELECT kind, region, n, CASE kind WHEN 'complete' THEN CASE WHEN i = 0 THEN 0.0 ELSE n / (n - 1.0) END
               WHEN 'cycle' THEN 1 - cos(2 * pi() * i / n) ELSE CASE i WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 ELSE 1.0 END END::DOUBLE AS x FROM idx),
l_at AS (SELECT kind, region, n, x, row_number() OVER (PARTITION BY kind, region ORDER BY x) AS pos FROM lap QUALIFY pos <= 50),
pair AS (SELECT * FROM (VALUES ('complete', 'cycle'), ('cycle', 'star'), ('star', 'complete')) AS t(kind, other)),
dl AS (SELECT p.kind, p.other, x.region, x.n, sqrt(sum((x.x - y.x) ** 2)) AS d FROM pair p JOIN l_at x ON x.kind = p.kind JOIN l_at y ON y.kind = p.other AND y.region = x.region AND y.pos = x.pos GROUP BY ALL),
ah AS (SELECT kind, region, n, max(x) AS largest, sqrt(sum(x * x)) AS long FROM a_at GROUP BY ALL)"""


@query("spectral_closed_form", SPECTRA + " SELECT dl.kind, dl.other, dl.region, dl.n, round(dl.d, 6) AS laplacian, round(ah.largest, 6) AS largest, round(ah.long, 6) AS length FROM dl JOIN ah USING (kind, region)")
def spectral_closed_form(spark, sf):
    """The Laplacian distance between graphs with known spectra, and of the adjacency values that are kept the largest and their length."""

    def f(kind, g):
        other = KINDS[(KINDS.index(kind) + 1) % 3]
        x = sym.adjacency_spectrum(g)
        apart = np.linalg.norm(sym.laplacian_spectrum(g) - sym.laplacian_spectrum(known(other, g.n)))
        return other, float(apart), float(x[0]), float(np.sqrt((x * x).sum()))

    out = _known(spark, sf, f, "other string, laplacian double, largest double, length double")
    return out.select("kind", "other", "region", "n", *[F.round(c, 6).alias(c) for c in ("laplacian", "largest", "length")])


@query("non_backtracking_closed_form", KNOWN + " SELECT region, n, (n - 2)::DOUBLE AS largest, 0.5::DOUBLE AS shared, round(sqrt(n - 2.0), 6)::DOUBLE AS modulus FROM size")
def non_backtracking_closed_form(spark, sf):
    """Of complete graphs: the leading value n - 2, then n - 1 conjugate pairs with real part -1/2 and modulus sqrt(n - 2)."""

    def f(_, g):
        z = sym.non_backtracking_points(g)
        rest = z[:-1][np.abs(z[:-1].imag) > 1e-6]
        return float(z[-1].real), float(-rest.real.mean()), float(np.abs(rest).mean())

    out = _known(spark, sf, f, "largest double, shared double, modulus double", ("complete",))
    return out.select("region", "n", *[F.round(c, 6).alias(c) for c in ("largest", "shared", "modulus")])


@query("spectrum_adjacency_moments", CLUST + ", e AS (SELECT net_id, count(*) AS m FROM edges GROUP BY ALL) SELECT e.net_id, (2 * m)::DOUBLE AS second, (2 * sum(t))::DOUBLE AS third FROM e JOIN clu USING (net_id) GROUP BY ALL")
def spectrum_adjacency_moments(spark, sf):
    f = lambda a: [[(np.linalg.eigvalsh(a) ** p).sum() for p in (2, 3)]]
    return _features(spark, sf, f, "second double, third double", ["second", "third"]).select("net_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("second", "third")])


@query("spectrum_nlap_moments", CLUST + " SELECT two.net_id, 25.0::DOUBLE AS first, round(25 + sum(1.0::DOUBLE / (a.d * b.d)), 6) AS second FROM two JOIN deg a ON a.net_id = two.net_id AND a.i = two.i JOIN deg b ON b.net_id = two.net_id AND b.i = two.j GROUP BY ALL")
def spectrum_nlap_moments(spark, sf):
    f = lambda a: [[(np.linalg.eigvalsh(k.normalised_laplacian(a)) ** p).sum() for p in (1, 2)]]
    return _features(spark, sf, f, "first double, second double", ["first", "second"]).select("net_id", *[F.round(c, 6).alias(c) for c in ("first", "second")])


@query("spectrum_nb_moments", CLUST + ", e AS (SELECT net_id, count(*) AS m FROM edges GROUP BY ALL) SELECT e.net_id, (50 - 2 * m)::DOUBLE AS second, (2 * sum(t))::DOUBLE AS third FROM e JOIN clu USING (net_id) GROUP BY ALL")
def spectrum_nb_moments(spark, sf):
    f = lambda a: [[(np.linalg.eigvals(k.reduced_non_backtracking(a)) ** p).sum().real for p in (2, 3)]]
    return _features(spark, sf, f, "second double, third double", ["second", "third"]).select("net_id", F.round("second", 5).alias("second"), (F.round("third", 5) + 0.0).alias("third"))


@query("landscape_cells", LAND + " SELECT measure, eta::INT AS eta, gamma::INT AS gamma, cell_mean FROM cell")
def landscape_cells(spark, sf):
    return r.cells(_land(spark, sf), 9)


@query("best_cell", LAND + " SELECT measure, eta::INT AS best_eta, gamma::INT AS best_gamma FROM cell QUALIFY row_number() OVER (PARTITION BY measure ORDER BY cell_mean, eta, gamma) = 1")
def best_cell(spark, sf):
    return r.best_cell(_land(spark, sf), 9)


TOP = LAND + ", top AS (SELECT * FROM cell QUALIFY row_number() OVER (PARTITION BY measure ORDER BY cell_mean, eta, gamma) <= {})"


@query("eta_positive", TOP.format(30) + " SELECT measure, count(*) FILTER (eta > 0) AS eta_positive FROM top GROUP BY ALL")
def eta_positive(spark, sf):
    return r.eta_positive(_land(spark, sf), 30, 9)


@query("total_variation", TOP.format(10) + " SELECT measure, round(var_pop((eta + 3) / 5.0::DOUBLE) + var_pop(gamma / 11.0::DOUBLE), 9) AS total_variation FROM top GROUP BY ALL")
def total_variation(spark, sf):
    return r.total_variation(_land(spark, sf), 10, (-3.0, 2.0), (0.0, 11.0), 9).withColumn("total_variation", F.round("total_variation", 9))


BEST = LAND + ", bn AS (SELECT measure, net_id FROM ori QUALIFY row_number() OVER (PARTITION BY measure ORDER BY o NULLS LAST, net_id) <= 20)"


@query("connection_length", BEST + " SELECT measure, round(avg(dist), 6) AS connection_length_mm, round(100 * avg((dist > 90)::INT), 6) AS percent_beyond FROM bn JOIN edges USING (net_id) JOIN geo USING (u, v) GROUP BY ALL")
def connection_length(spark, sf):
    c = r.connection_length(_land(spark, sf), _nets(spark, sf), fx.geometry(spark), 20, SMALL.long_mm)
    return c.select("measure", *[F.round(x, 6).alias(x) for x in ("connection_length_mm", "percent_beyond")])


@query("degree_sd", BEST + """, two AS (SELECT net_id, u AS i FROM edges UNION ALL SELECT net_id, v FROM edges), deg AS (SELECT net_id, i, count(*) AS d FROM two GROUP BY ALL),
sd AS (SELECT net_id, sqrt(sum(d * d) / 25.0::DOUBLE - (sum(d) / 25.0::DOUBLE) ** 2) AS s FROM deg GROUP BY ALL) SELECT measure, round(avg(s), 7) AS degree_sd FROM bn JOIN sd USING (net_id) GROUP BY ALL""")
def degree_sd(spark, sf):
    return r.degree_sd(_land(spark, sf), _nets(spark, sf), 20, N).withColumn("degree_sd", F.round("degree_sd", 7))


@query("isnr", LAND + ", c AS (SELECT measure, eta, gamma, avg(value) AS m, var_samp(value) AS s FROM land GROUP BY ALL) SELECT measure, round(10 * log10(var_pop(m) / avg(s)), 6) AS isnr_db FROM c GROUP BY ALL")
def isnr(spark, sf):
    return r.isnr(_land(spark, sf)).withColumn("isnr_db", F.round("isnr_db", 6))


@query("agreement", LAND + """, c AS (SELECT a.measure, b.measure AS other, corr(a.o, b.o) AS r FROM ori a JOIN ori b USING (net_id) WHERE a.measure <> b.measure GROUP BY ALL)
SELECT measure, round(avg(r) FILTER (other IN ('frobenius', 'jaccard')), 7) AS agreement, round(max(abs(r)), 7) AS max_abs_r FROM c GROUP BY ALL""")
def agreement(spark, sf):
    a = r.agreement(_land(spark, sf), ("frobenius", "jaccard"))
    return a.select("measure", *[F.round(c, 7).alias(c) for c in ("agreement", "max_abs_r")])


SET_MEASURES = {m: MEASURES[m] for m in SETS}


def _set_values(a: str, r: str, b: str) -> str:
    """SQL for the set measures of ``m`` from the numbers of edges on both sides and of shared ones."""
    return f"""CASE m WHEN 'frobenius' THEN sqrt(2.0 * ({a} + {r} - 2 * {b})) WHEN 'hamming' THEN ({a} + {r} - 2 * {b})::DOUBLE
         WHEN 'jaccard' THEN 2.0::DOUBLE * {b} / (2.0::DOUBLE * ({a} + {r} - {b}) + 1e-10) ELSE 2.0::DOUBLE * {b} / ({a} + {r}) END"""


_MEASURES = "(VALUES ('frobenius'), ('hamming'), ('jaccard'), ('f1')) AS t(m)"


def _distances(spark, sf) -> DataFrame:
    """The set measures between all targets (return flag R) and the grid (A)."""

    def make():
        e = _nets(spark, sf)
        side = lambda rep: e.filter(F.col("rep") == rep).drop("rep")
        return written(x.recovery_distances(x.Recovery(side("R"), side("A")), SET_MEASURES, SMALL), "distances")

    return fx.kept(spark, sf, "distances", make)


RECOVER = f""",
sz AS (SELECT net_id, eta, gamma, rep, count(*) AS n FROM edges GROUP BY ALL),
sh AS (SELECT t.net_id AS tidx, g.net_id AS gidx, count(*) AS b FROM edges t JOIN edges g ON t.u = g.u AND t.v = g.v AND t.rep = 'R' AND g.rep = 'A' GROUP BY ALL),
di AS (SELECT m AS measure, t.net_id AS tidx, g.net_id AS gidx, t.eta AS te, t.gamma AS tg, g.eta AS ge, g.gamma AS gg, {_set_values('t.n', 'g.n', 'coalesce(b, 0)')} AS d
       FROM sz t JOIN sz g ON t.rep = 'R' AND g.rep = 'A' LEFT JOIN sh ON tidx = t.net_id AND gidx = g.net_id, {_MEASURES}),
bs AS (SELECT * FROM di QUALIFY row_number() OVER (PARTITION BY measure, tidx ORDER BY CASE WHEN measure IN ('jaccard', 'f1') THEN -d ELSE d END, gidx) = 1)"""


@query("recovery", RECOVER + " SELECT measure, round(avg(sqrt(((te - ge) ** 2 + (tg - gg) ** 2)::DOUBLE)), 7) AS error, round(corr(te, ge), 7) AS r_eta FROM bs GROUP BY ALL")
def recovery(spark, sf):
    return r.recovery(_distances(spark, sf)).select("measure", F.round("error", 7).alias("error"), F.round("r_eta", 7).alias("r_eta"))


@query("recovery_argmin", RECOVER + " SELECT measure, tidx, gidx, round(d, 9) AS distance FROM bs")
def recovery_argmin(spark, sf):
    best = r.oriented(_distances(spark, sf)).groupBy("measure", "tidx").agg(F.min(F.struct("o", "gidx", "value")).alias("b"))
    return best.select("measure", "tidx", F.col("b.gidx").alias("gidx"), F.round("b.value", 9).alias("distance"))


def _scores(spark, sf):
    return r.oriented(_land(spark, sf)).select("measure", (F.col("rep") == "R").alias("real"), (-F.col("o")).alias("score"))


@query("auc", LAND + " SELECT x.measure, round(avg(CASE WHEN x.o < y.o THEN 1.0::DOUBLE WHEN x.o = y.o THEN 0.5 ELSE 0 END), 9) AS auc FROM ori x JOIN ori y ON x.measure = y.measure AND x.rep = 'R' AND y.rep <> 'R' GROUP BY ALL")
def auc(spark, sf):
    return r.discrimination(_scores(spark, sf)).withColumn("auc", F.round("auc", 9))


@query("auc_hard", LAND + ", h AS (SELECT * FROM ori WHERE rep <> 'R' QUALIFY row_number() OVER (PARTITION BY measure ORDER BY o) <= 20) SELECT x.measure, round(avg(CASE WHEN x.o < y.o THEN 1.0::DOUBLE WHEN x.o = y.o THEN 0.5 ELSE 0 END), 9) AS auc FROM ori x JOIN h y ON x.measure = y.measure AND x.rep = 'R' GROUP BY ALL")
def auc_hard(spark, sf):
    return r.discrimination(_scores(spark, sf), 20).withColumn("auc", F.round("auc", 9))


#: Read-outs of the set measures, as (query, column, key, direction).
COMPARED = (
    ("eta_positive", "eta_positive", "eta_positive_of_100", -1), ("total_variation", "total_variation", "total_variation", -1), ("isnr", "isnr_db", "isnr_db", 1),
    ("connection_length", "connection_length_mm", "connection_length_mm", 0), ("auc", "auc", "auc", 1), ("auc_hard", "auc", "auc_hard", 1), ("noise_tolerance", "noise_tolerance", "noise_tolerance", 1),
)


def compare_rank(spark, sf):
    """The read-outs beside each other, with ranks: average ranks of ties, none without a direction or a value."""
    directions = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(key).alias("readout"), F.lit(d).alias("direction")) for _, _, key, d in COMPARED])))
    parts = [QUERIES[q](spark, sf).select(F.lit(key).alias("readout"), "measure", F.col(c).cast("double").alias("value")) for q, c, key, _ in COMPARED]
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    values = fx.kept(spark, sf, "compared", lambda: written(values.filter(F.col("measure").isin(*SETS)), "compared"))
    ranked = r.ranks(values, directions).select("readout", "measure", F.col("rank").cast("double").alias("rank"))
    return values.join(ranked, ["readout", "measure"], "left")


def _swaps_sql(name: str, seeds: str, tries: int, seed: int, whole: bool = False) -> str:
    """{name}(draw, s, lost) and {name}_e(draw, s, u, v): the reference after the swaps of ``swap_draws``, from a query of seeds (draw, s)."""
    hex_number = lambda at, n: f"('0x' || substr(md5('{seed}:' || draw || ':' || k), {at}, {n}))::BIGINT"
    reach = "list_reduce(range(25), lambda r, p: list_reduce(nat, lambda q, e: CASE WHEN ((q >> (e // 65536)) | (q >> (e % 65536))) & 1 = 1 THEN q | (1::BIGINT << (e // 65536)) | (1::BIGINT << (e % 65536)) ELSE q END, r), 1::BIGINT)"
    joined = f"AND {reach} = {2**N - 1}" if whole else ""
    return f""",
{name}_k(draw, s, k, done, es) AS (
  SELECT draw, s, 0, 0, (SELECT list(u * 65536::BIGINT + v ORDER BY u, v) FROM ref) FROM ({seeds}) z
  UNION ALL
  SELECT draw, s, k + 1, done + ok::INT, CASE WHEN ok THEN nat ELSE es END FROM (
    SELECT *, may {joined} AS ok FROM (
      SELECT *, len(list_distinct([a, b, c, d])) = 4 AND NOT list_contains(es, x) AND NOT list_contains(es, y) AS may, list_transform(es, lambda e, n: CASE n WHEN i THEN x WHEN j THEN y ELSE e END) AS nat FROM (
        SELECT *, least(a, d) * 65536 + greatest(a, d) AS x, least(c, b) * 65536 + greatest(c, b) AS y FROM (
          SELECT *, es[i] // 65536 AS a, es[i] % 65536 AS b, CASE WHEN turn THEN es[j] % 65536 ELSE es[j] // 65536 END AS c, CASE WHEN turn THEN es[j] // 65536 ELSE es[j] % 65536 END AS d FROM (
            SELECT *, {hex_number(1, 8)} % len(es) + 1 AS i, {hex_number(9, 8)} % len(es) + 1 AS j, {hex_number(17, 1)} % 2 = 1 AS turn FROM {name}_k WHERE done < s AND k < {tries} * s) z) z) z) z) z),
{name}_e AS MATERIALIZED (SELECT draw, s, (c // 65536)::INT AS u, (c % 65536)::INT AS v FROM (SELECT draw, s, unnest(es) AS c FROM {name}_k QUALIFY k = max(k) OVER (PARTITION BY draw)) z),
{name} AS MATERIALIZED (SELECT draw, s, 60 - count(ref.u) AS lost FROM {name}_e LEFT JOIN ref USING (u, v) GROUP BY ALL)"""


#: Trajectories and draws as the protocol numbers them.
_STEPS = SMALL.steps + 1
_LEVELS = ", ".join(map(str, SMALL.noise_levels))
DRAWN = _swaps_sql("sw", f"SELECT i AS draw, (i % {_STEPS} * {SMALL.edges} // {SMALL.steps})::INT AS s FROM range({SMALL.trajectories * _STEPS}) t(i)", SMALL.swap_tries, SMALL.degeneration_seed)
NOISY = _swaps_sql("ns", f"SELECT i AS draw, [{_LEVELS}][(i // {SMALL.noise_repeats} + 1)::INT] AS s FROM range({len(SMALL.noise_levels) * SMALL.noise_repeats}) t(i)", 1, SMALL.noise_seed, True)


def _draws(spark, sf) -> DataFrame:
    """draw, s, u, v of the reference on its trajectories."""
    seeds = spark.range(SMALL.trajectories * _STEPS).select(F.col("id").alias("draw"), F.floor(F.col("id") % _STEPS * SMALL.edges / SMALL.steps).cast("int").alias("s"))
    return fx.kept(spark, sf, "draws", lambda: drawn_edges(swap_draws(fx.reference(spark, sf), seeds, SMALL.swap_tries, SMALL.degeneration_seed)))


def _noisy(spark, sf) -> DataFrame:
    return fx.kept(spark, sf, "noisy", lambda: x.noise_references(fx.reference(spark, sf), SMALL))


@query("rewire_edges", DRAWN + " SELECT draw, s::INT AS s, u, v FROM sw_e", True)
def rewire_edges(spark, sf):
    return _draws(spark, sf)


@query("rewire_degree_invariant", """, i AS (SELECT u AS i FROM ref UNION ALL SELECT v FROM ref), d AS (SELECT i, count(*) AS degree FROM i GROUP BY ALL) SELECT draw, i, degree FROM d, range(260) t(draw)""")
def rewire_degree_invariant(spark, sf):
    return setops.degrees(_draws(spark, sf).withColumnRenamed("draw", "net_id")).withColumnRenamed("net_id", "draw")


@query("consensus", ", f AS (SELECT eta, gamma, u, v, count(*) AS members FROM edges WHERE rep <> 'R' GROUP BY ALL) SELECT eta::INT AS eta, gamma::INT AS gamma, u, v, members FROM f QUALIFY row_number() OVER (PARTITION BY eta, gamma ORDER BY members DESC, u, v) <= 60")
def consensus_networks(spark, sf):
    return consensus(_nets(spark, sf).filter("rep <> 'R'"), ["eta", "gamma"], SMALL.edges)


@query("rewire_connected_edges", NOISY + " SELECT draw, s::INT AS s, u, v FROM ns_e", True)
def rewire_connected_edges(spark, sf):
    """Draws whose swaps keep the reference connected, at all levels of noise."""
    return drawn_edges(_noisy(spark, sf))


@query("effective_degeneration", DRAWN + " SELECT draw, s::INT AS s, round(lost / 60.0::DOUBLE, 9) AS eff FROM sw", True)
def effective_degeneration(spark, sf):
    return lost_edges(_draws(spark, sf), fx.reference(spark, sf), SMALL.edges).withColumn("eff", F.round("eff", 9))


DEGEN = DRAWN + f""",
tr AS MATERIALIZED (SELECT draw // {_STEPS} AS process, draw % {_STEPS} AS step, m AS measure, {_set_values('60', '60', '(60 - lost)')} AS value FROM sw, {_MEASURES}),
tg AS MATERIALIZED (SELECT process, step, measure, CASE WHEN measure IN ('jaccard', 'f1') THEN 1 - g ELSE g END AS g FROM (
  SELECT *, (value - min(value) OVER (PARTITION BY measure)) / (max(value) OVER (PARTITION BY measure) - min(value) OVER (PARTITION BY measure)) AS g FROM tr) z),
st AS (SELECT measure, step, avg(p) AS y FROM (
  SELECT *, (g - min(g) OVER (PARTITION BY measure, process)) / (max(g) OVER (PARTITION BY measure, process) - min(g) OVER (PARTITION BY measure, process)) AS p FROM tg) z GROUP BY ALL),
mae AS (SELECT st.measure, round(avg(abs(st.y - h.y)), 7) AS mae FROM st JOIN st h ON h.step = st.step AND h.measure = 'hamming' GROUP BY ALL),
cv AS (SELECT measure, round(avg(c), 7) AS cv FROM (SELECT measure, step, stddev_samp(g) / nullif(avg(g), 0) AS c FROM tg GROUP BY ALL) z GROUP BY ALL)"""


@query("degeneration", DEGEN + " SELECT measure, mae, cv FROM mae JOIN cv USING (measure)", True)
def degeneration(spark, sf):
    t = fx.kept(spark, sf, "trajectories", lambda: written(x.trajectories(fx.reference(spark, sf), SET_MEASURES, SMALL), "trajectories"))
    return r.degeneration(t).select("measure", F.round("mae", 7).alias("mae"), F.round("cv", 7).alias("cv"))


NOISE = LAND + NOISY + f""",
nd AS (SELECT d.draw, d.s, e.net_id, count(*) AS b FROM edges e JOIN ns_e d USING (u, v) GROUP BY ALL),
nn AS (SELECT net_id, eta, gamma, count(*) AS n FROM edges GROUP BY ALL),
nv AS MATERIALIZED (SELECT draw, s, eta, gamma, m AS measure, CASE WHEN m IN ('jaccard', 'f1') THEN -1 ELSE 1 END * {_set_values('n', '60', 'coalesce(b, 0)')} AS o
       FROM nn CROSS JOIN ns LEFT JOIN nd USING (net_id, draw, s), {_MEASURES}),
nc AS (SELECT measure, draw, s, eta, gamma, round(avg(o), 9) AS mean FROM nv GROUP BY ALL),
nb AS (SELECT measure, draw, s, eta, gamma FROM nc QUALIFY row_number() OVER (PARTITION BY measure, draw ORDER BY mean, gamma, eta) = 1),
b0 AS (SELECT measure, eta AS e0, gamma AS g0 FROM cell QUALIFY row_number() OVER (PARTITION BY measure ORDER BY cell_mean, gamma, eta) = 1),
dr AS (SELECT measure, s, draw % {SMALL.noise_repeats} AS repeat, sqrt(((eta - e0) ** 2 + (gamma - g0) ** 2)::DOUBLE) AS drift FROM nb JOIN b0 USING (measure))"""


def _drifts(spark, sf) -> DataFrame:
    """measure, s, repeat, drift of the set measures by the protocol of noise, in grid steps."""
    make = lambda: written(x.noise_draws(_noisy(spark, sf), _nets(spark, sf), _meta(spark, sf).drop("rep"), _land(spark, sf), SET_MEASURES, set(), SMALL, digits=9), "drifts")
    return fx.kept(spark, sf, "drifts", make)


@query("noise_draws", NOISE + " SELECT measure, s::BIGINT AS s, repeat::BIGINT AS repeat, round(drift, 9) AS drift FROM dr", True)
def noise_draws(spark, sf):
    return _drifts(spark, sf).withColumn("drift", F.round("drift", 9))


TOLERANCE = NOISE + """,
lv AS (SELECT measure, s, median(drift) AS d FROM dr GROUP BY ALL),
tol AS (SELECT measure, round(coalesce((SELECT avg(lost / 60.0::DOUBLE) FROM ns WHERE ns.s = m.s), 0), 9) AS noise_tolerance
        FROM (SELECT measure, max(s) FILTER (d <= 1) AS s FROM lv GROUP BY ALL) m)"""


@query("noise_tolerance", TOLERANCE + " SELECT measure, noise_tolerance FROM tol", True)
def noise_tolerance(spark, sf):
    return r.noise_tolerance(_drifts(spark, sf), _noisy(spark, sf).select("s", "eff"), SMALL.noise_cutoff).withColumn("noise_tolerance", F.round("noise_tolerance", 9))


def _ranked_sql() -> str:
    """All read-outs of COMPARED from the SQL of their own queries, in parentheses, and the ranks."""
    one = "SELECT '{key}' AS readout, measure, {column}::DOUBLE AS value, {direction} AS direction FROM ({sql}) z{at}"
    parts = [one.format(key=key, column=c, direction=d, sql=ORACLES[q], at=i) for i, (q, c, key, d) in enumerate(COMPARED)]
    return f"""WITH vals AS ({" UNION ALL ".join(parts)})
SELECT readout, measure, value, CASE WHEN direction <> 0 AND value IS NOT NULL THEN
  (rank() OVER (PARTITION BY readout ORDER BY -direction * value) + (count(*) OVER (PARTITION BY readout, value) - 1) / 2.0::DOUBLE)::DOUBLE END AS rank FROM vals"""


QUERIES["compare_rank"] = compare_rank
ORACLES["compare_rank"] = _ranked_sql()


@query("user_measure_degree_l1", TWO + """, deg AS (SELECT net_id, i, count(*) AS d FROM two GROUP BY ALL), ri AS (SELECT u AS i FROM ref UNION ALL SELECT v FROM ref), rd AS (SELECT i, count(*) AS d FROM ri GROUP BY ALL)
SELECT net_id, sum(abs(deg.d - rd.d))::DOUBLE AS value FROM deg JOIN rd USING (i) GROUP BY ALL""")
def user_measure_degree_l1(spark, sf):
    s = score(against(_nets(spark, sf), fx.reference(spark, sf)), {"degree_l1": lambda a, b: np.abs(a.sum(1) - b.sum(1)).sum()}, N)
    return s.select(F.col("pair_id").alias("net_id"), "value")


@query("runtime_ms")
def runtime_ms(spark, sf):
    s = score(against(_nets(spark, sf), fx.reference(spark, sf)), MEASURES, N, _lattice())
    return s.groupBy("measure").agg(F.avg("ms").alias("mean_ms"), F.stddev_samp("ms").alias("sd_ms"))


from . import frame_queries  # noqa: E402, F401  registers its queries


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
