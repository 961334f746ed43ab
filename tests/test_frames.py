"""Graph algorithms as joins: against the dense kernels, on odd graphs, and on networks that no dense kernel holds."""

import numpy as np
import pytest
from graphlens.functions import kernels as k
from graphlens.operators import frames, series
from pyspark.sql import functions as F

EDGES = "net_id long, u int, v int"


def graph(n, edges):
    a = np.zeros((n, n))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    return a


def random_graphs(count, n, m, seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for g in range(count):
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        out[g] = [pairs[p] for p in rng.choice(len(pairs), m, replace=False)]
    return out


@pytest.fixture(scope="module")
def nets():
    #: a path, a star, two triangles that do not meet, a lone edge, a cycle with a tail, and random graphs that may fall apart
    odd = {100: [(i, i + 1) for i in range(8)], 101: [(0, i) for i in range(1, 9)], 102: [(0, 1), (1, 2), (0, 2), (5, 6), (6, 8), (5, 8)], 103: [(2, 7)], 104: [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (4, 8)]}
    return random_graphs(4, 9, 11) | odd


@pytest.fixture(scope="module")
def edges(spark, nets):
    return spark.createDataFrame([(g, u, v) for g, e in nets.items() for u, v in e], EDGES).cache()


@pytest.fixture(scope="module")
def nodes(edges):
    return edges.select("net_id").distinct().select("net_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).cache()


def test_search_portrait_and_betweenness(nets, edges, nodes):
    levels = frames.search(edges, nodes=nodes)
    found = {(r["net_id"], r["s"], r["t"]): (r["d"], r["sigma"]) for r in frames.distances(levels).collect()}
    hist = {(r["net_id"], r["l"], r["k"]): r["nodes"] for r in frames.portrait(levels).collect()}
    between = {(r["net_id"], r["i"]): r["betweenness"] for r in frames.betweenness(edges, nodes=nodes).collect()}
    for g, e in nets.items():
        dist, sigma = k.paths(graph(9, e))
        assert {(s, t): v for (x, s, t), v in found.items() if x == g} == {(s, t): (dist[s, t], sigma[s, t]) for s in range(9) for t in range(9) if np.isfinite(dist[s, t])}
        assert {(l, n): c for (x, l, n), c in hist.items() if x == g} == k.portrait(graph(9, e))
        assert np.allclose([between[g, i] for i in range(9)], k.betweenness(graph(9, e)), atol=1e-12)


def test_search_from_some_sources(spark, nets, edges):
    one = frames.distances(frames.search(edges, spark.createDataFrame([(100, 0)], "net_id long, i int"))).collect()
    assert {(r["t"], r["d"]) for r in one} == {(i, i) for i in range(9)}
    empty = edges.filter("false")
    assert frames.distances(frames.search(empty)).count() == 0 and frames.betweenness(empty).count() == 0


@pytest.mark.parametrize("least", [2, 3])
def test_cores(nets, edges, least):
    got = {r["net_id"]: (r["core_nodes"], r["core_edges"]) for r in frames.core_sizes(edges, least).collect()}
    for g, e in nets.items():
        left = {tuple(x) for x in e}
        while left and (low := {i for i in range(9) if 0 < sum(i in x for x in left) < least}):
            left = {x for x in left if not low & set(x)}
        assert got[g] == (len({i for x in left for i in x}), len(left))
        if least == 2:
            assert got[g][0] == len(k.two_core(graph(9, e)))
    assert 0 in {n for n, _ in got.values()}


def test_components_of_all_networks_at_once(spark, nets, edges, nodes):
    got = {(r["net_id"], r["i"]): r["component"] for r in frames.components(edges, nodes).collect()}
    for g, e in nets.items():
        dist, _ = k.paths(graph(9, e))
        assert [got[g, i] for i in range(9)] == [int(np.flatnonzero(np.isfinite(dist[i])).min()) for i in range(9)]
    whole = {r["net_id"]: r["connected"] for r in frames.connected(edges, nodes).collect()}
    assert whole[100] and whole[101] and not whole[102] and not whole[103]
    # a long path needs few rounds, and a hub is one label
    far = spark.range(3000).select(F.lit(1).cast("long").alias("net_id"), F.col("id").cast("int").alias("u"), (F.col("id") + 1).cast("int").alias("v"))
    hub = spark.range(1, 2000).select(F.lit(2).cast("long").alias("net_id"), F.lit(0).alias("u"), F.col("id").cast("int").alias("v"))
    assert {(r["net_id"], r["component"], r["count"]) for r in frames.components(far.unionByName(hub)).groupBy("net_id", "component").count().collect()} == {(1, 0, 3001), (2, 0, 2000)}


def test_a_network_that_no_dense_kernel_holds(spark):
    """100,000 nodes in rings of five with a tail: paths, betweenness and core by joins."""
    ring = spark.range(20_000).select(F.lit(7).cast("long").alias("net_id"), F.explode(F.array(*[F.struct((F.col("id") * 6 + a).cast("int").alias("u"), (F.col("id") * 6 + b).cast("int").alias("v")) for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (4, 5))])).alias("e")).select("net_id", "e.u", "e.v")
    small = graph(6, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (4, 5)])
    want = {(7, l, n): 20_000 * c for (l, n), c in k.portrait(small).items()}
    assert {(r["net_id"], r["l"], r["k"]): r["nodes"] for r in frames.portrait(frames.search(ring)).collect()} == want
    got = frames.betweenness(ring).groupBy((F.col("i") % 6).alias("i")).agg(F.min("betweenness").alias("lo"), F.max("betweenness").alias("hi")).orderBy("i").collect()
    scale = 5 * 4 / (119_999 * 119_998)
    assert np.allclose([[r["lo"], r["hi"]] for r in got], (k.betweenness(small) * scale)[:, None], rtol=1e-9)
    assert frames.core_sizes(ring).first()[1:] == (100_000, 100_000)


def test_series_against_dense_kernels(spark, nets, edges, nodes):
    e = {(r["net_id"], r["i"], r["j"]): r["x"] for r in series.exponential(edges, nodes).collect()}
    f = {(r["net_id"], r["i"], r["j"]): r["x"] for r in series.affinity(edges, nodes).collect()}
    for g, own in nets.items():
        a = graph(9, own)
        for got, want in ((e, k.exponential(a)), (f, k.affinity(a))):
            made = np.array([[got.get((g, i, j), 0.0) for j in range(9)] for i in range(9)])
            assert np.abs(made - want).max() < 1e-9 * max(1, np.abs(want).max())
    one = spark.range(9).select(F.col("id").cast("int").alias("i"))
    ref = spark.createDataFrame(nets[0], "u int, v int")
    con = {r["net_id"]: r["value"] for r in series.delta_con(edges, ref, nodes, one).collect()}
    corr = {r["net_id"]: r["value"] for r in series.communicability_correlation(edges, ref, nodes, one).collect()}
    for g, own in nets.items():
        a, b = graph(9, own), graph(9, nets[0])
        assert con[g] == pytest.approx(k.delta_con(a, b), abs=1e-7) and corr[g] == pytest.approx(k.communicability_correlation(a, b), abs=1e-9)


def test_terms_of_the_exponential_are_enough():
    for norm in (0.3, 0.9, 2.0):
        for tolerance in (1e-3, 1e-12):
            n = series.exponential_terms(norm, tolerance)
            rest = np.exp(norm) - sum(norm**i / np.prod(np.arange(1, i + 1), dtype=float) for i in range(n + 1))
            assert rest <= tolerance * 1.01
