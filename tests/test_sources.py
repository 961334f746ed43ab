"""Checked archives, kept tables, weighted networks, default distances, ranks by ranges."""

import hashlib
import io
import os
import zipfile

import numpy as np
import pytest
from graphlens.functions import kernels as k
from graphlens.operators import setops
from graphlens.operators.scoring import against, score
from graphlens.plans import readouts as r
from graphlens.sources.archives import read_archive, remembered
from pyspark.sql import functions as F


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_archives_are_checked_before_they_are_unpacked(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.eye(3))
    members = {"data/a.csv": "s,eff\n1,0.5\n", "data/": "", "data/empty.txt": "", "b.npy": buffer.getvalue()}
    digest = archive(tmp_path / "good.zip", members)
    found = {x["name"]: bytes(x["content"]) for x in read_archive(spark, str(tmp_path / "good.zip"), digest.upper()).collect()}
    assert set(found) == {"data/a.csv", "data/empty.txt", "b.npy"} and found["data/a.csv"].startswith(b"s,eff") and (np.load(io.BytesIO(found["b.npy"])) == np.eye(3)).all()
    other = archive(tmp_path / "other.zip", {"x": "1"})
    both = read_archive(spark, str(tmp_path / "*.zip"), {"good.zip": digest, "other.zip": other})
    assert {(x["archive"], x["name"]) for x in both.select("archive", "name").collect()} == {("good.zip", n) for n in found} | {("other.zip", "x")}
    for wrong in ("0" * 64, {"good.zip": digest}, {"good.zip": digest, "other.zip": digest}):
        with pytest.raises(ValueError, match="SHA-256"):
            read_archive(spark, str(tmp_path / "*.zip"), wrong)
    with pytest.raises(FileNotFoundError):
        read_archive(spark, str(tmp_path / "none.zip"), digest)


def test_tables_are_kept_while_their_source_is_unchanged(spark, tmp_path):
    reads = []

    def read(spark, path):
        reads.append(path)
        return spark.read.csv(path, schema="a int")

    source = tmp_path / "t.csv"
    source.write_text("1\n2\n")
    first, again = (remembered(spark, str(source), "t/1", read) for _ in range(2))
    assert sorted(x["a"] for x in again.collect()) == [1, 2] and first.count() == 2 and len(reads) == 1
    assert "parquet" in again._jdf.queryExecution().toString().lower() and "csv" not in again._jdf.queryExecution().toString().lower()
    source.write_text("1\n2\n3\n")
    os.utime(source, (1, 1))
    assert remembered(spark, str(source), "t/1", read).count() == 3 and len(reads) == 2
    assert remembered(spark, str(source), "other", read).count() == 3 and len(reads) == 3


def test_weighted_networks_against_dense_kernels(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, j) for i in range(7) for j in range(i + 1, 7)]
    values = np.array([-1, 0, 0.3, 0.5, 0.6, 1, 1.5, 2])
    nets = {n: {p: float(rng.choice(values)) for p in pairs if rng.random() < 0.7} for n in range(8)} | {20: {(0, 1): -1.0}, 21: {(0, 1): 0.0}}
    ref = {p: float(rng.choice(values)) for p in pairs if rng.random() < 0.6}

    def dense(w):
        a = np.zeros((7, 7))
        for (u, v), x in w.items():
            a[u, v] = a[v, u] = x
        return a

    e = spark.createDataFrame([(n, u, v, x) for n, w in nets.items() for (u, v), x in w.items()], "net_id long, u int, v int, w double")
    one = spark.createDataFrame([(u, v, x) for (u, v), x in ref.items()], "u int, v int, w double")
    kernels = {"frobenius": k.frobenius, "hamming": k.hamming, "jaccard": k.jaccard, "f1": k.f1, "network_mutual_information": k.mutual_information, "dc_network_mutual_information": k.degree_corrected_information}
    for name, f in kernels.items():
        got = {x["net_id"]: x[name] for x in setops.weighted_measure(name, e, one, 7).collect()}
        assert set(got) == set(nets)
        for n, w in nets.items():
            if got[n] is None:
                assert "information" in name and n in (20, 21)
            else:
                assert got[n] == pytest.approx(f(dense(w), dense(ref)), abs=1e-9), (name, n)


def test_energy_takes_the_published_distances(spark, tmp_path, monkeypatch):
    e = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (0, 2, 3), (1, 0, 3), (1, 1, 3), (1, 0, 1), (1, 2, 3)], "net_id long, u int, v int")
    ref = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3)], "u int, v int")
    d = np.abs(np.arange(4.0)[:, None] - np.arange(4.0)[None, :])
    monkeypatch.setenv("GRAPHLENS_DATA", str(tmp_path))
    with pytest.raises(FileNotFoundError, match="distances"):
        score(against(e, ref), {"energy": k.energy}, 4)
    (tmp_path / "reference").mkdir()
    np.save(tmp_path / "reference" / "distance_matrix.npy", d)
    got, want = (sorted((x["pair_id"], x["value"]) for x in score(against(e, ref), {"energy": k.energy}, 4, g).collect()) for g in (None, d))
    assert got == want and all(v is not None for _, v in got)
    a = np.zeros((4, 4))
    a[0, 1] = a[1, 0] = a[2, 3] = a[3, 2] = 1
    assert k.energy(a, a) == 0
    with pytest.raises(ValueError, match="4 nodes"):
        score(against(e, ref), {"energy": k.energy}, 9)


def test_auc_by_ranges_of_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(m, bool(real), float(s)) for m in ("a", "b") for real, s in zip(rng.random(600) < 0.3, rng.integers(0, 90, 600) if m == "a" else rng.random(600))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {x["measure"]: x["auc"] for x in r.discrimination(spark.createDataFrame(rows, "measure string, real boolean, score double").repartition(7)).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for m in "ab":
        x, y = (np.array([s for n, real, s in rows if n == m and real == side]) for side in (True, False))
        assert got[m] == pytest.approx(((x[:, None] > y).mean() + (x[:, None] == y).mean() / 2))


def test_correlation_of_exponentials():
    rng = np.random.default_rng(8)
    a, b = ((lambda x: (np.triu(x, 1) + np.triu(x, 1).T).astype(float))(rng.random((12, 12)) < 0.3) for _ in range(2))
    assert k.communicability_correlation(a, b) == pytest.approx(np.corrcoef(k.exponential(a).ravel(), k.exponential(b).ravel())[0, 1], abs=1e-12)
    assert np.isnan(k.communicability_correlation(np.zeros((1, 1)), np.zeros((1, 1))))


def test_trade_joins_are_spread_by_rows(spark, monkeypatch):
    """More lines than the session's parts hold go into as many parts as there are blocks of rows; results stay."""
    from graphlens.sources import fixture as fx

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    few = fx.trade(spark, sf)
    monkeypatch.setattr(fx, "ROWS", 100)
    many = fx.trade(spark, sf)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan(few)
    assert f", {-(-lines // 100)}), REPARTITION_BY_NUM" in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_trade_joins_keep_their_parts(spark, monkeypatch):
    """Parts of a join are not merged where the session's shuffles have as many; customers and suppliers that are many meet in parts too."""
    from graphlens.sources import fixture as fx

    monkeypatch.setattr(fx, "ROWS", 3000)
    a, b = (fx.spread(spark.range(8000).select(F.col("id").alias(n)), 8000, n) for n in "ab")
    parts = a.join(b.hint("merge"), F.col("a") == F.col("b")).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 8000 and max(r["count"] for r in parts) <= 3000
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = fx.trade(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin [l_suppkey" in plan(few) and "BroadcastHashJoin [o_custkey" in plan(few)
    monkeypatch.setattr(fx, "FEW", 0)
    monkeypatch.setattr(fx, "ROWS", 100)
    many = fx.trade(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in plan(many) and "SortMergeJoin [l_suppkey" in plan(many) and "SortMergeJoin [o_custkey" in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
