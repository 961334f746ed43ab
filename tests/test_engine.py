import hashlib
import os

import duckdb
import numpy as np
import pytest
from graphlens.config import SMALL
from graphlens.operators import setops
from graphlens.operators.rewire import drawn_edges, swap_draws
from graphlens.operators.scoring import against, score
from graphlens.functions.measures import MEASURES, NAMES, SIMILARITIES
from graphlens.plans import readouts as r
from graphlens.plans import verify
from graphlens.plans.protocol import evaluate
from graphlens.sources import fixture as fx
from graphlens.sources import readers
from graphlens.streaming import arriving
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", ["networks_edges", "m_jaccard", "m_dc_nmi", "ego_features", "agreement", "recovery", "recovery_argmin", "bitset_roundtrip", "auc", "auc_hard", "noise_draws", "core2", "network_components", "rewire_edges", "rewire_connected_edges", "degeneration", "noise_tolerance", "network_validate", "spectral_closed_form", "non_backtracking_closed_form", "resistance_closed_form", "compare_rank", "m_net_simile", "m_resistance", "m_energy"])
def test_oracles(spark, duck, name):
    from graphlens.queries import ORACLES, QUERIES

    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: (o := d[cols].astype(object).sort_values(cols)).where(o.notna(), None).values.tolist()
    assert len(got) == len(want)
    for x, y in zip(key(got), key(want)):
        assert x == pytest.approx(y, nan_ok=True) if all(not isinstance(v, str) for v in x) else x == y


def test_readers(spark, tmp_path):
    a = np.zeros((2, 10, 10), bool)
    a[0, 1, 2] = a[0, 2, 1] = a[1, 8, 9] = a[1, 9, 8] = True
    np.savez(tmp_path / "s.npz", networks=np.packbits(a, axis=-1))
    assert sorted(map(tuple, readers.read_stack(spark, str(tmp_path / "s.npz")).collect())) == [(0, 1, 2), (1, 8, 9)] == readers.edges_of(a)
    (tmp_path / "t.csv").write_text("s,eff\n1,0.5\n")
    assert readers.read_table(spark, str(tmp_path), "t", "s int, eff double").first()["eff"] == 0.5
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path), "none", "s int")
    with pytest.raises(ValueError):
        readers.read_reference(spark, np.eye(10), 10)


def test_readers_open_what_spark_opens(spark, tmp_path, monkeypatch):
    """Paths with a scheme, which only Spark's readers open; folders from the environment."""
    ref = np.zeros((6, 6))
    ref[0, 1] = ref[1, 0] = ref[2, 5] = ref[5, 2] = 1
    (tmp_path / "reference").mkdir()
    np.save(tmp_path / "reference" / "consensus.npy", ref)
    np.save(tmp_path / "d.npy", np.arange(9).reshape(3, 3))
    uri = f"file://{tmp_path}"
    monkeypatch.setenv("GRAPHLENS_HOME", uri)
    assert (readers.read_reference(spark, nodes=6) == ref).all() and readers.read_optional(spark, "individuals") is None
    assert [tuple(x) for x in readers.read_geometry(spark, f"{uri}/d.npy").orderBy("u", "v").collect()] == [(0, 1, 1.0), (0, 2, 2.0), (1, 2, 5.0)]
    with pytest.raises(FileNotFoundError, match="accuracy"):
        readers.read_reference(spark, f"{uri}/none.npy")
    nets = np.zeros((3, 6, 6), bool)
    nets[1, 0, 1] = nets[1, 1, 0] = True
    edges = spark.createDataFrame(readers.edges_of(nets) + [(0, 2, 5), (2, 3, 4)], "net_id long, u int, v int")
    values = spark.createDataFrame([(0, 2**0.5), (1, 2**0.5), (2, 6**0.5)], "net_id long, value double")
    readers.read_reference(spark, ref, 6, (edges, values))
    assert readers.matches(edges, spark.createDataFrame([(0, 1), (2, 5)], "u int, v int"), values, nodes=6).first()["matches"]
    with pytest.warns(UserWarning, match="not the one"):
        readers.read_reference(spark, ref, 6, (edges, values.withColumn("value", F.col("value") + 1)))
    (tmp_path / "n.json").write_text('{"individuals": {"mean": {"sd": 1.5}}}')
    assert readers.read_nested(spark, f"{uri}/n.json").select("individuals.mean.sd").first()[0] == 1.5
    assert readers.digests(spark, f"{uri}/n.json").first()["sha256"] == hashlib.sha256((tmp_path / "n.json").read_bytes()).hexdigest()
    monkeypatch.setenv("GRAPHLENS_DATA", "/somewhere")
    assert readers.data_dir() == "/somewhere" and readers.reference_dir() == f"{uri}/reference"


def test_recovery_sets_and_sweeps_are_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    stack = lambda *n: np.triu(rng.random((*n, 8, 8)) < 0.4, 1)
    pack = lambda a: np.packbits(a | np.swapaxes(a, -1, -2), axis=-1)
    grid, members, targets, sweep = stack(4), stack(4, 3), stack(5), stack(6)
    (tmp_path / "networks").mkdir()
    np.savez(tmp_path / "networks" / "recovery_wide.npz", grid=pack(grid), grid_members=pack(members), targets=pack(targets), grid_eta=np.arange(4.0), grid_gamma=np.ones(4), target_eta=np.arange(5.0), target_gamma=np.zeros(5))
    np.savez(tmp_path / "networks" / "morphospace.npz", networks=pack(sweep), eta=np.arange(6.0), gamma=np.ones(6), replicate=np.arange(6))
    rec = readers.read_networks(spark, f"file://{tmp_path}", "recovery_wide")
    assert {(x["net_id"], x["u"], x["v"], x["eta"]) for x in rec.grid.collect()} == {(n, u, v, float(n)) for n, u, v in readers.edges_of(grid)}
    assert {tuple(x)[:3] for x in rec.targets.select("net_id", "u", "v").collect()} == set(readers.edges_of(targets))
    assert {tuple(x) for x in readers.read_stack(spark, f"{tmp_path}/networks/recovery_wide.npz", "grid_members").collect()} == set(readers.edges_of(members.reshape(12, 8, 8)))
    edges, meta = readers.read_networks(spark, str(tmp_path))
    assert edges.count() == len(readers.edges_of(sweep)) and [tuple(x) for x in meta.orderBy("net_id").limit(2).collect()] == [(0, 0.0, 1.0, 0), (1, 1.0, 1.0, 1)]


def test_rows_of_a_split_file_keep_their_position(spark, tmp_path):
    (tmp_path / "landscapes.csv").write_text("hamming\n" + "".join(f"{'0' * (i % 40)}{i}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        table = readers.read_table(spark, f"file://{tmp_path}", "landscapes", "hamming long")
        assert table.rdd.getNumPartitions() > 5
        assert readers.with_position(table).filter("net_id <> hamming").count() == 0 and table.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_networks_are_scored_as_they_arrive(spark, tmp_path):
    e, ref = fx.networks(spark, SF).select("net_id", "u", "v"), fx.reference(spark, SF)
    for part in range(2):
        e.filter(F.col("net_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    arriving.score_arriving(stream, ref, fx.NODES, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    columns = ["net_id", "hamming", "f1"]
    want = setops.set_measures(e, ref, fx.NODES).select(columns).collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == sorted(map(tuple, want))


def test_failing_measure_gives_null(spark):
    e, ref = fx.networks(spark, SF), fx.reference(spark, SF)

    def bad(a, b):
        raise RuntimeError

    out = score(against(e, ref), {"bad": bad, "nan": lambda a, b: float("nan")}, fx.NODES)
    assert out.filter("value is not null").count() == 0 and out.count() == 432


def test_rewire_keeps_degrees_and_size(spark):
    ref = fx.reference(spark, SF)
    out = drawn_edges(swap_draws(ref, spark.createDataFrame([(0, 1), (1, 55)], "draw long, s int"), 100, 3))
    assert {x["count"] for x in out.groupBy("draw").count().collect()} == {ref.count()}
    assert out.distinct().count() == out.count()


def test_discrimination_and_noise(spark):
    s = spark.createDataFrame([("m", True, 1.0), ("m", True, 2.0), ("m", False, 1.0), ("m", False, 0.0), ("m", False, None)], "measure string, real boolean, score double")
    assert r.discrimination(s).first()["auc"] == pytest.approx(0.875)
    d = spark.createDataFrame([("m", 1, 2.0), ("m", 2, 0.5), ("m", 5, 3.0), ("n", 1, 4.0)], "measure string, s int, drift double")
    e = spark.createDataFrame([(1, 0.1), (2, 0.2), (2, 0.4), (5, 0.9)], "s int, eff double")
    assert {x["measure"]: round(x["noise_tolerance"], 9) for x in r.noise_tolerance(d, e).collect()} == {"m": 0.3, "n": 0.0}


def test_constant_landscape_has_no_correlation(spark):
    land = spark.createDataFrame([(m, i, 0, i, v) for i in range(4) for m, v in (("frobenius", 1.0), ("hamming", float(i)))], "measure string, net_id long, eta int, gamma int, value double")
    assert {x["r"] for x in r.correlations(land).collect()} == {None}


def test_evaluate(spark):
    e = fx.networks(spark, SF)
    meta = e.select("net_id", "eta", F.col("gamma")).distinct()
    report = evaluate(lambda a, b: np.abs(a.sum(1) - b.sum(1)).sum(), e, meta, fx.reference(spark, SF), fx.geometry(spark), name="degree L1", criteria=("plausibility",), protocol=SMALL, beside=("frobenius",))
    rows = report.values.collect()
    assert {x["measure"] for x in rows} == {"degree L1", "Frobenius"}
    assert all((x["rank"] is None) == (x["key"] in ("best_eta", "best_gamma", "connection_length_mm", "percent_beyond_90mm", "degree_sd")) for x in rows)
    with pytest.raises(ValueError):
        evaluate(lambda a, b: 0, e, meta, fx.reference(spark, SF), fx.geometry(spark), criteria=("speed",))


def test_measures_side_by_side(spark):
    """All measures of two pairs, one near and one far; errors against known values."""
    ring = {(i, i + 1) for i in range(11)} | {(0, 11)}
    close, far = ring | {(0, 6), (3, 9), (2, 5)}, {(0, i) for i in range(1, 12)} | {(1, 2), (3, 4), (5, 6), (7, 8)}
    base = ring | {(0, 6), (3, 9), (1, 4)}
    code = lambda edges: [u * 65536 + v for u, v in edges]
    pairs = spark.createDataFrame([(i, code(x), code(base)) for i, x in enumerate((close, far, base))], "pair_id long, a array<long>, b array<long>")
    geometry = np.abs(np.subtract.outer(np.arange(12.0), np.arange(12.0)))
    table = verify.measure_table(pairs, 12, {0: "near", 1: "far"}, geometry).cache()
    rows = {x["measure"]: x for x in table.collect()}
    assert set(rows) == set(MEASURES) and all(x["name"] == NAMES[m] and x["similarity"] == (m in SIMILARITIES) for m, x in rows.items())
    known = table.filter("near is not null and far is not null")
    assert verify.nearer(known, "near", "far").first()["holds"] and not verify.nearer(known, "far", "near").first()["holds"]
    values = spark.createDataFrame([("f1", 0, 0.5), ("f1", 1, None), ("f1", 2, 2.0), ("hamming", 0, 1.0)], "measure string, net_id long, value double")
    other = spark.createDataFrame([("f1", 0, 0.4), ("f1", 1, None), ("f1", 2, 2.0), ("hamming", 0, None)], "measure string, net_id long, value double")
    assert [tuple(x) for x in verify.errors(values, other).orderBy("measure").collect()] == [("f1", pytest.approx(0.25), 2, True, 0), ("hamming", None, 0, False, 0)]
    fewer = {x["measure"]: (x["same_nulls"], x["one_sided"]) for x in verify.errors(values, other.filter("net_id = 0")).collect()}
    assert fewer == {"f1": (False, 2), "hamming": (False, 0)}
