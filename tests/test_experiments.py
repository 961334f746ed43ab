import dataclasses

import numpy as np
import pytest
from graphlens.config import READOUTS, SMALL
from graphlens.functions.measures import MEASURES, NAMES
from graphlens.operators.rewire import swap_draws, swap_edges
from graphlens.operators.scoring import against, score
from graphlens.plans import experiments as x
from graphlens.plans import readouts as r
from graphlens.plans.protocol import evaluate, landscape, published_readouts
from graphlens.sources import fixture as fx
from graphlens.sources.readers import read_published
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TINY = dataclasses.replace(SMALL, trajectories=3, steps=4, noise_levels=(1, 5, 20), noise_repeats=3, noise_repeats_slow=3, slow_window=2, slow_full_until=5)


@pytest.fixture(scope="module")
def world(spark):
    e = fx.networks(spark, SF)
    meta = e.select("net_id", "eta", "gamma").distinct().cache()
    return e, meta, fx.reference(spark, SF), fx.geometry(spark)


def degrees(edges):
    return np.bincount([i for e in edges for i in e], minlength=12).tolist()


def test_swaps_keep_degrees_and_connection():
    ring = [(i, i + 1) for i in range(11)] + [(0, 11), (0, 6), (3, 9)]
    for seed in range(20):
        free = swap_edges(ring, 10, 1000, 5, seed)
        whole = swap_edges(ring, 10, 30, 5, seed, 12)
        assert degrees(free) == degrees(whole) == degrees(ring) and len(free) == len(whole) == len(ring)
        seen, todo = {0}, [0]
        while todo:
            i = todo.pop()
            for e in whole:
                if i in e and (j := e[0] + e[1] - i) not in seen:
                    seen.add(j)
                    todo.append(j)
        assert len(seen) == 12
    assert swap_edges(ring, 0, 10, 0, 0) == set(ring)
    assert swap_edges([(0, 1)], 5, 10, 0, 0) == {(0, 1)}
    assert swap_edges([(0, 1), (0, 2), (1, 2)], 5, 50, 0, 0) == {(0, 1), (0, 2), (1, 2)}


def test_draws_depend_on_their_number_alone(spark, world):
    seeds = spark.range(6).select(F.col("id").alias("draw"), F.lit(15).alias("s"))
    a, b = (sorted(map(tuple, swap_draws(world[2], s, 20, 7).select("draw", "code", "lost").collect())) for s in (seeds, seeds.repartition(5).filter("draw > 2")))
    assert a[3:] == b and all(0 < lost <= 30 for _, _, lost in a)


def test_trajectories_start_at_the_reference(spark, world):
    t = x.trajectories(world[2], {"hamming": MEASURES["hamming"]}, TINY).collect()
    assert len(t) == 15
    assert {row["value"] for row in t if row["step"] == 0} == {0.0}
    assert all(row["value"] > 0 for row in t if row["step"] == 4) and {row["rewire_fraction"] for row in t} == {0, 0.25, 0.5, 0.75, 1}
    out = {row["measure"]: row["mae"] for row in r.degeneration(x.trajectories(world[2], {"hamming": MEASURES["hamming"], "f1": MEASURES["f1"]}, TINY)).collect()}
    assert out["hamming"] == 0 and out["f1"] < 0.05


def drift_by_hand(world, refs, measure, window=None, full_until=0):
    """The noise protocol of one distance in plain loops."""
    at = {row["net_id"]: (row["i_gamma"], row["i_eta"]) for row in x.grid_index(world[1]).collect()}
    last = max(at.values(), key=lambda p: p[0])[0], max(p[1] for p in at.values())
    sets = {}
    for row in world[0].collect():
        sets.setdefault(row["net_id"], set()).add((row["u"], row["v"]))

    def best(ref, inside):
        cells = {}
        for n, s in sets.items():
            if inside(at[n]):
                cells.setdefault(at[n], []).append(measure(s, ref))
        return min((round(sum(v) / len(v), 9), c) for c, v in cells.items())[1]

    zero = best({(row["u"], row["v"]) for row in world[2].collect()}, lambda p: True)
    out = {}
    for row in refs.collect():
        ref = {(c // 65536, c % 65536) for c in row["code"]}
        near = lambda p: window is None or all(abs(a - b) <= window for a, b in zip(p, zero))
        c = best(ref, near)
        edge = window is not None and any((a == z - window and z - window > 0) or (a == z + window and z + window < m) for a, z, m in zip(c, zero, last))
        if edge and row["s"] <= full_until:
            c, edge = best(ref, lambda p: True), False
        out[row["s"], row["repeat"]] = 10.0 if edge else float(np.hypot(c[0] - zero[0], c[1] - zero[1]))
    return out


@pytest.mark.parametrize("slow", [False, True])
@pytest.mark.parametrize("window", [0, 2])
def test_noise_draws_follow_the_protocol(spark, world, slow, window):
    e, meta, ref, _ = world
    p = dataclasses.replace(TINY, slow_window=window)
    refs = x.noise_references(ref, p).cache()
    one = {"hamming": MEASURES["hamming"]}
    got = x.noise_draws(refs, e, meta, landscape(e, meta, ref, one, p.nodes), one, {"hamming"} if slow else set(), p)
    want = drift_by_hand(world, refs, lambda a, b: len(a ^ b), window if slow else None, p.slow_full_until)
    assert {(row["s"], row["repeat"]): row["drift"] for row in got.collect()} == pytest.approx(want)


def test_recovery_meets_every_pair(spark, world):
    e = world[0]
    rec = x.Recovery(e.filter("rep = 'R' and eta = 0").drop("rep"), e.filter("rep = 'A' and eta < 0").drop("rep"))
    d = x.recovery_distances(rec, {"hamming": MEASURES["hamming"]}, TINY)
    assert d.count() == 12 * 36 and d.filter("value is null").count() == 0
    row = d.orderBy("tidx", "gidx").first()
    a, b = ({(z["u"], z["v"]) for z in e.filter(F.col("net_id") == row[c]).collect()} for c in ("tidx", "gidx"))
    assert row["value"] == len(a ^ b)


def test_evaluate_gives_every_readout_and_tables_give_them_back(spark, world, tmp_path):
    e, meta, ref, geo = world
    rec = {k: x.Recovery(e.filter("rep = 'R'").filter(cut).drop("rep"), e.filter("rep = 'A'").filter(cut).drop("rep")) for k, cut in (("wide", "gamma < 4"), ("window", "eta > 0 and gamma < 4"))}
    subjects = e.filter("rep = 'R' and gamma < 6").select("net_id", "u", "v")
    others = subjects.select("net_id").distinct().join(F.broadcast(ref))
    report = evaluate(lambda a, b: (a * b).sum(), e, meta, ref, geo, name="overlap", similarity=True, protocol=TINY, beside=("frobenius", "f1"), recoveries=rec, subjects=(subjects, others), slow={"f1"})
    rows = {(row["key"], row["measure"]): row for row in report.values.collect()}
    assert {k for k, _ in rows} == {k for k, *_ in READOUTS} and len(rows) == 3 * len(READOUTS) and {m for _, m in rows} == {"overlap", "Frobenius", "F1"}
    table = report.table.collect()
    assert [(t["key"], t["criterion"], t["readout"]) for t in table] == [(k, c, label) for k, c, label, _ in READOUTS]
    assert report.table.columns == ["key", "criterion", "readout", "direction", "overlap", "Frobenius", "F1", "rank"]
    assert all(t["rank"] == rows[t["key"], "overlap"]["rank"] and t["F1"] == rows[t["key"], "F1"]["value"] for t in table)
    assert all((row["rank"] is None) == (dict((k, d) for k, _, _, d in READOUTS)[k] == 0 or row["value"] is None) for (k, _), row in rows.items())
    sets = {}
    for row in e.collect():
        sets.setdefault(row["net_id"], set()).add((row["u"], row["v"]))
    wanted = {(row["u"], row["v"]) for row in ref.collect()}
    shared = {n: 2 * len(s & wanted) for n, s in sets.items()}
    real = [shared[row["net_id"]] for row in subjects.select("net_id").distinct().collect()]
    for name, against in (("auc", sorted(shared.values())), ("auc_hard", sorted(shared.values())[-TINY.hard_cases :])):
        wins = [(p > q) + (p == q) / 2 for p in real for q in against]
        assert rows[name, "overlap"]["value"] == pytest.approx(sum(wins) / len(wins))

    names = ("frobenius", "f1")
    land = report.landscape.filter(F.col("measure").isin(*names)).toPandas()
    land.pivot(index="net_id", columns="measure", values="value").sort_index().to_csv(tmp_path / "landscapes.csv.gz", index=False)
    land.pivot(index="net_id", columns="measure", values="ms").sort_index().to_csv(tmp_path / "timing_ms.csv", index=False)
    for key, name in (("trajectories", "degeneration"), ("draws", "noise_tolerance_draws"), ("effective", "effective_degeneration")):
        report.extras[key].toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    report.extras["aucs"].toPandas().rename(columns={"auc_hard": "auc_hardcase"}).to_csv(tmp_path / "real_vs_artificial.csv", index=False)
    grids = {}
    for key, d in report.extras["recoveries"].items():
        d.toPandas().rename(columns={"tidx": "gt_idx"}).assign(gidx=lambda t: "dist_to_grid_" + t["gidx"].astype(str)).pivot(index=["measure", "gt_idx"], columns="gidx", values="value").reset_index().to_csv(tmp_path / f"recovery_{key}.csv", index=False)
        grids[key] = (d.select("tidx", "t_eta", "t_gamma").distinct(), d.select("gidx", "g_eta", "g_gamma").distinct())
    again = published_readouts(read_published(spark, str(tmp_path), meta, grids, names), e, geo, TINY, names).collect()
    assert [row["readout"] for row in again] == [k for k, *_ in READOUTS]
    for row in again:
        if row["readout"] not in ("agreement", "max_abs_r"):  # these depend on what stands beside
            for m in names:
                assert row[m] == pytest.approx(rows[row["readout"], NAMES[m]]["value"], nan_ok=True), (row["readout"], m)

    # a new measure against the published tables: theirs are the columns beside it, and agreement is with their landscapes
    tables = read_published(spark, str(tmp_path), meta, grids, names)
    new = evaluate(lambda a, b: np.abs(a - b).sum(), e, meta, ref, geo, name="f1", criteria=("agreement", "plausibility", "efficiency"), protocol=TINY, published=tables)
    values = {(row["key"], row["measure"]): row["value"] for row in new.values.collect()}
    assert new.table.columns[4:-1] == ["f1", *NAMES.values()]
    f = dict(report.landscape.filter("measure = 'frobenius'").select("net_id", "value").collect())
    own = dict(new.landscape.select("net_id", "value").collect())
    r_of = np.corrcoef([f[n] for n in f], [own[n] for n in f])[0, 1]
    assert r_of > 0.9 and values["agreement", "f1"] == pytest.approx(r_of) and values["max_abs_r", "f1"] == pytest.approx(r_of)  # never with its own name
    for k in ("best_eta", "best_gamma", "eta_positive_of_20", "total_variation", "degree_sd"):
        assert values[k, "F1"] == pytest.approx(next(row["f1"] for row in again if row["readout"] == k))
    first = {c: (row["best_eta"], row["best_gamma"]) for c, row in zip(("hamming",), r.best_cell(landscape(e, meta, ref, {"hamming": MEASURES["hamming"]}, 25)).collect())}["hamming"]
    assert (values["best_eta", "f1"], values["best_gamma", "f1"]) == first  # a distance, whatever it is called
    with pytest.raises(ValueError, match="nodes"):
        evaluate(MEASURES["f1"], e, meta, ref, geo, similarity=True, protocol=dataclasses.replace(TINY, nodes=20))


def test_accuracy_alone_needs_no_landscape(spark, world):
    e, meta, ref, geo = world
    rec = {"wide": x.Recovery(e.filter("rep = 'R' and gamma = 0").drop("rep"), e.filter("rep = 'A' and gamma < 2").drop("rep"))}
    report = evaluate(MEASURES["hamming"], e, meta, ref, geo, criteria=("accuracy",), protocol=TINY, beside=(), recoveries=rec)
    assert report.landscape is None and {row["key"] for row in report.values.collect()} == {"recovery_wide", "r_eta_wide"}
    with pytest.warns(UserWarning, match="no value"):
        evaluate(lambda a, b: float("nan"), e, meta, ref, geo, name="none", criteria=("efficiency",), protocol=TINY, beside=())
    keyed = score(against(e, ref).select(F.col("pair_id").alias("k"), F.lit(1).alias("j"), "a", "b"), {"f1": MEASURES["f1"]}, 25, keys=("j", "k"))
    assert keyed.columns == ["j", "k", "measure", "value", "ms"]
