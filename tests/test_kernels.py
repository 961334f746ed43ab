import itertools

import numpy as np
import pytest
from graphlens.functions import kernels as k
from graphlens.functions.measures import MEASURES, NAMES, SELECTED, SIMILARITIES


def graph(n, edges):
    a = np.zeros((n, n))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    return a


complete = lambda n: np.ones((n, n)) - np.eye(n)
cycle = lambda n: graph(n, [(i, (i + 1) % n) for i in range(n)])
star = lambda n: graph(n, [(0, i) for i in range(1, n)])
path = lambda n: graph(n, [(i, i + 1) for i in range(n - 1)])
GEO = np.abs(np.subtract.outer(np.arange(12.0), np.arange(12.0)))


def random_graph(seed, n=12):
    rng = np.random.default_rng(seed)
    return graph(n, [(i, (i + 1) % n) for i in range(n)] + [e for e in itertools.combinations(range(n), 2) if rng.random() < 0.35])


def call(name, a, b):
    return MEASURES[name](a, b, GEO) if name == "energy" else MEASURES[name](a, b)


def test_registry():
    assert len(MEASURES) == 16 and MEASURES.keys() == NAMES.keys() and len(SIMILARITIES) == 5 and len(SELECTED) == 8


@pytest.mark.parametrize("name", MEASURES)
def test_identity_and_symmetry(name):
    a, b = random_graph(1), random_graph(2)
    assert call(name, a, a) == pytest.approx(1 if name in SIMILARITIES else 0, abs=1e-6)
    assert call(name, a, b) == pytest.approx(call(name, b, a), rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("name", ["spectral_distance_adjacency", "spectral_distance_norm_laplacian", "netrd_non_backtracking_spectral", "portrait", "net_simile"])
def test_labels_do_not_matter(name):
    a, b, p = random_graph(3), random_graph(4), np.random.default_rng(0).permutation(12)
    assert call(name, a[np.ix_(p, p)], b) == pytest.approx(call(name, a, b), rel=1e-6)


def test_closed_forms():
    assert k.hamming(complete(5), cycle(5)) == 5 and k.frobenius(complete(5), cycle(5)) == pytest.approx(np.sqrt(10))
    assert k.jaccard(np.zeros((4, 4)), np.zeros((4, 4))) == 0 and k.f1(np.zeros((4, 4)), complete(4)) == 0
    assert k.mutual_information(np.zeros((4, 4)), complete(4)) == pytest.approx(1)
    assert k.portrait(star(5)) == {(0, 1): 5, (1, 1): 4, (1, 4): 1, (2, 3): 4}
    assert k.betweenness(star(5)).tolist() == [1, 0, 0, 0, 0]
    assert k.clustering(complete(4)).tolist() == [1, 1, 1, 1]
    assert k.resistances(path(4))[0, 3] == pytest.approx(3) and k.resistances(complete(4))[0, 1] == pytest.approx(0.5)
    assert np.sort(np.linalg.eigvalsh(k.normalised_laplacian(complete(4)))) == pytest.approx([0, 4 / 3, 4 / 3, 4 / 3])
    assert k.exponential(np.zeros((3, 3))) == pytest.approx(np.eye(3))
    assert k.node_features(star(4))[:, 0].tolist() == [3, 0, 1, 0, 3, 0, 0]


def test_undefined():
    two = np.kron(np.eye(2), complete(3))
    with pytest.raises(ValueError):
        k.resistances(two)
    with pytest.raises(ValueError):
        k.non_backtracking_points(path(6))
    with pytest.raises(ValueError):
        k.ks(np.array([]), np.array([1.0]))
    assert np.isnan(k.net_simile(cycle(6), random_graph(1)))


def test_earth_mover_against_all_assignments():
    rng = np.random.default_rng(5)
    for n in (1, 2, 4, 5):
        x, y = rng.normal(size=n) + 1j * rng.normal(size=n), rng.normal(size=n) + 1j * rng.normal(size=n)
        best = min(sum(abs(x[i] - y[j]) for i, j in enumerate(p)) for p in itertools.permutations(range(n))) / n
        assert k.earth_mover(x, y) == pytest.approx(best)
    x, y = rng.normal(size=2) + 0j, rng.normal(size=3) + 0j
    assert k.earth_mover(x, y) == pytest.approx(k.earth_mover(np.repeat(x, 3), np.repeat(y, 2)))


def test_series_agree():
    a = random_graph(6)
    e = np.eye(12)
    total, term = e.copy(), e.copy()
    for i in range(1, 60):
        term = term @ a / i
        total += term
    assert k.exponential(a) == pytest.approx(total)
    d = a.sum(1)
    eps = 1 / (1 + d.max())
    m, total, term = eps * a - eps * eps * np.diag(d), e.copy(), e.copy()
    for _ in range(200):
        term = term @ m
        total += term
    assert k.affinity(a) == pytest.approx(total)


def test_features_are_made_once_and_values_stay(monkeypatch):
    """What a split measure remembers of a network gives the values and about the times of whole calls."""
    from graphlens.operators.scoring import Remembered, needs

    made = []
    held = Remembered(3)
    for i in (1, 2, 1, 3, 1, 4, 2, 1):
        assert held.get(i, lambda i=i: made.append(i) or i * i)[0] == i * i
    assert made == [1, 2, 3, 4, 2]
    assert needs(k.energy) == ("geometry",) and "geometry" not in needs(k.delta_con) and "geometry" in needs(lambda a, b, geometry: 0)
    a, b, d = random_graph(1), random_graph(2), np.abs(np.subtract.outer(np.arange(len(random_graph(1))), np.arange(len(random_graph(1))))).astype(float)
    assert k.energy(a, b, geometry=d) == max(f(a, b, geometry=d) for f in k.KS.values())
    for f in (k.spectral_adjacency, k.delta_con, k.resistance, k.net_simile):
        assert f(a, b) == f.between(f.features(a), f.features(b)) == pytest.approx(f(b, a))
