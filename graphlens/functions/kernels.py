"""Dense linear algebra and graph kernels in NumPy, for one pair of small graphs at a time.

Inputs are binary symmetric adjacency matrices without loops. Kernels raise ValueError where a value is not
defined; the scoring operator turns that into NULL.
"""

from __future__ import annotations

import numpy as np


def upper(a: np.ndarray) -> np.ndarray:
    return a[np.triu_indices(len(a), 1)]


def entropy(*p: float) -> float:
    x = np.array([v for v in p if v > 0], float)
    x = x / x.sum() if len(x) else x
    return float(-(x * np.log(x)).sum())


class Split:
    """A measure of two networks that compares what is computed of each alone, so that it need be computed once a network."""

    def __init__(self, name: str, features, between, needs: tuple[str, ...] = ()):
        self.__name__, self.features, self.between, self.needs = name, features, between, needs

    def __call__(self, a, b, *more, **named):
        return self.between(self.features(a, *more, **named), self.features(b, *more, **named))


def _norm(x, y):
    return float(np.linalg.norm(x - y))


def frobenius(a, b):
    x = np.subtract(a, b, dtype=float).ravel()
    return float(np.sqrt(x @ x))


def hamming(a, b):
    return float((upper(a > 0) != upper(b > 0)).sum())


def _counts(a, b):
    """Pairs of nodes joined in a, in b, in both, and all pairs."""
    x, y = upper(a) != 0, upper(b) != 0
    return int(x.sum()), int(y.sum()), int((x & y).sum()), len(x)


def jaccard(a, b):
    p, q, both, _ = _counts(a > 0.5, b > 0.5)
    return 2 * both / (2 * (p + q - both) + 1e-10)


def f1(a, b):
    p, q, both, _ = _counts(a.astype(int) == 1, b.astype(int) == 1)
    return 2 * both / (p + q) if both else 0.0


def _information(p1, p2, p12):
    h1, h2 = entropy(p1, 1 - p1), entropy(p2, 1 - p2)
    return h1, h2, h1 + h2 - entropy(p12, p1 - p12, p2 - p12, 1 - p1 - p2 + p12)


def mutual_information(a, b):
    p, q, both, of = _counts(a, b)
    h1, h2, mi = _information(p / of, q / of, both / of)
    return (2 * mi + 1e-100) / (h1 + h2 + 1e-100)


def degree_corrected_information(a, b):
    x, y, n = a != 0, b != 0, len(a)
    parts = np.array([_information(p, q, r) for p, q, r in zip(x.sum(1) / n, y.sum(1) / n, (x & y).sum(1) / n)]).sum(0)
    return float((2 * parts[2] + 1e-100) / (parts[0] + parts[1] + 1e-100))


def adjacency_spectrum(a, k=50):
    """The k eigenvalues of largest magnitude, in falling order."""
    if len(a) < 3:
        raise ValueError("too few nodes")
    return largest(np.linalg.eigvalsh(a.astype(float)), k)


def largest(values, k=50):
    """Of all eigenvalues, in rising order, the k of largest magnitude (all but two, if fewer), in falling order."""
    return np.sort(values[np.argsort(-np.abs(values), kind="stable")[: min(k, len(values) - 2)]])[::-1]


def normalised_laplacian(a):
    d = a.sum(1).astype(float)
    root = np.divide(1, np.sqrt(d), where=d > 0, out=np.zeros_like(d))
    return np.diag((d > 0).astype(float)) - root[:, None] * a * root[None, :]


def laplacian_spectrum(a, k=50):
    return np.linalg.eigvalsh(normalised_laplacian(a))[:k]


spectral_adjacency = Split("spectral_adjacency", adjacency_spectrum, _norm)
spectral_laplacian = Split("spectral_laplacian", laplacian_spectrum, _norm)


def two_core(a):
    keep = np.arange(len(a))
    while len(keep) and (low := a[np.ix_(keep, keep)].sum(1) < 2).any():
        keep = keep[~low]
    return a[np.ix_(keep, keep)]


def reduced_non_backtracking(a):
    """The 2n x 2n matrix that shares its spectrum, up to +-1, with the non-backtracking matrix."""
    return reduced_blocks(a.astype(float), a.sum(1).astype(float))


def reduced_blocks(a, d):
    n = len(a)
    return np.block([[np.zeros((n, n)), np.diag(d) - np.eye(n)], [-np.eye(n), a]])


def non_backtracking_points(a, k=100):
    core = two_core(a)
    if not len(core):
        raise ValueError("the graph has no cycle")
    if min(k, 2 * len(a) - 4) >= 2 * len(core) - 1:
        raise ValueError("the 2-core is too small")
    return leading_points(np.linalg.eigvals(reduced_non_backtracking(core)), len(a), len(core), k)


def leading_points(z, n, core, k=100):
    """The points of a graph of n nodes from all values of its 2-core: the k largest, one of each conjugate pair."""
    k = min(k, 2 * n - 4)
    if k >= 2 * core - 1:
        raise ValueError("the 2-core is too small")
    z = np.where(np.abs(z.imag) < 1e-9, z.real, z)
    z = z[np.lexsort((-z.imag, -z.real, -np.round(np.abs(z), 9)))][:k]
    z = z[z.imag >= 0]
    return z[np.lexsort((z.imag, z.real, np.abs(z)))]


def earth_mover(x: np.ndarray, y: np.ndarray) -> float:
    """Exact distance of two point sets with uniform masses: a transport problem with whole supplies, solved by
    shortest augmenting paths with potentials.
    """
    cost = np.abs(x[:, None] - y[None, :])
    supply, demand = np.full(len(x), len(y)), np.full(len(y), len(x))
    flow = np.zeros(cost.shape, np.int64)
    u, v = np.zeros(len(x)), cost.min(0) * 0.0
    while supply.any():
        reach_x = np.where(supply > 0, 0.0, np.inf)
        reach_y = np.full(len(y), np.inf)
        from_x, from_y = np.full(len(x), -1), np.full(len(y), -1)
        open_x, open_y = np.ones(len(x), bool), np.ones(len(y), bool)
        while True:
            dx, dy = np.where(open_x, reach_x, np.inf), np.where(open_y, reach_y, np.inf)
            i, j = dx.argmin(), dy.argmin()
            if dx[i] <= dy[j]:
                open_x[i] = False
                far = dx[i] + np.maximum(cost[i] - u[i] - v, 0)
                better = open_y & (far < reach_y)
                reach_y[better], from_y[better] = far[better], i
            else:
                open_y[j] = False
                if demand[j] > 0:
                    end, length = j, dy[j]
                    break
                far = dy[j] + np.maximum(-(cost[:, j] - u - v[j]), 0)
                better = open_x & (flow[:, j] > 0) & (far < reach_x)
                reach_x[better], from_x[better] = far[better], j
        u -= np.minimum(reach_x, length) - length
        v += np.minimum(reach_y, length) - length
        path, j = [], end
        while True:
            i = from_y[j]
            path.append((i, j, 1))
            if from_x[i] < 0:
                break
            path.append((i, from_x[i], -1))
            j = from_x[i]
        amount = min(supply[i], demand[end], *[flow[p, q] for p, q, s in path if s < 0] or [supply[i]])
        for p, q, s in path:
            flow[p, q] += s * amount
        supply[i] -= amount
        demand[end] -= amount
    return float((flow * cost).sum() / (len(x) * len(y)))


non_backtracking = Split("non_backtracking", non_backtracking_points, earth_mover)


def paths(a):
    """Distances (inf if unreachable) and numbers of shortest paths between all nodes."""
    n = len(a)
    dist, sigma = np.full((n, n), np.inf), np.eye(n)
    np.fill_diagonal(dist, 0)
    front, d = np.eye(n), 0
    step = (a > 0).astype(float)
    while front.any():
        d += 1
        front = np.where(np.isinf(dist), front @ step, 0)
        dist[front > 0] = d
        sigma += front
    return dist, sigma


def portrait(a):
    """{(l, k): nodes with exactly k nodes at distance l}."""
    dist, _ = paths(a)
    out: dict[tuple[int, int], int] = {}
    for l in range(int(dist[np.isfinite(dist)].max()) + 1):
        for k, c in zip(*np.unique((dist == l).sum(1), return_counts=True)):
            if k:
                out[l, int(k)] = int(c)
    return out


def _divergence(p, q):
    m = (p + q) / 2
    kl = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return (kl(p) + kl(q)) / 2


def _portraits_apart(x, y):
    keys = sorted(x.keys() | y.keys())
    p, q = (np.array([float(k * m.get((l, k), 0)) for l, k in keys]) for m in (x, y))
    if not p.sum() or not q.sum():
        return 0.0
    return _divergence(p / p.sum(), q / q.sum())


portrait_divergence = Split("portrait_divergence", portrait, _portraits_apart)


def triangles(a):
    x = a.astype(float)
    return ((x @ x) * x).sum(1) / 2


def clustering(a):
    d = a.sum(1).astype(float)
    pairs = d * (d - 1) / 2
    return np.divide(triangles(a), pairs, where=pairs > 0, out=np.zeros(len(a)))


def node_features(a):
    """Seven features of each node: degree, clustering, their means over neighbours, edges inside and leaving the
    egonet, nodes two steps away.
    """
    x = (a > 0).astype(float)
    d, c, t = x.sum(1), clustering(x), triangles(x)
    mean = lambda f: np.divide(x @ f, d, where=d > 0, out=np.zeros(len(x)))
    two = (x @ x > 0) & (x == 0)
    np.fill_diagonal(two, False)
    return np.stack([d, c, mean(d), mean(c), d + t, d + x @ d - 2 * (d + t), two.sum(1)])


def signature(a):
    """Mean, median, SD, skewness and excess kurtosis of each feature, feature by feature."""
    out = []
    for f in node_features(a):
        m, s = f.mean(), f.std()
        z = (f - m) / s if s > 1e-12 else np.full(len(f), np.nan)
        out += [m, np.median(f), s, (z**3).mean(), (z**4).mean() - 3]
    return np.array(out)


def _canberra(x, y):
    top, low = np.abs(x - y), np.abs(x) + np.abs(y)
    return float(np.where(low == 0, 0, np.divide(top, low, where=low != 0, out=np.zeros_like(top))).sum())


net_simile = Split("net_simile", signature, _canberra)


def affinity(a):
    d = a.sum(1).astype(float)
    e = 1 / (1 + d.max())
    return np.linalg.inv(np.eye(len(a)) + e * e * np.diag(d) - e * a)


def root_affinity(a):
    return np.sqrt(np.maximum(affinity(a), 0))


delta_con = Split("delta_con", root_affinity, _norm)


def exponential(a):
    w, v = np.linalg.eigh(a.astype(float))
    return (v * np.exp(w)) @ v.T


def centred_exponential(a):
    """The entries of the exponential, less their mean, of length one; None if they do not vary."""
    x = exponential(a).ravel()
    x = x - x.mean()
    long = np.sqrt(x @ x)
    return x / long if long > 1e-12 * len(x) else None


def _correlation(x, y):
    return float("nan") if x is None or y is None else float(min(1.0, max(-1.0, x @ y)))


def communicability_shares(a):
    x = np.maximum(exponential(a), 0).ravel()
    x = x / (x.sum() + 1e-10)
    return x / x.sum()


communicability_correlation = Split("communicability_correlation", centred_exponential, _correlation)
communicability_divergence = Split("communicability_divergence", communicability_shares, _divergence)


def resistances(a):
    if np.isinf(paths(a)[0]).any():
        raise ValueError("the graph is not connected")
    n = len(a)
    inverse = np.linalg.inv(np.diag(a.sum(1).astype(float)) - a + np.full((n, n), 1 / n)) - 1 / n
    d = np.diag(inverse)
    return d[:, None] + d[None, :] - 2 * inverse


resistance = Split("resistance", resistances, _norm)


def betweenness(a):
    """Normalised over ordered pairs, end points left out."""
    n = len(a)
    dist, sigma = paths(a)
    out = np.zeros(n)
    for v in range(n):
        on = np.isfinite(dist) & (dist[:, v, None] + dist[None, v, :] == dist)
        on[v, :] = on[:, v] = False
        np.fill_diagonal(on, False)
        out[v] = (np.outer(sigma[:, v], sigma[v, :])[on] / sigma[on]).sum()
    return out / ((n - 1) * (n - 2)) if n > 2 else out


def ks(x, y):
    """Two-sample Kolmogorov-Smirnov statistic."""
    if not len(x) or not len(y):
        raise ValueError("an empty sample")
    at = np.concatenate([x, y])
    f, g = (np.searchsorted(np.sort(s), at, side="right") / len(s) for s in (x, y))
    return float(np.abs(f - g).max())


def lengths(a, geometry=None):
    """The length of each edge, by default in the published distances, which the data folder must hold."""
    if geometry is None:
        from ..sources.readers import data_dir

        geometry = np.load(f"{data_dir()}/reference/distance_matrix.npy")
    return upper(geometry)[upper(a) > 0]


#: What the energy compares, to nine digits where sums decide; each is a KS statistic of its own.
SAMPLES = {
    "ks_degree": lambda a, geometry=None: a.sum(1),
    "ks_clustering": lambda a, geometry=None: np.round(clustering(a), 9),
    "ks_betweenness": lambda a, geometry=None: np.round(betweenness(a), 9),
    "ks_edge_length": lengths,
}
KS = {name: Split(name, sample, ks, ("geometry",)) for name, sample in SAMPLES.items()}
energy = Split("energy", lambda a, geometry=None: [sample(a, geometry) for sample in SAMPLES.values()], lambda x, y: max(map(ks, x, y)), ("geometry",))
