"""Near-duplicates by bottom-k sketches against brute force; what sketches promise."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from graphlens.llm import jaccard_join, minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = []
    for r in rows:
        w = SPACE.findall((r[1] or "").encode().lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, label = sets_of(rows), list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 85 * len(sets[i] | sets[j]):
            label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(root(i))), r[0] == least.get(root(i))) for i, r in enumerate(rows))


def answer(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def varied(seed, bases, copies, length, changes):
    """Texts near some others, at many distances."""
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        base = [f"b{b}w{i}" for i in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, changes)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    return rows


@pytest.mark.parametrize("length, changes, family, part_rows", [(60, 5, 256, 2048), (400, 14, 256, 2048), (150, 7, 4, 16), (900, 30, 8, 2048)])
def test_groups_against_brute_force(spark, monkeypatch, length, changes, family, part_rows):
    monkeypatch.setattr(jaccard_join, "FAMILY", family)
    monkeypatch.setattr(jaccard_join, "PART_ROWS", part_rows)
    rows = varied(length, 4, 60, length, changes)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n long, label string").repartition(3)
    assert answer(minhash.near_duplicates(docs)) == brute(rows)


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, t, None, None, 1) for i, t in enumerate([None, "", " \t\n", "one", "One", "a b c d", "A b\tc D", "a b c d e", "x\x1cy z", "é É ÀA", "word " * 3000])]
    rows += [(20 + i, f"{passage} " + " ".join(f"o{i}x{j}" for j in range(40)), "en", "s", 1) for i in range(80)]
    rows += [(None, "an id that is null", None, None, 1), (None, "an id that is null", None, None, 1), (300, "a b c d E", "en", "s", 1), (None, "a b c d e", None, None, 1), (None, None, None, None, 1), rows[20], rows[20]]
    assert answer(minhash.near_duplicates(spark.createDataFrame(rows, DOCS))) == brute(rows)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_union_sketches_are_those_of_the_union():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 600, dtype=np.uint64))
    for n, m, common in ((3, 4, 2), (100, 120, 90), (300, 280, 250), (128, 150, 110), (500, 500, 0)):
        both = rng.permutation(pool)
        a, b = np.sort(both[:n]), np.sort(np.concatenate([both[:common], both[n : n + m - common]]))
        union = np.union1d(a, b)[: minhash.K]
        shared, of = minhash.union_sketch([a[: minhash.K]], [b[: minhash.K]])
        assert (shared[0], of[0]) == ((np.isin(union, a) & np.isin(union, b)).sum(), len(union))


def test_links_are_let_through_and_share_a_key():
    """Random pairs at and above the threshold; the bound on what sketches share, too."""
    rng = np.random.default_rng(6)
    for _ in range(400):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.85, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, n // 10 + 1)), dtype=np.uint64)]))
        if not len(b) or not jaccard_join.links(a, b, 85, 100):
            continue
        x, y = a[: minhash.K], b[: minhash.K]
        assert minhash.may_link(np.array([len(a)]), np.array([len(b)]), *minhash.union_sketch([x], [y])).all()
        order = rng.permutation(2**16)
        first = lambda s, n: set(s[np.argsort(order[(s & np.uint64(0xFFFF)).astype(int)], kind="stable")[: len(s) - minhash.least_shared(n) + 1]].tolist())
        assert first(x, len(a)) & first(y, len(b))
    assert minhash.retained(128) == 76 and minhash.retained(10, 1, 2, 2) == 1


def test_pairs_of_a_list_are_those_of_all_pairs(monkeypatch):
    """Labels, lists that both know before, parts and batches of any size: every pair that may link comes once."""
    monkeypatch.setattr(minhash, "PAIRS", 30)
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 2**63, 250, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 250)] if i % 3 else rng.permutation(base)[rng.integers(0, 30) :], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)])) for i in range(40)]
    n, label = np.array([len(x) for x in sets]), rng.integers(0, 4, 40)
    earlier = np.where(rng.random((40, jaccard_join.FIRST)) < 0.1, rng.integers(0, 5, (40, jaccard_join.FIRST)), jaccard_join._NONE)
    table = pa.table({"n": n, "sketch": [x[: minhash.K].tobytes() for x in sets], "parity": [jaccard_join.group_parity(x) for x in sets]})
    for second in (np.zeros(40, bool), rng.random(40) < 0.4):
        got = [(min(i, j), max(i, j)) for a, b, _ in minhash.sketch_finder(table, label, earlier, second) for i, j in zip(a.tolist(), b.tolist())]
        want = set()
        for i, j in itertools.combinations(range(40), 2):
            known = set(earlier[i].tolist()) & set(earlier[j].tolist()) - {int(jaccard_join._NONE)}
            if label[i] != label[j] and not known and (second[i] != second[j] or not second.any()) and jaccard_join.links(sets[i], sets[j], 85, 100):
                want.add((i, j))
        assert len(got) == len(set(got)) and want <= set(got) and len(want) > 5
        assert all(label[i] != label[j] and (second[i] != second[j] or not second.any()) for i, j in got)
