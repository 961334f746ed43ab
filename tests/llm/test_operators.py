"""Edge cases and brute force for the operators of graphlens.llm."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from graphlens.llm import bpe, chat, components, examples, jaccard_join, media, mixing, quality, sharding, topk, toxicity, url_filter
from graphlens.llm.registry import oracle_sql, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.randrange(8, 60)) for _ in range(25)]
    texts = [None, "", " \t\n", "one", "One", "a b c d", "A b\tc D", "a b c d e", "x\x1cy z", "é É ÀA", "word " * 3000, words(rng, 9000, 3000)]
    for b in base:
        w = b.split()
        texts += [b, b.upper(), " ".join(w[:-1]), " ".join([*w, "extra", "more"])]
    for _ in range(40):
        w = base[0].split() * 2
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[1]] * 30
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s10", "s2", None]), 1) for i, t in enumerate(texts)]
    return out + [out[7], out[15], (None, "a null id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # a column whose names clash with what the operators make
    return spark.createDataFrame([(*r, 5, 6, "x") for r in rows], DOCS + ", size long, n long, label string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries()} == set(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


def test_sharding(spark, docs, rows, empty):
    out = sharding.shard(docs, 5).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted((r[0] is None, r[0] or 0, size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    by = {s: [r for r in out if r["shard"] == s] for s in range(5)}
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    loads, largest = [sum(r["size"] for r in v) for v in by.values()], max(size(r[1]) for r in rows)
    assert max(loads) <= sum(loads) / 5 + largest
    assert sharding.shard(empty).count() == 0


def test_sharding_is_even_and_splits_hot_groups(spark):
    rng = random.Random(1)
    data = [(i, "same text" if i % 3 == 0 else words(rng, rng.randrange(5, 40)), "en", f"s{i % 7}", 0) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(data, DOCS), 24).groupBy("shard").sum("size").collect()
    loads = [r["sum(size)"] for r in out]
    assert len(loads) == 24 and max(loads) < 1.06 * np.mean(loads) and min(loads) > 0.94 * np.mean(loads)


@pytest.mark.parametrize("others", [0, 1200])
def test_sharding_splits_rows_that_agree_in_all_columns(spark, others):
    rng = random.Random(4)
    for same in ((None, None, None, None, None), (7, "equal " * 6, "en", "s", 1)):
        data = [same] * 1200 + [(i, words(rng, rng.randrange(1, 4)), "en", "s", 0) for i in range(others)]
        out = sharding.shard(spark.createDataFrame(data, DOCS).repartition(4), 24).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
        loads = [r["b"] for r in out]
        assert len(out) == 24 and max(loads) < 1.2 * np.mean(loads) and min(loads) > 0.8 * np.mean(loads) and all(r["last"] == r["n"] - 1 for r in out)


def plain_tree(points, shards):
    """(gkey, chunk) -> shard by a K-d tree in plain recursion, each node sorted and cut where its weight is reached."""

    def grow(own, first, k):
        if k == 1 or not own:
            return {p["gkey", "chunk"]: first for p in own}
        width = lambda d: max(p[d] for p in own) // sharding._TIE - min(p[d] for p in own) // sharding._TIE
        dim = max(sharding.DIMENSIONS, key=lambda d: (width(d), -sharding.DIMENSIONS.index(d)))
        want, below = sum(p["w"] for p in own) * (k // 2) / k, 0
        weight = Counter()
        for p in own:
            weight[p[dim]] += p["w"]
        for key in sorted(weight):
            if below + weight[key] >= want:
                break
            below += weight[key]
        cut = key - 1 if want - below < below + weight[key] - want else key
        return grow([p for p in own if p[dim] <= cut], first, k // 2) | grow([p for p in own if p[dim] > cut], first + k // 2, k - k // 2)

    return grow(points, 0, shards)


def test_sharding_against_a_plain_tree(spark, monkeypatch):
    """Every document's shard, where quantiles are refined to the last point; groups, ties and chunks of heavy groups."""
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    monkeypatch.setattr(sharding, "BINS", 7)
    rng = random.Random(12)
    data = [(i, "a copy " * 30 if i % 9 == 0 else words(rng, rng.randrange(0, 40)) if i % 50 else None, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 0) for i in range(700)]
    docs = spark.createDataFrame(data, DOCS)
    shards = 6
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.xxhash64(text, F.octet_length(text)).alias("gkey"), F.monotonically_increasing_id().alias("row"))
    rows, total = narrow.agg(F.count("*"), F.sum("size")).first()
    chunked, points = sharding._points(narrow, shards, total, rows)
    got = [r.asDict() | {("gkey", "chunk"): (r["gkey"], r["chunk"])} for r in sharding._keyed(points).collect()]
    assert len(got) < 700 and max(Counter(p["gkey"] for p in got).values()) > 1
    tree = plain_tree(got, shards)
    want = {r["doc_id"]: tree[r["gkey"], r["chunk"]] for r in chunked.collect()}
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards).collect()} == want


def test_mixing_against_brute_force(spark, docs, rows, empty):
    out = mixing.mix(docs).collect()
    size = lambda t: len(SPACE.findall((t or "").encode()))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, active = {}, 1.5 * sum(total.values()), set(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if share[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        active -= over
    target |= share
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    of = {(r[0], size(r[1])): r[3] for r in rows}
    for s in sources:
        mine = [r for r in out if of[r["doc_id"], r["size"]] == s]
        assert {round(r["target"], 6) for r in mine} == {round(target[s], 6)}
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine) + 0.05 * target[s]
    assert 2 * sum(r["taken"] for r in out) <= 3 * sum(total.values())
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert sum(size(r["text"]) for r in copies.select("text").collect()) == sum(r["taken"] for r in out)


def test_mixing_of_one_id_and_of_many_copies(spark, monkeypatch):
    """All rows under one id (or none) are a queue in many buckets; a row taken very often is written in parts."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "COPIES", 7)
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(1, 30)) for _ in range(600)]
    for doc_id in (5, None):
        data = [(doc_id, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)] + [(9, "the same words", "en", "s0", 0)] * 60
        docs = spark.createDataFrame([(*d, 1, 2, "k") for d in data], DOCS + ", key int, copies int, part string")
        out = mixing.mix(docs).collect()
        for target in {r["target"] for r in out}:
            mine = [r for r in out if r["target"] == target]
            assert abs(sum(r["taken"] for r in mine) - target) <= 60
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns and sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in out)
        h = docs.selectExpr("count(distinct substring(md5(concat('mix:', coalesce(cast(doc_id as string), 'null'), ':', md5(cast(text as binary)))), 1, 2)) as n").first()["n"]
        assert h > 200


def brute_components(rows):
    sets = []
    for r in rows:
        w = SPACE.findall((r[1] or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
            label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0] is None, r[0] or 0), len(sets[i]), least.get(root(i), -1)) for i, r in enumerate(rows))


def test_jaccard_join_against_brute_force(docs, rows, empty):
    out = jaccard_join.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in out) == brute_components(rows)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_one_of_each_group(spark, docs, rows, empty):
    """Rows without an id, rows that repeat one with another text, equal rows: one row of each group of near copies stays."""
    base = "a quite long sentence of fourteen different words that some other rows repeat almost"
    more = [(500, base, None, None, 1), (500, "something else under the same id", None, None, 1), (None, base + " entirely", None, None, 1), (None, base, None, None, 1), (3, base, "en", "s", 1), (None, None, None, None, 1)]
    out = jaccard_join.one_of_each_group(docs.unionByName(spark.createDataFrame([(*m, 5, 6, "x") for m in more], docs.schema)).withColumn("key", docs["size"]))
    assert out.columns == [*docs.columns, "key"]
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    everything = [*rows, *more]
    label = [c[2] for c in sorted_components(everything)]
    best = {}
    for r, c in zip(everything, label):
        at = (r[0] is None, r[0] or 0, r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest())
        best[c] = min(best.get(c, (at, r)), (at, r), key=lambda x: x[0])
    want = {(r[0], r[1]) for _, r in best.values()}
    assert len(kept) == len(set(kept)) and set(kept) == want
    assert (3, base) in want and (500, base) not in want and (500, "something else under the same id") in want
    assert jaccard_join.one_of_each_group(empty).count() == 0


def sorted_components(rows):
    """Place, text and a group number of each row; rows that cannot link are groups of their own, but equal rows are one."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := SPACE.findall((r[1] or "").encode().lower())) >= 5 else {tuple(w)} if w else set() for r in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        same = rows[i][:2] == rows[j][:2] or sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
        if same and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    return [(i, r[1], x) for i, (r, x) in enumerate(zip(rows, label))]


def test_sets_that_share_a_signature_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 3, 7, 100), (2, 4, 7, 200), (3, 4, 7, 200), (4, 5, 8, 300), (5, 0, None, None)], "doc_id long, n long, sig long, twin long")
    out, found = jaccard_join.told_apart(rows)
    sig = {r["doc_id"]: r["sig"] for r in out.collect()}
    assert found == {7: 100} and sig[1] == 7 and sig[2] == sig[3] != 7 and sig[4] == 8 and sig[5] is None
    assert jaccard_join.told_apart(rows.filter("doc_id > 2"))[1] == {}
    h = np.arange(50, dtype=np.uint64)
    assert jaccard_join.signature(h) != jaccard_join.second_signature(h) and jaccard_join.second_signature(h) != jaccard_join.second_signature(h[1:])


@pytest.mark.parametrize("part_rows, family", [(2048, 256), (16, 4096), (16, 8), (2048, 8)])
def test_jaccard_join_on_chains_of_near_copies(spark, monkeypatch, part_rows, family):
    """Copies at many distances, so that links, near misses and several rounds occur; in whole runs and in parts, with stars or without."""
    monkeypatch.setattr(jaccard_join, "PART_ROWS", part_rows)
    monkeypatch.setattr(jaccard_join, "FAMILY", family)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"z{rng.randrange(50)}"
        data.append((i, " ".join(w), "en", "s", 0))
    out = jaccard_join.near_duplicates(spark.createDataFrame(data, DOCS)).collect()
    assert sorted(((False, r["doc_id"]), r["n_shingles"], r["component_id"]) for r in out) == brute_components(data)


def test_links_outside_large_families_come_from_the_tree(docs, rows, monkeypatch):
    """No star is drawn there: all pairs that are verified come out of R-trees."""
    monkeypatch.setattr(jaccard_join, "bounded_pairs", None)
    out = jaccard_join.near_duplicates(docs).collect()
    assert sum(r["component_id"] != r["doc_id"] for r in out) > 40
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in out) == brute_components(rows)


def test_filters_of_ids_hold_all_of_them(spark, monkeypatch):
    ids = np.array([0, -5, 2**62, 7, 8, 9], np.int64)
    bloom = jaccard_join._bloom(spark.createDataFrame([(int(i),) for i in ids], "one long"), "one", 1 << 16)
    assert jaccard_join.holds(bloom, ids).all() and jaccard_join.holds(bloom, np.arange(100, 10_000)).sum() < 20
    data = [(i, f"t{i % 9} " + "common words of all texts", "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(data, DOCS)
    want = sorted(map(str, jaccard_join.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard_join, "BLOOM_BITS", 4)
    assert sorted(map(str, jaccard_join.near_duplicates(docs).collect())) == want


def test_bounds_never_drop_a_link():
    rng = np.random.default_rng(0)
    for n in (1, 3, 20, 300, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, rng.integers(0, n // 3 + 1), dtype=np.uint64)]))
            if not len(b) or not jaccard_join.links(a, b):
                continue
            x, y = (np.frombuffer(jaccard_join.group_counts(s), np.uint8) for s in (a, b))
            g = min(len(x), len(y))
            assert jaccard_join.may_link(len(a), len(b), np.abs(jaccard_join.fold(x, g).astype(int) - jaccard_join.fold(y, g)).sum())
            assert jaccard_join.may_link(len(a), len(b), jaccard_join.parity_apart([jaccard_join.group_parity(a)], [jaccard_join.group_parity(b)])[0])


def test_word_hashes_do_not_depend_on_place():
    texts = ["a b c d e f", "zz " * 50 + "a b c d e f", "q a b c d e f", "a  b\tc\nd e f"]
    one, many, _, spaced = jaccard_join.shingle_sets(texts)
    assert set(one.tolist()) <= set(many.tolist()) and one.tolist() == spaced.tolist()
    assert [s.tolist() for t in texts for s in jaccard_join.shingle_sets([t])] == [s.tolist() for s in jaccard_join.shingle_sets(texts)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    out = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_toxicity(spark, empty):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(rng.choices(plain, k=60) + (rng.choices(["vileone", "viletwo", "grimy"], k=3) if i % 6 == 0 else [])), "en", "s", 0) for i in range(600)]
    data += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "viletwo, grimy! " * 4000, None, None, None), data[0]]
    docs = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    fresh = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in fresh]) > 0.97
    by = {r["doc_id"]: r for r in out}
    assert by[1002]["predicted"] == 1 and by[1000]["score"] == by[1001]["score"] < 0.5 and by[1000]["evidence"] == []
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in out)
    none = labels.filter("toxic = 0")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def brute_toxicity(data, label, others):
    """Score and nearest examples of each id, by plain loops: TF-IDF of whole texts, neighbours, votes, curve."""
    terms = {}
    for i, t in data.items():
        words = re.findall(r"[^\W_]+", (t or "").lower())
        terms[i] = Counter(words) + Counter(w[:4] + "*" for w in words if len(w) >= 4)
    examples = sorted(i for i in label if i in data and zlib.crc32(str(i).encode()) % 5)
    known = {x for i in examples for x in terms[i]}
    rows = list(terms.values()) + [terms[i] for i in others]
    df = {x: sum(x in c for c in rows) if x in known else 1 for x in set().union(*rows)}
    weights = {i: {x: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[x])) + 1) for x, n in c.items()} for i, c in terms.items()}
    norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in weights.items()}
    share = sum(label[i] for i in examples) / len(examples)

    def near(i, without=None):
        cosine = {e: round(sum(w * weights[e].get(x, 0) for x, w in weights[i].items()) / norm[i] / norm[e], 12) if norm[i] and norm[e] else 0 for e in examples if e != without}
        return sorted(((c, e) for e, c in cosine.items() if c > 0), key=lambda x: (-x[0], x[1]))

    def odds(found):
        out = []
        for k in toxicity.NEIGHBOURS:
            w = sum(c**1.5 for c, _ in found[:k])
            v = (sum(c**1.5 * label[e] for c, e in found[:k]) + 1e-3 * share) / (w + 1e-3)
            out.append(math.log((v + 0.01) / (1.01 - v)))
        return out

    learn = [i for i in label if zlib.crc32(str(i).encode()) % 5]
    prior = {v: sum(label[i] == v for i in learn) / sum(label[i] == v for i in examples) for v in (0, 1)}
    rate = np.array([prior[label[e]] for e in examples])
    curve = toxicity.fit_logistic(np.array([odds(near(e, e)) for e in examples]), np.array([label[e] for e in examples], float), rate * len(rate) / rate.sum())
    found = {i: near(i) for i in data}
    return {i: (1 / (1 + math.exp(-(np.dot(curve[:-1], odds(n)) + curve[-1]))), n[:3]) for i, n in found.items()}


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Terms, frequencies, neighbours, votes and curve; toxic words of two or three examples are enough to be found."""
    monkeypatch.setattr(toxicity, "NEIGHBOURS", (3, 10, 40))
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "PANEL", 40)
    rng = random.Random(6)
    vile = lambda family: " ".join(f"{family:02d}zq{k}" for k in rng.sample(range(8), 6))
    data = {i: " ".join(rng.choices([f"w{k}" for k in range(300)], k=20)) + f" only{i} " + (vile(i // 15) if i % 5 == 0 else "") for i in range(300)}
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 5 == 0][:23]
    data |= {held[f]: " ".join(rng.choices([f"w{k}" for k in range(300)], k=20)) + " " + vile(f) for f in range(20)}
    data |= {held[20]: " ".join(f"unseen{k}" for k in range(500)) + " w1 w2", held[21]: None, held[22]: "Vi_le, ÉTÉ ÉTÉ! " * 3000 + data[0]}
    label = {i: int(i % 5 == 0) for i in range(300)} | {5001: 1, 5002: 0}
    labels = spark.createDataFrame([(i, 1, y) for i, y in label.items()] + [(3, 1, None), (4, 1, 0), (None, 1, 1), (8, 1, 7)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data.items()] + [(7, data[7], "en", "s", 0), (None, "w1 w1", None, None, None)], DOCS)
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    want = brute_toxicity(data | {None: "w1 w1"}, label, [7])
    assert len(out) == len(want)
    for i, r in out.items():
        assert r["score"] == pytest.approx(want[i][0], abs=1e-6), i
        assert [(x["doc_id"], x["toxic"], x["similarity"]) for x in r["evidence"]] == [(e, label[e], pytest.approx(c, abs=1e-9)) for c, e in want[i][1]], i
    assert np.mean([out[i]["predicted"] for i in held[:20]]) > 0.8 and np.mean([out[i]["predicted"] for i in range(300) if i % 5]) < 0.03


def test_an_id_teaches_once(spark, monkeypatch):
    """Neither repeats of a labelled row in documents nor of its label make more examples; bytes of texts are bounded."""
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(1, 1, 1)] * 3000, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 0) for i in range(40)], DOCS)
    many = docs.unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(10_000)).drop("id"))
    rows, counts = examples.labelled_texts(many, labels, "toxic")
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert rows == [(i, i % 2, f"text {i}".encode()) for i in train] and counts == Counter(i % 2 for i in train)
    assert len(toxicity.fit(many, labels).ids) == len(train)
    few, _ = examples.labelled_texts(many, labels, "toxic", rows=5, size=60)
    assert Counter(y for _, y, _ in few) == {0: 4, 1: 4}
    assert examples.labelled_texts(docs.limit(0), labels, "toxic") == ([], counts) and examples.labelled_texts(docs, labels.filter("toxic = 1"), "toxic")[0] == []


def test_block_max_index_is_exact(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = []
    for d in range(500):
        ids = np.sort(rng.choice(40, rng.integers(0, 6), replace=False)) + 40 * (d % 2)
        w = rng.random(len(ids)).round(1) + 0.1
        vectors.append((ids, w / np.linalg.norm(w) if len(ids) else w))
    dense = np.zeros((500, 80))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    for panel in (1, 20, 200):
        monkeypatch.setattr(toxicity, "PANEL", panel)
        index = toxicity.BlockMaxIndex(vectors, 80)
        for k in (1, 7, 499, 900):
            near, cosine, blocks = index.nearest(vectors[60:120], k, leave=60)
            all_of = (dense[60:120] @ dense.T).round(12)
            all_of[np.arange(60), 60 + np.arange(60)] = 0
            want = np.array([np.lexsort((np.arange(500), -c))[:k] for c in all_of])
            assert cosine == pytest.approx(np.take_along_axis(all_of, want, 1))
            assert (np.diff(cosine, axis=1) <= 0).all()
            assert k > 7 or panel < 200 or blocks < 0.8 * 60 * index.blocks


def test_quality(spark, empty):
    rng = random.Random(5)
    good = lambda: words(rng, 80).replace("w", "a").replace("1", "lo ").replace("2", "th")
    bad = lambda: rng.choice(["spam ", "%%% &&& "]) * rng.randrange(20, 200)
    data = [(i, bad() if i % 5 == 0 else good(), "en", "s", 0) for i in range(500)] + [(900, None, None, None, None), (901, "", None, None, None), (902, good() * 3000, None, None, None)]
    docs = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(500)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality.score(docs, net).collect()}
    assert np.mean([r["predicted"] == (i % 5 != 0) for i, r in out.items() if i < 500 and r["held_out"]]) > 0.97
    assert out[902]["predicted"] == 1 and out[900]["score"] == out[901]["score"]
    assert quality.without_poor(docs, net).count() == sum(r["predicted"] for r in out.values())
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {1.0}
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


def test_quality_passes_over_texts_that_do_not_fit(spark):
    """One text of 13 MB, first of its class, does not remove the shorter examples behind it."""
    rng = random.Random(7)
    data = [(i, "%%% &&& " * 40 if i % 2 else words(rng, 60), "en", "s", 0) for i in range(200)]
    first = min((i for i in range(0, 200, 2) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    data[first] = (first, words(rng, 10_000) * 280, "en", "s", 0)
    assert len(data[first][1]) > 13_000_000
    docs = spark.createDataFrame([*data, data[4], data[4]], DOCS)
    net = quality.fit(docs, spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int"))
    assert isinstance(net, quality.Network)
    out = quality.score(docs, net).collect()
    assert len(out) == 202 and np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in out]) > 0.97
    assert examples.fitting([(0, 9), (0, 3), (1, 5), (0, 2), (0, 1), (1, 1)], 5) == [False, True, True, True, False, False]


def test_network_against_plain_loops():
    """Convolution, pooling and layers, value by value, over several chunks."""
    net = quality.Network(3)
    for raw in (b"", b"abc", bytes(range(256)) * 5):
        chunks, at = [], 0
        while True:
            chunks.append(raw[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0"))
            if at + quality.CHUNK >= len(raw):
                break
            at += quality.STEP
        pooled = []
        for c in chunks:
            best = [max(sum(float(net.p["filters"][j, c[p * quality.STRIDE + j], f]) for j in range(quality.WIDTH)) for p in range(quality.PLACES)) for f in range(0, quality.FILTERS, 8)]
            pooled.append([max(0.0, b + float(net.p["bias"][f])) for b, f in zip(best, range(0, quality.FILTERS, 8))])
        got = net.features([raw])[0]
        assert got[: quality.FILTERS : 8] == pytest.approx(np.mean(pooled, axis=0), abs=1e-4) and got[quality.FILTERS :: 8] == pytest.approx(np.max(pooled, axis=0), abs=1e-4)
        hidden = [max(0.0, sum(float(x) * float(net.p["w1"][i, h]) for i, x in enumerate(got)) + float(net.p["b1"][h])) for h in range(quality.HIDDEN)]
        z = sum(h * float(w) for h, w in zip(hidden, net.p["w2"])) + float(net.p["b2"][0])
        assert net.score([raw])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_network_gradients_and_coverage():
    net = quality.Network(1)
    texts, y = [b"abc" * 300, b"hello world, " * 9, b""], np.array([1, 0, 1], np.float32)
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.logits(net.features(texts))))))
    g = net.gradients(texts, y)
    for name, at in (("w2", (3,)), ("b2", (0,)), ("w1", (40, 2)), ("filters", (2, ord("l"), 5))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[name][at], abs=2e-3)
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        c = quality.chunks_of(bytes(range(1, 251)) * 20 if n == 5000 else b"x" * n)
        assert (len(c) - 1) * quality.STEP + quality.CHUNK >= n
    long = b"".join(bytes([65 + i % 20]) for i in range(300_000))
    assert net.features([long]) == pytest.approx(np.concatenate([(p := net.pool(quality.chunks_of(long))).mean(0), p.max(0)])[None], rel=1e-3)


def test_media(docs, rows, empty):
    out = media.document_media(docs).collect()
    assert len(out) == len(rows)
    want = {}
    for r in rows:
        raw = (r[1] or "").encode()
        want.setdefault(r[0], []).append((len(raw), raw + bytes(-len(raw) % 64 if raw else 64)))
    for r in out:
        n, data = want[r["doc_id"]][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        stored = media.store_payload(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.read_payload(stored) == data
        assert r["feature"] == media.describe(data) and r["caption"] == f"text of {n} bytes" and r["items"] <= 3 and r["position"] <= 1
    assert any((r["items"], r["position"]) == (3, 1) for r in out)
    assert media.document_media(empty).count() == 0


def test_interleaved_sequences(spark):
    html = '<html><head><title>t</title></head><body><p>One <b>two</b></p><img src="media:sha256/aa" alt="first &amp; best"><script>x()</script>three<img src="b.png"></body>'
    items = media.parse_html(html)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "One two", None, None), (1, "media", None, "aa", "first & best"), (2, "text", "three", None, None), (3, "media", None, "b.png", None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert {r["page_id"]: len(r["sequence"]) for r in media.sequences(pages).collect()} == {1: 4, 2: 0, 3: 0}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<html><head><title>t</title><body><p>One </p><img src="a" alt="x">two', ["One", ("a", "x"), "two"]),
        ("<head>hello", ["hello"]),
        ("<html><head><noscript><body>text", ["text"]),
        ('<figure><figcaption>cap <b>b</b></figcaption><img src="media:sha256/aa" alt="alt"></figure>after', [("aa", "cap b"), "after"]),
        ("x<figure><img src=a><img src=b alt=c><figcaption>both", ["x", ("a", "both"), ("b", "both")]),
        ("<figure>a<figcaption>only words</figcaption>b</figure>", ["a", "only words", "b"]),
        ('<figure><figure><img src=a><figcaption>in</figcaption></figure><img src=b><figcaption>out</figcaption></figure>', [("a", "in"), ("b", "out")]),
        ('<noscript><img src="q"></noscript>x<template><img src=z>no</template>y', ["xy"]),
        ('<video><source src="v.mp4"></video><img alt="lost">', [("v.mp4", None), (None, "lost")]),
        ("a</p></head>b<script>if (a<b) {}</script>c &lt;p&gt;", ["a", "bc <p>"]),
    ],
)
def test_pages_as_they_come(html, want):
    """Unclosed heads, captions in figures, media that is not shown, odd end tags."""
    found = media.parse_html(html)
    assert [i["text"] if i["kind"] == "text" else (i["digest"], i["caption"]) for i in found] == want
    assert [i["position"] for i in found] == list(range(len(want)))


def test_interleaved_pages_resolve_in_place(spark):
    """Several texts and media a page; a payload used often, one that is not there, none."""
    payloads = {hashlib.sha256(d).hexdigest(): d for d in (bytes(64), bytes(range(64)) * 3)}
    first, second = payloads
    store = spark.createDataFrame([(d, media.store_payload(p)) for d, p in payloads.items()] * 2, "digest string, media binary")
    page = lambda i: f'<p>{i} a</p><img src="media:sha256/{first}" alt="one"><p>{i} b</p><figure><img src="media:sha256/{second if i % 2 else "00"}"><figcaption>two {i}</figcaption></figure>{i} c<img>'
    pages = spark.createDataFrame([(i, page(i)) for i in range(50)] + [(50, None)], "page_id long, html string")
    items = media.sequences(pages).selectExpr("page_id", "explode(sequence) as item").filter("item.kind = 'media'")
    out = {(r["page_id"], r["item"]["position"]): (r["item"]["caption"], r["payload_sha256"], r["payload_bytes"]) for r in media.resolve(items, media.features(store)).collect()}
    want = {(i, 1): ("one", first, 64) for i in range(50)} | {(i, 3): (f"two {i}", *((second, 192) if i % 2 else (None, None))) for i in range(50)} | {(i, 5): (None, None, None) for i in range(50)}
    assert out == want
    whole = media.resolve(items, store.distinct()).filter("digest = '" + second + "'").collect()
    assert len(whole) == 25 and {media.read_payload(bytes(r["media"])) for r in whole} == {payloads[second]}


def test_features_of_payloads():
    samples = bytes([10] * 64 + [20] * 64 + [30] * 64 + [40] * 64)
    assert media.describe(samples) == "gray8:64x4:10,20,30,40" and media.describe(bytes([7] * 64)) == "gray8:64x1:7,0,0,0"


SAID = st.lists(st.sampled_from([*chat.CONTROL, chat.JOINER, "<", "<<", "[", "s>", "a", "\n", "/INST]"]), max_size=8).map("".join)


@given(SAID)
@settings(max_examples=400, deadline=None)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool", "", "[INST]", "a\nb", "\\n\\", "us\\\ner"]), SAID), min_size=1, max_size=12), st.booleans(), st.integers(1, 12), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_windows_hold_each_turn_once(turns, system, budget, history):
    turns = [("system", "be kind")] * system + turns
    own, said = [], []
    for _, content, first in chat.windows_of(iter(turns), budget, history):
        text, loss = chat.format_window(content, first)
        back = list(chat.parse_window(text))
        assert back == content
        assert sum(chat._tokens(t) for _, t in content) <= budget or len(content) - (system and len(content) > 1) == 1
        own += back[first:]
        said += [chat.unescape(text[s["start"] : s["stop"]]) for s in loss]
        assert not system or back[0] == turns[0]
    assert own == turns and said == [t for r, t in turns if r == "assistant"]


def test_chat_query(spark):
    rows = [(1, 1, "assistant", "b" * 9000), (1, 0, "user", None), (1, 0, "user", None), (None, 0, None, "<s>"), (2, None, "system", "x"), (2, 3, "assistant", "é\ny")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.with_probe(t.withColumn("window", t["turn"])))).collect()}
    assert {c: r["n_turns"] for c, r in out.items()} == {-1: 2, 1: 3, None: 1, 2: 2}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["turns_sha256"] == digest("user\n\nuser\n\nassistant\n" + "b" * 9000 + "\n") and out[1]["loss_chars"] == 9000
    assert out[-1]["loss_sha256"] == digest("</s>[INST] ok [/INST]") and out[2]["loss_sha256"] == digest("é\ny")
    assert chat.read_back(chat.format_conversations(t.limit(0))).count() == 0
    long = spark.createDataFrame([(3, i, "user", f"{i} " * 300) for i in range(20)], "conv_id long, turn long, role string, text string")
    mixed = chat.format_conversations(long).orderBy("window", ascending=False)
    with pytest.raises(Exception, match="is due"):
        chat.read_back(mixed).collect()


def test_history_makes_room():
    """With turns of 101 (system), 201, 401, 151, 101 and 901 tokens no window is over 1,024."""
    turns = [("system" if i == 0 else "user", "w " * (n - 1)) for i, n in enumerate((101, 201, 401, 151, 101, 901))]
    assert [sum(chat._tokens(t) for _, t in c) for _, c, _ in chat.windows_of(iter(turns), 1024, 256)] == [955, 1002]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/x?y", "https://www.example.com/en/", "https://a.www.example.com/en/z#k", "http://example.com", "http://notexample.com/en/", "http://x.net/es/a", "http://x.net/ES/a", "http://net?x/es/", "http://example.com?a=/en/", "ftp://org/://com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "rule") for i, u in enumerate(urls)] + [(4, urls[4], "h", "r")], "page_id long, url string, host string, stack string")
    out = url_filter.judge(pages, url_filter.production_rules(spark)).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(urls) + 1
    assert [by[i] for i in range(4)] == [("", "", None, "allow")] * 4
    assert by[4] == ("example.com", "/en/x", "example.com/en/", "block")
    assert by[5][2:] == ("www.example.com/en/", "allow") and by[6][2:] == ("www.example.com/en/", "allow")
    assert by[7] == ("example.com", "", None, "allow") and by[8][2:] == ("com/", "allow")
    assert by[9][2:] == ("net/es/", "block") and by[10][2] is None and by[11][0] == "net" and by[12][:2] == ("example.com", "") and by[13][:2] == ("org", "/://com/en/")
    assert url_filter.judge(pages.limit(0), url_filter.production_rules(spark)).count() == 0
    rules = spark.createDataFrame([("b.com", "/", "block"), ("b.com", "/", "allow"), ("a.b.com", "/x", "allow"), ("b-c.com", "/", "block")], "host string, path string, verdict string")
    more = spark.createDataFrame([(0, "http://a.b.com/x"), (1, "http://a.b.com/y"), (2, "http://z.b-c.com/y"), (3, "http://c.com/")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(more, rules, "block").collect()} == {0: ("a.b.com/x", "allow"), 1: ("b.com/", "block"), 2: ("b-c.com/", "block"), 3: (None, "block")}


@pytest.mark.parametrize("sizes", [(8192, 512, 4 << 20), (30, 3, 4 << 20), (8192, 512, 2000)])
def test_top_k_against_brute_force(spark, monkeypatch, sizes):
    """In a few blocks, in many, and in blocks bounded by bytes."""
    for name, n in zip(("CANDIDATES", "QUERIES", "BLOCK_BYTES"), sizes):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [1.0, None] + [0.0] * 10), (1100, [float("nan")] * 12), (1150, [1.0] * 3), (1200, [float("inf")] * 12), (None, x[0].tolist()), (1250, []), (1300, [1e300] * 12)]
    out = topk.top_k(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, q int")).collect()
    valid = {i: [int(np.floor(256.0 * float(c))) for c in v] for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in (i for i in valid if i % 50 == 0):
        clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        best = sorted((-clip(sum(a * b for a, b in zip(valid[q], v))), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bpe_against_tiktoken(spark, docs, rows, empty):
    import public_tokenizers
    import tiktoken

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    odd = ["<|endoftext|> ▁ ▁x", "a  b　 c  \t\n\n d", "\x00\x01\x1c\x1d é", "naïve 日本語 🙂🙂 ４５ ½", " " * 50 + "x" * 3000, "it's we'LL I'd 12three", "�﻿<unk></s>"]
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    out = bpe.encode_decode(docs.select("doc_id", "text").unionByName(extra), tokens, public_tokenizers.PATTERN, keep_ids=True).collect()
    text = {r[0]: r[1] for r in rows} | {5000 + i: t for i, t in enumerate(odd)}
    assert len(out) == len(rows) + len(odd)
    for r in out:
        raw = text[r["doc_id"]] or ""
        ids = np.array(own.encode_ordinary(raw), "<u4")
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids.tolist(), raw[:80]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw.encode()).hexdigest())
    assert bpe.encode_decode(empty, tokens, public_tokenizers.PATTERN).count() == 0


def test_bpe_cache_is_bounded_in_characters(monkeypatch):
    import public_tokenizers

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = bpe.serialise_model(tokens)
    free, tight = (bpe.Codec(model, tokens, public_tokenizers.PATTERN) for _ in range(2))
    texts = ["one two three", "x" * 300, "one two", "", "y" * 90 + " one", "three " * 40, "z" * 99, "one two three"]
    ids = [free.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE_CHARS", 100)
    for text, known in zip(texts, ids):
        assert tight.encode(text) == known and tight.decode(known).decode() == text
        assert tight.held == sum(map(len, tight.known)) <= max(100, len(text))
