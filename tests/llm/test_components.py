import random

from graphlens.llm import components, jaccard_join


def brute(edges):
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_rounds_shrink_and_known_labels_are_kept(spark, monkeypatch):
    """A dense family, chains both ways, a star, a loop; no round sees an edge whose ends are one already."""
    rng = random.Random(1)
    family = [tuple(rng.sample(range(100, 160), 2)) for _ in range(900)]
    chains = [(i, i + 1) for i in range(1000, 1200)] + [(i + 1, i) for i in range(2199, 1999, -1)]
    first = family + chains + [(500, i) for i in range(501, 560)] + [(7, 7)]
    rows, kept = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: rows.append((name, (out := kept(df, name)).count())) or out)
    labels = components.components(spark.createDataFrame(first, "a long, b long"))
    assert dict(map(tuple, labels.collect())) == brute(first)
    met = [n for name, n in rows if name == "components-edges"]
    assert len(met) < 16 and sum(met) < 2 * len(first)
    rows.clear()
    second = [(150, 1100), (559, 3000), (3001, 3000), (2000, 110), (120, 130)]
    labels = components.components(spark.createDataFrame(second, "a long, b long"), labels)
    assert dict(map(tuple, labels.collect())) == brute(first + second)
    assert rows[0] == ("components-edges", 4)
    assert components.components(spark.createDataFrame([(1000, 1150)], "a long, b long"), labels) is labels


def test_points_hold_the_wanted_classes_back_from_the_shuffle(spark, monkeypatch):
    classes = spark.range(20_000).selectExpr("id * 7919 AS sig", "id AS n")
    wanted = spark.range(50).selectExpr("id * 7919 * 11 AS sig")
    few = jaccard_join.points_of(classes, wanted)
    want = sorted((i * 7919 * 11, i * 11) for i in range(50))
    assert sorted(map(tuple, few.collect())) == want
    assert "ArrowEvalPython" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(jaccard_join, "BLOOM_BITS", 8)
    assert sorted(map(tuple, jaccard_join.points_of(classes, wanted).collect())) == want
