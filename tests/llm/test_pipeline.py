"""The pipeline against its stages' own operators, on the small tables."""

import hashlib

import corpus_pipeline as p
import numpy as np
import pytest
from graphlens.llm import jaccard_join, mixing, quality, toxicity
from graphlens.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    kept = []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept.append([r["doc_id"] for r in out.select("doc_id").collect()])
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 0").collect()}
        elif name.startswith("quality"):
            want = {r["doc_id"] for r in quality.score(docs, quality.fit(docs, labels)).filter("predicted = 1").collect()}
        elif name.startswith("n-gram"):
            want = {r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
        else:
            want = {r["doc_id"] for r in mixing.mix(docs).filter("taken > 0").collect()}
        assert set(kept[-1]) == want, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    out = p.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(kept[-1])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
    assert np.all(np.diff(list(map(len, map(set, kept)))) <= 0)


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_nothing_and_on_nulls(spark, stage):
    schema = table(spark, SF, "documents").schema
    none = spark.createDataFrame([], schema)
    assert p.STAGES[stage][1](spark, none, SF).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "some words in a text", "en", None, 3)], schema)
    out = p.STAGES[stage][1](spark, odd, SF).collect()
    ids = sorted((r["doc_id"] or 0) for r in out)
    if stage < 2:  # null and empty texts get one score, so they go or stay together
        assert ids in ([], [0], [1, 2, 2], [0, 1, 2, 2])
    else:  # equal rows are one document; only words are mixed, 5 of 7.5; all rows are encoded
        assert ids == [[0, 1, 2], [0], [0, 1, 2, 2]][stage - 2]
    if stage == 4:
        assert {r["doc_id"]: r["n_tokens"] == 0 for r in out} == {1: True, 2: True, None: False}
        assert next(r for r in out if r["doc_id"] is None)["decoded_sha256"] == hashlib.sha256(b"some words in a text").hexdigest()
