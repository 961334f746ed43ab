"""The manifest against a plain tree; edge cases; what tampering shows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from graphlens.llm import merkle
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def ascii_lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """The root, and of every node the siblings of its ancestors as (left, right)."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        after, after_owners = [], []
        for s in range(0, len(nodes), 8):
            run = nodes[s : s + 8]
            for j in range(len(run)):
                for i in owners[s + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            after.append(sha("".join(run)))
            after_owners.append([i for own in owners[s : s + 8] for i in own])
        nodes, owners = after, after_owners
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = own, *climb([leaf(*r) for r in own])
    root, upper = climb([trees[x][1] for x in langs])
    out = []
    for lang, above in zip(langs, upper):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            whole = path + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            digest = leaf(r[0], ascii_lower(r[1]), *r[2:]) if tampered else leaf(*r)
            for left, right in whole:
                digest = sha("".join([*left, digest, *right]))
            out.append((r[0], leaf(*r), subroot, root, sha("".join("".join(left + right) for left, right in whole)), digest, digest == root))
    return Counter(out)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["Some", "words", "ÀÉ", "of a TEXT", "x" * 40]) for _ in range(rng.randrange(0, 9))), rng.choice(langs), rng.choice(["a", None, "b:"]), rng.choice([None, 3])) for i in range(n)]
    return [*rows, (None, "no id", langs[0], None, 1), (None, None, langs[0], "", None), (7, "another of id 7", langs[0], "a", 1), rows[3], rows[3], (n, "Ä" * 70_000 + "B", langs[0], "a", 2)]


@pytest.mark.parametrize("n, langs, block, top", [(90, ["en", None, "", "é", "z"], 8, 4096), (700, ["en", "de"], 8, 3), (75, ["one"], 64, 4), (400, [f"l{i}" for i in range(90)], 8, 5)])
def test_manifest_against_a_plain_tree(spark, monkeypatch, n, langs, block, top):
    """One or many blocks and languages; tops that the driver builds and tops that are reduced in rounds."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "TOP", top)
    rows = rows_of(n, langs)
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS + ", k string, pos int").repartition(3)
    out = merkle.manifest(docs, merkle.every_third()).collect()
    assert Counter(tuple(r) for r in out) == brute(rows)
    assert {r["verified"] for r in out} == {True, False}


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS), merkle.every_third()).count() == 0
    row = (6, "Alone", "en", "s", 5)
    got = merkle.manifest(spark.createDataFrame([row], DOCS)).first()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] == leaf(*row) and got["proof_sha256"] == sha("") and got["verified"]


@pytest.fixture
def uneven(spark):
    """Small tables stay in as many partitions as shuffles have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_row_that_is_repeated_very_often_is_cut(spark, uneven):
    """Equal rows take different places, and no range holds them all."""
    docs = spark.createDataFrame([(5, "the same", "en", "s", 1)] * 3000 + [(i, f"t{i}", "en", "s", 1) for i in range(100)], DOCS).repartition(4)
    rows = docs.select("lang", "doc_id", F.monotonically_increasing_id().alias("salt"))
    placed = merkle.numbered(rows, "lang", ["doc_id", "salt"])
    assert sorted(r["pos"] for r in placed.collect()) == list(range(3100)) and {r["of"] for r in placed.collect()} == {3100}
    assert Counter(tuple(r) for r in merkle.manifest(docs, merkle.every_third()).collect()) == brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
