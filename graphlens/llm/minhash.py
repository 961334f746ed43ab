"""Near-duplicate groups by bottom-k sketches of one hash function, for sets of word 5-grams with a similarity of at least 0.85.

A document's sketch is the ``K`` smallest of the 64-bit hashes of its set; documents with the same set are one class.

Lists. The ``K`` smallest hashes of a union are a sample of it, drawn without regard to which set has them. Of two sets
that reach the threshold at least ``RETAINED`` of these are in both, so in both sketches: fewer come up with a chance
below 10 ** -``SURE`` (the binomial tail, which a draw without replacement stays under). If the union has no more than
``K`` hashes, the sample is all of it and the count is certain. So in any one order of all values the sketches share
one of their first n - m + 1, m being the least they share; those values are the keys of the inverted lists. The order puts
values that many documents retain last, by counters over the sketches of all documents, so passages that many documents
share make no lists but for families of copies. The order decides only what work there is.

Estimates. Classes of one list are compared by the sketch of their union: the values that both retain, among its ``K``
smallest; pairs with too few are dropped. An estimate from ``K`` values lets similarities from about 0.6 through, so pairs
must meet a bound as well: parities of counts by groups of hashes, which differ in at most as many groups as there are
members that one set has alone. What is left is verified on the whole sets.

Lists of thousands of near copies go by way of their smallest class first, large lists are worked on in pairs of parts,
and pairs whose ends are connected already are left out, as in the n-gram join; no link between components is lost
but by the chance above.

Defined results: words are split at spaces and \\t to \\r after lower-casing A-Z; fewer than five words make one n-gram of
all of them; null and wordless texts have an empty set, link with nothing and are kept; repeated rows and equal ids
count each, so rows that repeat the kept id are all marked as kept; a component's id is its smallest id, and a null id
never names a component that has another and is not kept in one; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of
from .jaccard_join import _NONE, components_of_runs, fold_parity, frequency_levels, group_parity, hot_runs, mix64, second_signature, shared_runs, shingle_sets, signature, sketch_bits, told_apart, verified, with_components
from .jaccard_join import may_link as bound_holds

#: Values that a sketch retains, and the digits of the chance that a link goes unseen.
K, SURE = 128, 12
NUM, DEN = 85, 100
_PAD = np.uint64(2**64 - 1)
#: Retained values to a counter of the sketch of frequencies, about.
PER_COUNTER = 4
#: Pairs of a list that are looked at together.
PAIRS = 200_000


def retained(k: int = K, num: int = NUM, den: int = DEN, sure: int = SURE) -> int:
    """The largest m for which fewer than m of k draws hit a share of num / den with a chance of at most 10 ** -sure."""
    p, tail, m = Fraction(num, den), Fraction(0), 0
    while tail + (term := math.comb(k, m) * p**m * (1 - p) ** (k - m)) <= Fraction(1, 10**sure):
        tail += term
        m += 1
    return m


RETAINED = retained()


def least_shared(n: int) -> int:
    """How many values the sketch of a set of n shares at least with that of any set it links with."""
    return min(-(-NUM * n // DEN), RETAINED) if n <= K else RETAINED


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig, twin, sketch, parity for each row; the sketch in ascending order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1024):
            n, sig, twin, sketch, parity = [], [], [], [], []
            for h in shingle_sets(b.column("text").to_pylist()):
                n.append(len(h))
                sig.append(signature(h))
                twin.append(second_signature(h))
                sketch.append(h[:K].tobytes())
                parity.append(group_parity(h) if len(h) else b"")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(twin, pa.int64()), pa.array(sketch, pa.binary()), pa.array(parity, pa.binary())], names=["doc_id", "n", "sig", "twin", "sketch", "parity"])

    return docs.mapInArrow(run, "doc_id long, n long, sig long, twin long, sketch binary, parity binary")


def _mixed(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The retained values of a batch. They are small as hashes, so they are hashed again to spread over counters."""
    for s in b.column("sketch"):
        yield mix64(np.frombuffer(s.as_py(), np.uint64))


def list_keys(classes: DataFrame, levels) -> DataFrame:
    """h, sig, hot: the values under which a class is listed; hot ones are retained by many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        shift = np.uint64(65 - len(level).bit_length())
        for b in rows_of(batches, 4096):
            keys, hot, held = [], [], []
            for n, s in zip(b.column("n").to_pylist(), b.column("sketch")):
                values = np.frombuffer(s.as_py(), np.uint64)
                of = level[(mix64(values) >> shift).astype(np.int64)]
                first = np.argsort(of, kind="stable")[: len(values) - least_shared(n) + 1]
                keys.append(values[first].view(np.int64))
                hot.append(of[first] > 0)
                held.append(len(first))
            sig = np.repeat(b.column("sig").to_numpy(), held)
            if len(sig):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(sig), pa.array(np.concatenate(hot))], names=["h", "sig", "hot"])

    return classes.select("sig", "n", "sketch").mapInArrow(run, "h long, sig long, hot boolean")


def union_sketch(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sketches: how many of the ``K`` smallest values of the union (or of all, if fewer) are in both, and how many
    values those are.
    """
    both = np.full((len(a), 2 * K), _PAD)
    for row, x, y in zip(both, a, b):
        row[: len(x)] = x
        row[K : K + len(y)] = y
    both.sort(1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    fresh = np.column_stack([np.ones(len(both), bool), ~twice]) & (both != _PAD)
    rank = fresh.cumsum(1)
    return (twice & (rank[:, 1:] <= K)).sum(1), np.minimum(rank[:, -1], K)


def may_link(na: np.ndarray, nb: np.ndarray, shared: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may reach the threshold: for certain where the union is known whole."""
    whole = (na <= K) & (nb <= K) & (na + nb - shared <= K)
    near = DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)
    return near & np.where(whole, DEN * shared >= NUM * of, shared >= RETAINED)


class Parities:
    """The parity vectors of a list's classes in all their lengths, so that many pairs are compared at once."""

    def __init__(self, packed: list[bytes]):
        self.sizes = np.array([len(p) for p in packed])
        self.folded = {}
        for size in np.unique(self.sizes).tolist():
            at = np.flatnonzero(self.sizes >= size)
            self.folded[size] = np.zeros((len(packed), size // 8), np.uint64)
            self.folded[size][at] = np.frombuffer(b"".join(fold_parity(packed[i], size) for i in at.tolist()), np.uint64).reshape(len(at), -1)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many groups the vectors of each pair differ."""
        low = np.minimum(self.sizes[i], self.sizes[j])
        out = np.zeros(len(low), np.int64)
        for size in np.unique(low).tolist():
            at = low == size
            out[at] = np.bitwise_count(self.folded[size][i[at]] ^ self.folded[size][j[at]]).sum(1, dtype=np.int64)
        return out


def sketch_finder(table: pa.Table, label: np.ndarray, earlier: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of different labels and with no common value in ``earlier`` that the parities and the union sketch let through, each
    once, and how far apart they are. Where some rows are ``second``, only pairs of one of them with one of the others.
    """
    values = [np.frombuffer(s, np.uint64) for s in table.column("sketch").to_pylist()]
    parities = Parities(table.column("parity").to_pylist())
    n = table.column("n").to_numpy()
    rows = np.arange(len(label))

    def passed(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        near = (label[i] != label[j]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
        i, j = i[near], j[near]
        apart = parities.apart(i, j)
        near = bound_holds(n[i], n[j], apart, NUM, DEN)
        i, j, apart = i[near], j[near], apart[near]
        first = ~((earlier[i][:, :, None] == earlier[j][:, None, :]) & (earlier[i][:, :, None] != _NONE)).any((1, 2))
        i, j, apart = i[first], j[first], apart[first]
        for part in np.array_split(np.arange(len(i)), len(i) // 4096 + 1):
            p, q = i[part], j[part]
            keep = may_link(n[p], n[q], *union_sketch([values[x] for x in p.tolist()], [values[x] for x in q.tolist()]))
            if keep.any():
                yield p[keep], q[keep], (apart[part] / (n[p] + n[q]))[keep]

    # rows of the commonest label are not asked: they are met by the others
    _, of, count = np.unique(label, return_inverse=True, return_counts=True)
    minor = of != count.argmax() if len(count) < len(label) else np.ones(len(label), bool)
    sides = [(rows[minor & second], rows[~second]), (rows[minor & ~second], rows[second])] if second.any() else [(rows[minor], rows)]
    for ask, others in sides:
        for asked in np.array_split(ask, len(ask) * len(others) // PAIRS + 1):
            i, j = np.repeat(asked, len(others)), np.tile(others, len(asked))
            once = ~minor[j] | (i < j)
            yield from passed(i[once], j[once])


def estimated_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link by the sketch of their union."""
    side = lambda x: classes.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 2048):
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(c).to_pylist()] for c in ("sa", "sb"))
            keep = pa.array(may_link(b.column("na").to_numpy(), b.column("nb").to_numpy(), *union_sketch(x, y)))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, apart = told_apart(materialize(sketches(docs), "minhash-rows"))
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("smallest"), F.min(F.coalesce("doc_id", F.lit(0))).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    classes = materialize(classes, "minhash-classes")
    points = classes.select("sig", "n", "sketch", "parity")
    values = classes.agg(F.sum(F.octet_length("sketch") / 8)).first()[0] or 0
    levels = spark.sparkContext.broadcast(frequency_levels(classes.select("sketch"), sketch_bits(values, PER_COUNTER), _mixed))
    keys = materialize(list_keys(classes, levels), "minhash-keys")
    runs = shared_runs(keys.filter("not hot").select("h", "sig")).unionByName(hot_runs(keys.filter("hot").select("h", "sig")))
    runs = materialize(runs, "minhash-runs")
    labels = components_of_runs(runs, points, estimated_pairs, sketch_finder, lambda pairs: verified(docs, classes, pairs, apart, NUM, DEN))
    return with_components(rows, classes, labels).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
t AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS s
  FROM w),
e AS (SELECT r, unnest(s) AS g FROM t),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN t x ON x.r = p.a JOIN t y ON y.r = p.b WHERE 100 * shared >= 85 * (len(x.s) + len(y.s) - shared)),
c AS (
  WITH RECURSIVE reach(v, u) AS (SELECT r, r FROM t UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.u)
  SELECT v, min(t.doc_id) AS component_id FROM reach JOIN t ON t.r = reach.u GROUP BY v)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept FROM t JOIN c ON c.v = t.r
"""
