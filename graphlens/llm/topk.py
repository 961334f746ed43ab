"""Exact top-k inner products with bounds from segment statistics, coarse to fine.

A vector is cut into segments; each keeps its mean m and its deviation s. For two vectors the inner
product of a segment of n components is at most n * (m1 * m2 + s1 * s2), since the parts around the means
are orthogonal to constants and Cauchy-Schwarz bounds their product; equally, this is a lower bound of
the distance. All bounds of a block are one matrix product of the statistics. ``LEVELS`` segments are
tried in turn, and only pairs whose bound reaches the query's k-th best exact score so far go on; what is
left is scored exactly.

Candidates and queries are packed into blocks of bounded bytes, and blocks are dealt into a grid: a cell holds
about ``CELL`` blocks of candidates and of queries, makes each block's statistics once, and lets what a query
has reached in one block bound the next. A block travels once for each ``CELL`` blocks of the other
side, and a cell sends at most k rows per query on. The last ranking is by query.

Components become floor(scale * x). Defined results: null vectors, vectors with null or non-finite
components, empty vectors and null ids take no part; vectors of another length than the query's are no
candidates; rows with the query's own id are its own; of rows that repeat a query's id the smallest
vector asks; repeated candidates count each; ties go to the smaller id; scores beyond 64 bits are held at
the limits. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEVELS = (4, 16, 32)
CANDIDATES, QUERIES = 8192, 512
#: Bytes of a block at most, and blocks of candidates and of queries in a cell, about.
BLOCK_BYTES, CELL = 4 << 20, (16, 64)
_PACKED = "dims int, ids binary, data binary"
#: Above this share of surviving pairs, survivors are scored by one matrix product of the block.
DENSE = 0.02


def _valid(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)


def _pack(valid: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of vectors of one length, about ``size`` of them or ``BLOCK_BYTES``, whichever is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def full(d: int) -> int:
            return max(1, min(size, BLOCK_BYTES // (8 * d)))

        def block(d: int) -> pa.RecordBatch:
            ids, data = zip(*held.pop(d))
            return pa.RecordBatch.from_pydict({"dims": [d], "ids": [np.concatenate(ids).tobytes()], "data": [np.concatenate(data).tobytes()]}, schema=pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

        for b in batches:
            longest = int(b.column("x").value_lengths().to_numpy().max(initial=1))
            for at in range(0, b.num_rows, full(longest)):
                part = b.slice(at, full(longest))
                ids, x = part.column("vec_id").to_numpy(), part.column("x")
                lengths, flat = x.value_lengths().to_numpy(), np.floor(scale * x.flatten().to_numpy())
                starts = np.cumsum(lengths) - lengths
                for d in np.unique(lengths).tolist():
                    pick = np.flatnonzero(lengths == d)
                    held.setdefault(d, []).append((ids[pick], flat[starts[pick, None] + np.arange(d)]))
                    if sum(len(i) for i, _ in held[d]) >= full(d):
                        yield block(d)
        for d in list(held):
            yield block(d)

    return valid.mapInArrow(run, _PACKED)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound the inner products of ``x``'s rows: weighted means and deviations."""
    out = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        seg = x[:, part]
        mean = seg.mean(1)
        out += [mean * np.sqrt(len(part)), np.sqrt(((seg - mean[:, None]) ** 2).sum(1))]
    return np.stack(out, 1)


def _whole(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether inner products are whole numbers in double precision, in any order of summation."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2.0**53


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products as 64-bit integers."""
    if _whole(q, x):
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(r, s)), ends.min), ends.max) for r, s in zip(q, x)], np.int64)


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf in rows with fewer columns."""
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] >= k else np.full(len(score), -np.inf)


class Block:
    """Vectors of one length, and their statistics, each level made once."""

    def __init__(self, ids: bytes, data: bytes, dims: int):
        self.ids, self.x = np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dims)
        self._made: dict[int, np.ndarray] = {}

    def at(self, level: int) -> np.ndarray:
        if level not in self._made:
            self._made[level] = segment_statistics(self.x, level)
        return self._made[level]


def block_survivors(queries: Block, block: Block, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, candidate, score of all that can be among a query's k best; ``least`` is the score that
    each query has reached k times elsewhere.
    """
    q, x = queries.x, block.x
    alive = queries.ids[:, None] != block.ids[None, :]
    kth = None
    for level in LEVELS:
        sq, sx = queries.at(level), block.at(level)
        slack = 1 + 1e-9 * np.sqrt((sq**2).sum(1)) * np.sqrt((sx**2).sum(1).max(initial=0))
        bound = sq @ sx.T
        if kth is None:
            seeds = np.argpartition(np.where(alive, -bound, np.inf), min(4 * k, len(x)) - 1, axis=1)[:, : 4 * k]
            rows = np.repeat(np.arange(len(q)), seeds.shape[1])
            seen = np.where(alive[rows, seeds.ravel()], _exact(q[rows], x[seeds.ravel()]).astype(float), -np.inf)
            kth = np.maximum(least, _kth(seen.reshape(len(q), -1), k))
        alive &= bound >= (kth - slack - 2.0**-40 * np.abs(np.where(np.isfinite(kth), kth, 0)))[:, None]
        if alive.mean() < DENSE:
            break
    if alive.mean() >= DENSE and _whole(q, x):
        score = np.where(alive, q @ x.T, -np.inf)
        i, j = np.nonzero(alive & (score >= _kth(score, k)[:, None]))
        return i, block.ids[j], score[i, j].astype(np.int64)
    i, j = np.nonzero(alive)
    return i, block.ids[j], np.concatenate([_exact(q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.empty(0, np.int64)])


def top_of(queries: Block, blocks: list[Block], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, candidate, score of each query's k best in all blocks, ties to smaller ids."""
    row, cand, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.full(len(queries.ids), -np.inf)
    for block in blocks:
        row, cand, score = (np.concatenate(c) for c in zip((row, cand, score), block_survivors(queries, block, k, least)))
        order = np.lexsort((cand, ~score, row))
        row, cand, score = row[order], cand[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        least[row[rank == k - 1]] = score[rank == k - 1]
        row, cand, score = row[rank < k], cand[rank < k], score[rank < k]
    return queries.ids[row], cand, score


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best others."""
    valid = _valid(vectors)
    asking = valid.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = materialize(_pack(valid, CANDIDATES, scale), "topk-candidates")
    asked = materialize(_pack(asking, QUERIES, scale), "topk-queries")
    across, down = (-(-max(1, t.count()) // n) for t, n in zip((blocks, asked), CELL))
    # small inputs get as many cells as there are tasks
    across = max(across, -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // down))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n).cast("long"))
    left = blocks.select("*", dealt(across).alias("across"), every_one(down).alias("down"))
    right = asked.select("*", every_one(across).alias("across"), dealt(down).alias("down"))

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        x, q = ([Block(r["ids"], r["data"], r["dims"]) for r in t.select(["ids", "data", "dims"]).to_pylist()] for t in (candidates, queries))
        found = [top_of(block, x, k) for block in q] if x else []
        columns = zip(*found) if found else [[np.empty(0, np.int64)]] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, columns))))

    cell = ["dims", "across", "down"]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
