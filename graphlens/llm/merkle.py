"""A Merkle manifest of a table: every row a leaf, a tree for each language, one root over all, a proof for each row.

A leaf is the SHA-256 of the row's fields, each as its byte count, a colon and its value, or ``-`` if null. A language's
leaves ascend by id; eight consecutive nodes become the digest of their digests until one is left, the language's subroot;
subroots in order of language become the root in the same way. Digests are concatenated as lowercase hex.

Blocks. Leaves are numbered within their language by a range shuffle, and every ``BLOCK`` (a power of eight) of them are
one row of a written table. Tasks reduce each block to one node. As long as more than ``TOP`` nodes are left, these are
packed and reduced in the same way; the rest is the top of the trees. The driver gets at most ``TOP`` nodes at a time,
builds the top and hands out each node's suffix: its siblings from there upwards, to the subroot and on to the root.
Tasks then build each block's lower levels again and finish for each row the proof and the fold of its own digests and
the suffix. Suffixes are broadcast while there are at most ``TOP``; more of them meet their blocks in a join, one
to one, so no language or id is a hot key in it.

Defined results: null ids come first and are not tampered with; rows of one id go by their digest, and rows equal in
all five columns follow each other in any order (they are interchangeable); null and '' are different languages, null
first; languages are compared by UTF-8 bytes; an empty table has no root and gives an empty table; texts of any
length are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of

FAN = 8
#: Nodes of a block, and nodes that the driver gets or sends at most.
BLOCK, TOP = FAN**4, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "k string, pos long, digest string"
_PATH = "k string, pos long, lefts array<string>, rights array<string>, top string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of the fields, so marked that no two rows have the same text."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]), 256)


def levels(nodes: list[str], least: int = 0) -> list[list[str]]:
    """The levels of a tree, up to one node and at least ``least`` levels above ``nodes``."""
    out = [nodes]
    while len(out[-1]) > 1 or len(out) <= least:
        out.append([sha("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(tree: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of the node's ancestors in their runs, level by level, digests joined."""
    left, right = [], []
    for level in tree[:-1]:
        first = at - at % FAN
        left.append("".join(level[first:at]))
        right.append("".join(level[at + 1 : first + FAN]))
        at //= FAN
    return left, right


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        digest = sha(left + digest + right)
    return digest


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``pos``, gapless from 0 in each group, and ``of``, the group's rows.

    A range shuffle by group and order cuts large groups; what a partition holds of a group begins after what the partitions
    before it hold.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-placed")
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(group, "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(Window.partitionBy(group)).alias("of"))
    return placed.join(starts, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def packed(nodes: DataFrame, *carried: str) -> DataFrame:
    """k, pos, of, items: one row for ``BLOCK`` consecutive nodes of a group; pos is the block's, of the number of its group's nodes."""
    of_block = nodes.groupBy("k", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("of").alias("of"), F.array_sort(F.collect_list(F.struct("pos", "digest", *carried))).alias("items"))
    return of_block.withColumnRenamed("block", "pos")


def height(of: int) -> int:
    """How many levels a block is reduced by at least: all, unless it is its group's only one."""
    deep = 0
    while FAN**deep < BLOCK:
        deep += 1
    return deep if of > BLOCK else 0


def _items(b: pa.RecordBatch, name: str) -> Iterator[list]:
    """That field of the items of each row."""
    items = b.column("items")
    values = items.values.field(name)
    for s, e in zip(items.offsets.to_pylist(), items.offsets.to_pylist()[1:]):
        yield values.slice(s, e - s).to_pylist()


def block_roots(blocks: DataFrame) -> DataFrame:
    """k, pos, of, digest: the node that each block becomes, its place among those of its group and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column("of").to_pylist()
            digest = [levels(nodes, height(n))[-1][0] for nodes, n in zip(_items(b, "digest"), of)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("pos"), pa.array([-(-n // BLOCK) for n in of], pa.int64()), pa.array(digest)], names=["k", "pos", "of", "digest"])

    return blocks.select("k", "pos", "of", "items").mapInArrow(run, "k string, pos long, of long, digest string")


def hinted(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast if its size is known to be small."""
    return F.broadcast(small) if rows <= TOP else small


def paths(nodes: DataFrame) -> DataFrame:
    """k, pos, lefts, rights, top: of each node the siblings up to its group's root, and that root.

    ``nodes``: k, pos, of, digest. Nodes that are alone in their group have none.
    """
    spark = nodes.sparkSession
    alone = nodes.filter("of = 1").select("k", "pos", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.col("digest").alias("top"))
    several = nodes.filter("of > 1")
    count = several.count()
    if not count:
        return alone
    if count <= TOP:
        groups: dict[str, dict[int, str]] = {}
        for r in several.collect():
            groups.setdefault(r["k"], {})[r["pos"]] = r["digest"]
        rows = []
        for k, of in groups.items():
            tree = levels([of[i] for i in range(len(of))])
            rows += [(k, i, *siblings(tree, i), tree[-1][0]) for i in range(len(of))]
        return alone.unionByName(spark.createDataFrame(rows, _PATH))
    blocks = materialize(packed(several), "merkle-nodes")
    above = materialize(paths(materialize(block_roots(blocks), "merkle-roots")), "merkle-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in rows_of([b], 1)):
            tree = levels(next(_items(b, "digest")), height(b.column("of")[0].as_py()))
            lefts, rights, top = (b.column(c)[0].as_py() for c in ("lefts", "rights", "top"))
            for first in range(0, len(tree[0]), 512):
                own = [siblings(tree, i) for i in range(first, min(first + 512, len(tree[0])))]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("k")[0].as_py()] * n), pa.array(range(b.column("pos")[0].as_py() * BLOCK + first, b.column("pos")[0].as_py() * BLOCK + first + n), pa.int64()), pa.array([x + lefts for x, _ in own]), pa.array([y + rights for _, y in own]), pa.array([top] * n)],
                    names=["k", "pos", "lefts", "rights", "top"],
                )

    joined = blocks.join(hinted(above, blocks.count()), ["k", "pos"]).select("k", "pos", "of", "items", "lefts", "rights", "top")
    return alone.unionByName(joined.mapInArrow(run, _PATH))


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    ``tamper`` says of which rows the text is lower-cased (A-Z) before their leaf is folded with the original siblings; null: of none.
    """
    fields = [F.col(f) for f in FIELDS]
    forged = leaf_digest([*fields[:-1], F.translate("text", string.ascii_uppercase, string.ascii_lowercase)])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("k"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(fields).alias("digest"),
        F.when(F.lit(False) if tamper is None else tamper, forged).alias("forged"),
        # cuts the range of a row that is repeated very often
        F.monotonically_increasing_id().alias("salt"),
    )
    rows = numbered(materialize(leaves, "merkle-leaves"), "k", ["doc_id", "digest", "salt"])
    blocks = materialize(packed(rows, "doc_id", "forged"), "merkle-blocks")
    to_subroot = materialize(paths(materialize(block_roots(blocks), "merkle-roots")), "merkle-paths")
    subroots = numbered(to_subroot.groupBy("k").agg(F.first("top").alias("digest")).withColumn("all", F.lit("")), "all", ["k"])
    subroots = materialize(subroots, "merkle-subroots")
    to_root = paths(subroots.select(F.col("all").alias("k"), "pos", "of", "digest")).select("pos", F.col("lefts").alias("up_left"), F.col("rights").alias("up_right"), F.col("top").alias("root"))
    langs, units = subroots.count(), to_subroot.count()
    of_lang = subroots.select("k", "pos").join(hinted(to_root, langs), "pos").drop("pos")
    suffixes = to_subroot.join(hinted(of_lang, langs), "k").select("k", "pos", F.concat("lefts", "up_left").alias("lefts"), F.concat("rights", "up_right").alias("rights"), F.col("top").alias("subroot"), "root")
    suffixes = materialize(suffixes, "merkle-suffixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in rows_of([b], 1)):
            ids, digests, forged = (next(_items(b, f)) for f in ("doc_id", "digest", "forged"))
            tree = levels(digests, height(b.column("of")[0].as_py()))
            lefts, rights, subroot, root = (b.column(c)[0].as_py() for c in ("lefts", "rights", "subroot", "root"))
            upper = "".join(x + y for x, y in zip(lefts, rights))
            proof, folded = [], []
            for i, (own, other) in enumerate(zip(digests, forged)):
                left, right = siblings(tree, i)
                proof.append(sha("".join(x + y for x, y in zip(left, right)) + upper))
                folded.append(fold(fold(other or own, left, right), lefts, rights))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests), pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    joined = blocks.join(hinted(suffixes, units), ["k", "pos"]).select("of", "items", "lefts", "rights", "subroot", "root")
    return joined.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def every_third(doc_id: str = "doc_id") -> Column:
    """Whether 3 divides the CRC-32 of the id in decimal; not for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _climb(name: str, steps: int) -> str:
    """CTEs of ``steps`` levels above {name}0 (k, p, h), and their siblings {name}_s (k, level, p, l, r)."""
    out = []
    for i in range(steps):
        out.append(f"{name}n{i} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM {name}{i})")
        out.append(f"{name}{i + 1} AS (SELECT k, p // 8 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}n{i} WHERE c > 1 GROUP BY k, p // 8)")
    each = " UNION ALL ".join(
        f"""SELECT a.k, {i} AS level, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
       coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
FROM {name}n{i} a JOIN {name}n{i} b ON a.k = b.k AND a.p // 8 = b.p // 8 WHERE a.c > 1 GROUP BY a.k, a.p"""
        for i in range(steps)
    )
    out.append(f"{name}_s AS MATERIALIZED ({each})")
    out.append(f"{name}_top AS MATERIALIZED ({' UNION ALL '.join(f'SELECT k, h FROM {name}n{i} WHERE c = 1' for i in range(steps))})")
    return ",\n".join(out)


def _walk(name: str, tree: str, start: str, key: str, steps: int) -> str:
    """CTEs {name}0.. that follow each row of ``start`` (k, p, proof, f) up that many levels."""
    out = [f"{name}0 AS ({start})"]
    for i in range(steps):
        out.append(
            f"""{name}{i + 1} AS (SELECT d.* REPLACE (d.proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.l IS NULL THEN d.f ELSE sha256(s.l || d.f || s.r) END AS f)
  FROM {name}{i} d LEFT JOIN {tree}_s s ON s.k = {key} AND s.level = {i} AND s.p = d.p // {8**i})"""
        )
    return ",\n".join(out)


#: Levels that the SQL has: for 8 ** 8 rows of a language and 8 ** 3 languages.
_LOW, _HIGH = 9, 4
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: CRC-32 of the id's digits, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
               lambda crc, c: list_reduce(range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(crc, c)), 4294967295::BIGINT), 4294967295)"""


def oracle() -> str:
    head = " || ".join(_FIELD.format(f) for f in FIELDS[:-1])
    return f"""WITH
d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS k, sha256({head} || {_FIELD.format("text")}) AS h, sha256({head} || {_FIELD.format(_LOWER)}) AS low,
         coalesce({_CRC} % 3 = 0, false) AS tampered
  FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d),
a0 AS (SELECT k, p, h FROM l),
{_climb("a", _LOW)},
b0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS p, h, k AS lang FROM a_top),
{_climb("b", _HIGH)},
{_walk("x", "a", "SELECT doc_id, k, p, h, '' AS proof, CASE WHEN tampered THEN low ELSE h END AS f FROM l", "d.k", _LOW)},
{_walk("y", "b", f"SELECT x.doc_id, x.h, x.proof, x.f, b0.h AS subroot, b0.p FROM x{_LOW} x JOIN b0 ON b0.lang = x.k", "''", _HIGH)}
SELECT doc_id, h AS leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM y{_HIGH} CROSS JOIN (SELECT h AS root FROM b_top)
"""
