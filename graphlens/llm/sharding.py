"""Sharding by a K-d tree over document metadata, balanced by bytes.

The points of the tree are groups of equal texts, weighted by the bytes of all their copies; their
coordinates are size, source, language and lowest id, each scaled to its range. A node for k shards
is cut along its widest dimension at the weighted quantile floor(k/2)/k, and so on down to one shard.
All nodes of a level are cut together. Quantiles come from weighted histograms that are refined around
the wanted weight until what is left in the bin is within ``TOLERANCE`` of a shard; the driver sees
at most ``BINS`` sums per node. Points equal in the dimension are told apart by a hash of their text.

A group heavier than 1/``PARTS`` of a shard, in bytes or in rows, is dealt row by row into chunks below
that, each a point of its own, so rows that agree in every column are split too; at most 2 * ``PARTS`` * shards groups
can be that heavy, so their list is broadcast. Lighter groups stay together. Which row of a heavy group goes to which
chunk depends on where it lies in the input.

Defined results: a null text counts as empty; null ids, sources and languages are ordinary values;
repeated rows count each; an empty table gives an empty table; extra columns are ignored. A shard may
stay empty only where there are fewer chunks than shards, or one row outweighs a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_table

DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")
BINS = 512
PARTS = 16
TOLERANCE = 0.002
SLOT_ROWS = 50_000
_SCALE, _TIE = 2**30 - 1, 2**33


def _points(narrow: DataFrame, shards: int, total: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their chunk, and one weighted point for each chunk."""
    most_bytes, most_rows = max(1.0, total / (shards * PARTS)), max(1.0, rows / (shards * PARTS))
    heavy = (
        narrow.groupBy("gkey")
        .agg(F.sum("size").alias("b"), F.count("*").alias("r"))
        .filter((F.col("r") > 1) & ((F.col("b") > most_bytes) | (F.col("r") > most_rows)))
        .select("gkey", F.least("r", F.ceil(F.greatest(F.col("b") / most_bytes, F.col("r") / most_rows))).alias("chunks"))
    )
    salt = F.pmod(F.xxhash64("doc_id", "source", "lang", "row"), F.coalesce("chunks", F.lit(1)))
    chunked = narrow.join(F.broadcast(heavy), "gkey", "left").withColumn("chunk", salt).drop("chunks")
    points = chunked.groupBy("gkey", "chunk").agg(
        F.sum("size").alias("w"),
        F.log2(F.min("size").cast("double")).alias("d_size"),
        F.min(F.crc32(F.coalesce("source", F.lit("")).cast("binary"))).cast("double").alias("d_source"),
        F.min(F.crc32(F.coalesce("lang", F.lit("")).cast("binary"))).cast("double").alias("d_lang"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("d_id"),
    )
    return chunked, points


def _keyed(points: DataFrame) -> DataFrame:
    """Coordinates as whole numbers, each with the tie-breaking hash below it, so that one long orders a
    dimension.
    """
    ends = points.agg(*[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tie = F.pmod("gkey", F.lit(2**23)) * 1024 + F.pmod("chunk", F.lit(1024))
    keys = []
    for d in DIMENSIONS:
        lo, hi = ends[f"{d}_lo"] or 0.0, ends[f"{d}_hi"] or 0.0
        keys.append((((F.col(d) - lo) * (_SCALE / (hi - lo) if hi > lo else 0.0)).cast("long") * _TIE + tie).alias(d))
    return points.select("gkey", "chunk", "w", *keys)


def _cuts(at: DataFrame, nodes: dict[int, tuple[int, int]], ideal: float) -> list[dict]:
    """Where each node that holds over one shard is cut: node, dim, cut."""
    spark = at.sparkSession
    spans = at.groupBy("node").agg(F.sum("w").alias("w"), *[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))])
    state = {}
    for r in spans.collect():
        if nodes[r["node"]][1] > 1:
            k = nodes[r["node"]][1]
            dim = max(range(len(DIMENSIONS)), key=lambda i: (r[f"{DIMENSIONS[i]}_hi"] // _TIE - r[f"{DIMENSIONS[i]}_lo"] // _TIE, -i))
            state[r["node"]] = {"dim": dim, "lo": r[f"{DIMENSIONS[dim]}_lo"], "hi": r[f"{DIMENSIONS[dim]}_hi"], "below": 0, "want": r["w"] * (k // 2) / k}
    done = []
    while state:
        rows = [{"node": n, "dim": s["dim"], "lo": s["lo"], "hi": s["hi"], "step": max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))} for n, s in state.items()]
        asked = F.broadcast(small_table(spark, rows, "node long, dim int, lo long, hi long, step long"))
        key = F.get(F.array(*DIMENSIONS), F.col("dim"))
        bins = (
            at.join(asked, "node")
            .withColumn("key", key)
            .filter("key between lo and hi")
            .groupBy("node", F.expr("(key - lo) div step").alias("bin"))
            .agg(F.sum("w").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            .collect()
        )
        for node, s in list(state.items()):
            below = s["below"]
            for b in sorted((b for b in bins if b["node"] == node), key=lambda b: b["bin"]):
                if below + b["w"] >= s["want"] or b["hi"] == s["hi"]:
                    break
                below += b["w"]
            s |= {"lo": b["lo"], "hi": b["hi"], "below": below}
            if b["lo"] == b["hi"] or b["w"] <= TOLERANCE * ideal:
                near = s["want"] - below < below + b["w"] - s["want"]
                done.append({"node": node, "dim": s["dim"], "cut": b["lo"] - 1 if near else b["hi"]})
                del state[node]
    return done


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    narrow = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            "lang",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.octet_length(text)).alias("gkey"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    rows, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    chunked, points = _points(narrow, shards, total, rows)
    points = materialize(_keyed(materialize(points, "shard-points")), "shard-keys")
    nodes = {0: (0, shards)}  # id: first shard, number of shards
    at = points.withColumn("node", F.lit(0).cast("long"))
    fresh = 1
    for _ in range(math.ceil(math.log2(max(2, shards)))):
        splits = []
        for c in _cuts(at, nodes, total / shards):
            first, k = nodes[c["node"]]
            nodes |= {fresh: (first, k // 2), fresh + 1: (first + k // 2, k - k // 2)}
            splits.append(c | {"left": fresh, "right": fresh + 1})
            fresh += 2
        if not splits:
            break
        to = F.broadcast(small_table(spark, splits, "node long, dim int, cut long, left long, right long"))
        side = F.when(F.get(F.array(*DIMENSIONS), F.col("dim")) <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
        at = at.join(to, "node", "left").withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(side)).drop("dim", "cut", "left", "right")
        # written, so that a level reads the one before and not all of them
        at = materialize(at, "shard-level")
    leaf = F.broadcast(small_table(spark, [{"node": n, "shard": first} for n, (first, _) in nodes.items()], "node long, shard int"))
    leaves = at.join(leaf, "node").select("gkey", "chunk", "shard")
    buckets = max(1, -(-rows // (shards * SLOT_ROWS)))
    placed = materialize(
        chunked.join(leaves, ["gkey", "chunk"]).select("doc_id", "size", "text_crc32", "gkey", "row", "shard", F.pmod(F.xxhash64("doc_id", "gkey", "row"), F.lit(buckets)).alias("bucket")),
        "shard-placed",
    )
    starts = placed.groupBy("shard", "bucket").count()
    starts = starts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "gkey", "row")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
