"""The labelled examples that models learn from: a sample whose rows and bytes are bounded.

Rows with crc32(id as text) mod 5 = 0 are held out. Of the rest, at most ``rows`` ids of each class are taken in
the order of a hash of the id; an id is one example, however often ``labels`` or ``docs`` repeat it: its label is
the largest one given, its text the one whose digest is smallest. Texts are then taken in that order while they
fit ``size`` bytes of their class: one that does not fit is passed over, and the shorter ones after it are
taken. Null ids and labels other than 0 and 1 teach nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, small_table

#: Rows of each class, and bytes of all their texts.
EXAMPLES, TRAIN_BYTES = 1500, 24_000_000


def fitting(rows: list[tuple[int, int]], most: int) -> list[bool]:
    """Whether each (label, bytes) still fits ``most`` bytes of its label, taken in order; what does not fit is passed over."""
    left: dict[int, int] = {}
    out = []
    for label, size in rows:
        room = left.setdefault(label, most)
        out.append(size <= room)
        left[label] = room - size * out[-1]
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = EXAMPLES, size: int = TRAIN_BYTES) -> tuple[list[tuple[int, int, bytes]], dict[int, int]]:
    """The examples as (id, label, UTF-8 text) in order of ids, and how many ids of each class there are to learn from."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = materialize(known, f"{label}-labels")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return [], counts
    turn = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sample = known.filter("label = 0").orderBy(turn, "doc_id").limit(rows).unionByName(known.filter("label = 1").orderBy(turn, "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    once = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.md5("raw").alias("digest"), "raw")).alias("of"))
    examples = materialize(once.select("doc_id", "label", "of.raw"), f"{label}-examples")
    sized = examples.select("doc_id", "label", F.octet_length("raw").alias("size")).orderBy(turn, "doc_id").collect()
    chosen = [{"doc_id": r["doc_id"]} for r, fits in zip(sized, fitting([(r["label"], r["size"]) for r in sized], size // 2)) if fits]
    if not chosen:
        return [], counts
    found = examples.join(F.broadcast(small_table(docs.sparkSession, chosen, "doc_id long")), "doc_id").collect()
    return sorted((r["doc_id"], r["label"], bytes(r["raw"])) for r in found), counts
