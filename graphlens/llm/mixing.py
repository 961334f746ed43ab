"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a queue of its documents in a seeded random order (a hash of id and text), passed ``epochs`` times. A copy's
virtual finish time is the words its source has sent up to and with it, divided by the source's
target. Copies are taken in the order of finish time until the total budget is reached.

Running sums are made in two steps, sums of hash buckets first and then sums within a bucket, so a source or an
id with a third of all rows is spread over all tasks; only rows that agree in id and text share a bucket for
certain. The copies are not sorted as a whole, which would move all of them: finish times are cut into equal
ranges, range sums find the one range in which the budget ends, and only that range is sorted and cut.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated
rows are taken on their own; a source without words has target 0; an empty table gives an empty table;
ties in finish time go by source. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_table, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Rows that one bucket of a running sum holds, about.
BUCKET_ROWS = 20_000


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=(3, 2), epochs: int = 2) -> DataFrame:
    """One row per source: source_key, source_size, target.

    Targets share ``budget`` (a fraction) of all sizes by weight; a target stops at ``epochs`` times
    its source's size and the excess is shared again by weight. Solved exactly: with sources in order
    of cap / weight, the first one that stays below its cap gives the level for it and all after it.
    The windows run over one row per source, which is what bounds them.
    """
    num, den = budget
    by = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy((F.col("source_key") == "").asc(), "source_key")) - 1
    every = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        by.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (rank % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("free", num * F.col("total") - den * F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("open", F.col("free") * F.col("w") <= den * F.col("cap") * F.col("rest"))
        .withColumn("at", F.row_number().over(order))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("at", "free", "rest"))).over(every))
    )
    shared = (F.col("first.free") * F.col("w")).cast("double") / (den * F.col("first.rest")).cast("double")
    capped = F.col("first").isNull() | (F.col("at") < F.col("first.at"))
    return level.select("source_key", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget=(3, 2), epochs: int = 2, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns to ``carry``: one row for each row of ``docs``.

    ``taken`` is size times the copies taken, at most ``epochs``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    sizes = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            _source_key(F.col("source")).alias("source_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            shuffled.alias("h"),
            *carry,
        ),
        "mix-sizes",
    )
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-n // BUCKET_ROWS))
    targets = source_targets(sizes, weights, budget, epochs)
    sizes = sizes.withColumn("bucket", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    sums = sizes.groupBy("source_key", "bucket").agg(F.sum("size").alias("in_bucket"))
    queue = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("start", F.coalesce(F.sum("in_bucket").over(queue), F.lit(0)))
        .join(targets, "source_key")
        .select("source_key", "bucket", "start", "source_size", "target")
    )
    within = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = materialize(
        sizes.withColumn("run", F.sum("size").over(within))
        .join(starts, ["source_key", "bucket"])
        .select("doc_id", "source_key", "size", "source_size", "target", (F.col("start") + F.col("run")).alias("sent"), *carry),
        "mix-queued",
    )
    num, den = budget
    copies = (
        queued.filter("size > 0")
        .select("source_key", "size", F.explode(F.array(*[(F.col("sent") + e * F.col("source_size")) / F.col("target") for e in range(epochs)])).alias("finish"))
        .withColumn("range", F.floor(F.col("finish") * buckets))
    )
    ranges = copies.groupBy("range").agg(F.sum("size").alias("s"))
    ends = ranges.select("range", "s", F.sum("s").over(Window.orderBy("range")).alias("upto"))
    last = ends.filter(F.col("upto") * den > num * total).orderBy("range").limit(1).collect()
    if last:
        room = num * total - den * (last[0]["upto"] - last[0]["s"])
        order = Window.orderBy("finish", "source_key").rowsBetween(Window.unboundedPreceding, 0)
        cut = (
            copies.filter(F.col("range") == last[0]["range"])
            .withColumn("run", F.sum("size").over(order))
            .filter(F.col("run") * den > room)
            .agg(F.min(F.struct("finish", "source_key")).alias("cut"))
        )
        cut = small_table(spark, [{"f": (c := cut.first()["cut"])["finish"], "k": c["source_key"]}], "f double, k string")
        f, k = cut.first()
    else:
        f, k = float("inf"), ""
    taken = F.lit(0).cast("long")
    for e in range(epochs):
        finish = (F.col("sent") + e * F.col("source_size")) / F.col("target")
        under = (finish < F.lit(f)) | ((finish == F.lit(f)) & (F.col("source_key") < F.lit(k)))
        taken = taken + F.when((F.col("size") > 0) & under, F.col("size")).otherwise(0)
    return queued.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *carry)


#: Copies of one row that one task writes at most.
COPIES = 1000


def mixed_documents(docs: DataFrame, **mixing) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; rows of one id with equal text and source count
    as one row taken as often as all of them. Documents without words are not taken.
    """
    of_id, none, key, n, copy, part = unused(docs, "of_id", "none", "key", "copies", "copy", "part")
    same = [of_id, none, key]
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(of_id), F.col("doc_id").isNull().alias(none), F.xxhash64("text", "source").alias(key))
    taken = mix(keyed, carry=tuple(same), **mixing).filter("taken > 0")
    copies = materialize(taken.groupBy(*same).agg(F.sum(F.expr("taken div size")).alias(n)), "mix-copies")
    # one shuffle of the texts serves the deduplication and both joins
    once = keyed.dropDuplicates(same)
    few = once.join(copies.filter(F.col(n) <= COPIES), same)
    few = few.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    # a row that is taken very often is written by several tasks
    many = once.join(copies.filter(F.col(n) > COPIES), same)
    many = many.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES)))).repartition(*same, part)
    many = many.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col(n) - F.col(part) * COPIES))))
    return few.select(docs.columns).unionByName(many.select(docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS h
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY k = '', k) - 1) % 3 + 1)::INT]::BIGINT AS w, 2 * source_size AS cap FROM s),
c AS (
  SELECT *, 3 * sum(source_size) OVER ()::BIGINT
            - 2 * coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS free,
         (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         row_number() OVER (ORDER BY cap::DOUBLE / w, k) AS pos
  FROM r),
f AS (SELECT pos, free, rest FROM c WHERE free * w <= 2 * cap * rest ORDER BY pos LIMIT 1),
t AS (
  SELECT c.k, c.source_size,
         CASE WHEN f.pos IS NULL OR c.pos < f.pos THEN c.cap::DOUBLE ELSE (f.free * c.w)::DOUBLE / (2 * f.rest)::DOUBLE END AS target
  FROM c LEFT JOIN f ON true),
q AS (
  SELECT d.doc_id, d.k, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS sent,
         row_number() OVER () AS rid
  FROM d JOIN t USING (k)),
e AS (SELECT rid, size, k, (sent + x * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS v(x) WHERE size > 0),
g AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e),
u AS (SELECT rid, sum(size)::BIGINT AS taken FROM g WHERE 2 * run <= 3 * (SELECT sum(size) FROM d) GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(u.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN u USING (rid)
"""
