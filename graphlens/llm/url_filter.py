"""URL rules by a sort-merge range join, with DataFrame functions only.

A host turns into a canonical key: its labels in reverse order, each followed by a dot, so
``m.example.com`` is ``com.example.m.``. All hosts under a rule's host are then the keys with the
rule's key as prefix, the interval from ``com.example.`` up to ``com.example/`` ("/" follows "."). Those
intervals nest. Rules become two boundaries each, carrying the stack of rules that are active from there
on; pages and boundaries are sorted together, and the sweep keeps the last stack seen. The page's
verdict is the longest rule of its stack whose path starts the page's path.

The pages of one sweep are a random share of all pages, with the boundaries repeated in each share, so a
host with a third of all pages is spread evenly. A share holds ``SHARE_ROWS`` pages about and the window
spills; the boundaries are as many as rules.

Defined results: a null url or one without "://" has an empty host and path, fits no rule and gets the
default; equal rules with both verdicts block; repeated pages are judged each; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    {"host": "com", "path": "/", "verdict": "allow"},
    {"host": "example.com", "path": "/en/", "verdict": "block"},
    {"host": "www.example.com", "path": "/en/", "verdict": "allow"},
    {"host": "net", "path": "/es/", "verdict": "block"},
    {"host": "net", "path": "/fr/", "verdict": "block"},
]
SHARE_ROWS = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; from there
    up to "?", "#" or the end.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    front = F.regexp_extract(rest, r"^([^?#]*)", 1)
    slash = F.instr(front, "/")
    host = F.when(slash > 0, F.substr(front, F.lit(1), slash - 1)).otherwise(front)
    return F.translate(host, UPPER, LOWER), F.when(slash > 0, F.substr(front, slash)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_boundaries(rules: DataFrame) -> DataFrame:
    """key, stack: from this key on, the rules of ``stack`` are active, longest first."""
    one = F.struct(
        (-F.length(F.concat("host", "path"))).alias("order"), (-F.length("host")).alias("deep"), (F.col("verdict") != "block").alias("mild"), F.col("path"), F.concat("host", "path").alias("rule"), F.col("verdict")
    )
    at = rules.select(host_key(F.translate("host", UPPER, LOWER)).alias("key"), one.alias("one")).groupBy("key").agg(F.collect_list("one").alias("own"))
    labels = F.split(F.expr("substr(key, 1, length(key) - 1)"), r"\.")
    above = at.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("up"))
    stacks = (
        above.join(at.select(F.col("key").alias("up"), "own"), "up")
        .groupBy("key")
        .agg(
            F.array_sort(F.flatten(F.collect_list("own"))).alias("stack"),
            F.array_sort(F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own"))))).alias("outer"),
        )
    )
    opened = stacks.select("key", "stack")
    closed = stacks.select(F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.col("outer").alias("stack"))
    return opened.unionByName(closed)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // SHARE_ROWS))
    swept = pages.select("page_id", "url").select(
        F.pmod(F.monotonically_increasing_id(), F.lit(shares)).alias("share"), F.col("page_id"), host.alias("host"), path.alias("path")
    )
    swept = swept.withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(1))
    marks = rule_boundaries(rules).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), "key", F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("share").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = (
        swept.unionByName(marks, allowMissingColumns=True)
        .withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
        .filter("kind = 1")
        .withColumn("hit", F.get(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)))
    )
    return active.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"))


def production_rules(spark) -> DataFrame:
    return small_table(spark, RULES, "host string, path string, verdict string")


ORACLE = """
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS f FROM a),
c AS (
  SELECT page_id, translate(CASE WHEN strpos(f, '/') > 0 THEN substr(f, 1, strpos(f, '/') - 1) ELSE f END,
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(f, '/') > 0 THEN substr(f, strpos(f, '/')) ELSE '' END AS path
  FROM b),
d AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
