"""Populations of networks from the trade tables: nodes are nations, weights are traded cents.

One network for each year, month and return flag; a ring through all nations and the ``extra`` heaviest other
pairs, so every network is connected. Weights are whole numbers, so every order is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES, EXTRA = 25, 35
#: Rows to a task of a join of the trade tables, at most about, and rows of customers or suppliers that go to all tasks instead.
ROWS, FEW = 1_200_000, 500_000
_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A small frame, cached for the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = make().cache()
    return _KEPT[key]


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """The rows by their key in parts of at most about ``ROWS`` of ``rows``, which adaptive execution does not merge; as they are, if all make one part."""
    parts = -(-rows // ROWS)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key) if parts > 1 else df


def met(many: DataFrame, few: DataFrame, keys: tuple[str, str], rows: tuple[int, int]) -> DataFrame:
    """The join of frames of so many rows on a key of each, without the keys: the few go to all tasks, or both meet in parts if they are not few."""
    (a, b), most = keys, max(rows)
    many, few = (many, F.broadcast(few)) if rows[1] <= FEW else (spread(many, most, a), spread(few, most, b).hint("merge"))
    return many.join(few, F.col(a) == F.col(b)).drop(a, b)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, month, rep, segment, priority, u, v, cents for each pair of nations, u < v."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines, orders, customers, suppliers = (t(n) for n in ("lineitem", "orders", "customer", "supplier"))
    n_lines, n_orders, n_customers, n_suppliers = (x.count() for x in (lines, orders, customers, suppliers))  # of the files' footers
    lines = lines.select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    orders, customers = orders.select("o_orderkey", "o_custkey", "o_orderpriority"), customers.select("c_custkey", "c_nationkey", "c_mktsegment")
    # orders meet customers before lines, of which there are more; a task sorts one part of a join, so parts keep their size as tables grow
    bought = met(orders, customers, ("o_custkey", "c_custkey"), (n_orders, n_customers))
    sold = met(lines, suppliers.select("s_suppkey", "s_nationkey"), ("l_suppkey", "s_suppkey"), (n_lines, n_suppliers))
    joined = spread(sold, n_lines, "l_orderkey").join(spread(bought, n_lines, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).filter("c_nationkey <> s_nationkey")
    u, v = F.least("c_nationkey", "s_nationkey"), F.greatest("c_nationkey", "s_nationkey")
    return (
        joined.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_returnflag").alias("rep"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), u.alias("u"), v.alias("v"))
        .agg(F.sum("cents").alias("cents"))
    )


def wire(weights: DataFrame, key: list[str]) -> DataFrame:
    """key, u, v: the ring and each key's heaviest other pairs."""
    ring = weights.sparkSession.range(NODES).select(F.least("id", (F.col("id") + 1) % NODES).cast("int").alias("u"), F.greatest("id", (F.col("id") + 1) % NODES).cast("int").alias("v"))
    other = weights.join(F.broadcast(ring), ["u", "v"], "left_anti")
    order = Window.partitionBy(*key).orderBy(F.desc("cents"), "u", "v")
    heavy = other.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= EXTRA).select(*key, "u", "v")
    rings = weights.select(*key).distinct().select("*", F.explode(F.array(*[F.struct(F.lit(min(i, (i + 1) % NODES)).alias("u"), F.lit(max(i, (i + 1) % NODES)).alias("v")) for i in range(NODES)])).alias("e")).select(*key, "e.u", "e.v")
    return heavy.unionByName(rings)


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """net_id, eta, gamma, rep, u, v: the edges of all networks."""

    def make():
        w = kept(spark, sf_dir, "trade", lambda: trade(spark, sf_dir)).filter("year between 1995 and 2000")
        key = ["eta", "gamma", "rep"]
        w = w.groupBy((F.col("year") - 1998).alias("eta"), (F.col("month") - 1).alias("gamma"), "rep", "u", "v").agg(F.sum("cents").alias("cents"))
        ids = w.select(*key).distinct().withColumn("net_id", F.row_number().over(Window.orderBy(*key)).cast("long") - 1)
        return wire(w, key).join(ids, key).select("net_id", *key, "u", "v")

    return kept(spark, sf_dir, "networks", make)


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """net_id, u, v, w of all pairs that trade; weights from -1 to 3.99, whole, broken, 0 and below, from the last digits of the cents."""

    def make():
        w = kept(spark, sf_dir, "trade", lambda: trade(spark, sf_dir)).filter("year between 1995 and 2000")
        w = w.groupBy((F.col("year") - 1998).alias("eta"), (F.col("month") - 1).alias("gamma"), "rep", "u", "v").agg(F.sum("cents").alias("cents"))
        nets = networks(spark, sf_dir).select("net_id", "eta", "gamma", "rep").distinct()
        return w.join(nets, ["eta", "gamma", "rep"]).select("net_id", "u", "v", _weight().alias("w"))

    return kept(spark, sf_dir, "weighted", make)


def weighted_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, w of all trade."""
    w = kept(spark, sf_dir, "trade", lambda: trade(spark, sf_dir)).groupBy("u", "v").agg(F.sum("cents").alias("cents"))
    return kept(spark, sf_dir, "weighted-reference", lambda: w.select("u", "v", _weight().alias("w")))


def _weight():
    return F.col("cents") % 500 / 100.0 - 1


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v of the network of all trade."""

    def make():
        w = kept(spark, sf_dir, "trade", lambda: trade(spark, sf_dir))
        return wire(w.groupBy(F.lit(0).alias("k"), "u", "v").agg(F.sum("cents").alias("cents")), ["k"]).select("u", "v")

    return kept(spark, sf_dir, "reference", make)


def geometry(spark: SparkSession) -> DataFrame:
    """u, v, dist of all pairs: nodes on a lattice five wide, 30 mm apart."""
    x, y = (F.col("v") % 5 - F.col("u") % 5), (F.floor(F.col("v") / 5) - F.floor(F.col("u") / 5))
    return spark.range(NODES * NODES).select((F.col("id") % NODES).cast("int").alias("u"), F.floor(F.col("id") / NODES).cast("int").alias("v")).filter("u < v").withColumn("dist", 30 * F.sqrt((x * x + y * y).cast("double")))


#: The same derivation in SQL: nets(net_id, eta, gamma, rep), edges(net_id, eta, gamma, rep, u, v), ref(u, v), geo.
SQL = """
trade AS MATERIALIZED (
  SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, l_returnflag AS rep, c_mktsegment AS segment, o_orderpriority AS priority,
         least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v,
         sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
w AS (SELECT y - 1998 AS eta, m - 1 AS gamma, rep, u, v, sum(cents)::BIGINT AS cents FROM trade WHERE y BETWEEN 1995 AND 2000 GROUP BY ALL),
nets AS (SELECT (row_number() OVER (ORDER BY eta, gamma, rep) - 1)::BIGINT AS net_id, * FROM (SELECT DISTINCT eta, gamma, rep FROM w)),
ring AS (SELECT least(i, (i + 1) % 25)::INT AS u, greatest(i, (i + 1) % 25)::INT AS v FROM range(25) t(i)),
heavy AS (
  SELECT eta, gamma, rep, u, v FROM w ANTI JOIN ring USING (u, v)
  QUALIFY row_number() OVER (PARTITION BY eta, gamma, rep ORDER BY cents DESC, u, v) <= 35),
edges AS (
  SELECT net_id, eta, gamma, rep, u, v FROM heavy JOIN nets USING (eta, gamma, rep)
  UNION ALL SELECT net_id, eta, gamma, rep, ring.u, ring.v FROM nets CROSS JOIN ring),
rw AS (SELECT u, v, sum(cents)::BIGINT AS cents FROM trade GROUP BY ALL),
ref AS (
  (SELECT u, v FROM rw ANTI JOIN ring USING (u, v) ORDER BY cents DESC, u, v LIMIT 35) UNION ALL SELECT u, v FROM ring),
geo AS (
  SELECT a.i::INT AS u, b.i::INT AS v, 30 * sqrt(((b.i % 5 - a.i % 5) ** 2 + (b.i // 5 - a.i // 5) ** 2)::DOUBLE) AS dist
  FROM range(25) a(i), range(25) b(i) WHERE a.i < b.i)
"""
