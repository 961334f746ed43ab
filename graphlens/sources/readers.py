"""Readers: packed network stacks, result tables, nested JSON, reference validation, integrity.

Paths are opened by Spark's readers, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import io
import os
import warnings

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.experiments import Recovery
from .tables import written


def content(spark: SparkSession, path: str) -> bytes | None:
    """A whole file, which must be small; None if there is none."""
    try:
        found = spark.read.format("binaryFile").load(path).select("content").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return bytes(found["content"]) if found else None


def load_array(spark: SparkSession, path: str) -> np.ndarray | None:
    raw = content(spark, path)
    return None if raw is None else np.load(io.BytesIO(raw))


def unpack(packed: np.ndarray, nodes: int) -> np.ndarray:
    """Bit-packed rows, first bit highest, to booleans."""
    return np.unpackbits(packed, axis=-1, count=nodes).astype(bool)


def edges_of(stack: np.ndarray, first: int = 0) -> list[tuple[int, int, int]]:
    """(net_id, u, v) with u < v of a stack of adjacency matrices; the position is the id."""
    net, u, v = np.nonzero(np.triu(stack, 1))
    return [(int(n) + first, int(a), int(b)) for n, a, b in zip(net, u, v)]


def read_stack(spark: SparkSession, path: str, key: str = "networks", chunk: int = 1000) -> DataFrame:
    """Edges of an npz stack: one file per task, decoded where it is read, ``chunk`` networks at a time. The id is the
    position; in a stack of more than three axes (members of grid points) the position in the flattened one.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                stack = np.load(io.BytesIO(content.as_py()))[key]
                stack = stack.reshape(-1, *stack.shape[-2:])
                nodes = stack.shape[-2]
                for a in range(0, len(stack), chunk):
                    part = stack[a : a + chunk]
                    part = part.astype(bool) if part.shape[-1] == nodes else unpack(part, nodes)
                    net, u, v = np.nonzero(np.triu(part, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(net + a), pa.array(u.astype(np.int32)), pa.array(v.astype(np.int32))], names=["net_id", "u", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "net_id long, u int, v int")


def read_networks(spark: SparkSession, folder: str, which: str = "morphospace") -> tuple[DataFrame, DataFrame] | Recovery:
    """The networks of the main sweep as (edges, meta: net_id, eta, gamma, replicate), or a recovery set.

    A recovery set's grid comes in the order gamma, then eta; its members are ``read_stack(..., "grid_members")``.
    """
    path = f"{folder}/networks/{which}.npz"
    raw = content(spark, path)
    if raw is None:
        raise FileNotFoundError(path)
    with np.load(io.BytesIO(raw)) as z:
        of = {k: z[k].tolist() for k in z.files if z[k].ndim == 1}

    def named(prefix: str, *columns: str) -> DataFrame:
        rows = list(zip(range(len(of[f"{prefix}eta"])), *(of[f"{prefix}{c}"] for c in columns)))
        kinds = ", ".join(f"{c} {'long' if c == 'replicate' else 'double'}" for c in columns)
        return spark.createDataFrame(rows, f"net_id long, {kinds}")

    if which == "morphospace":
        return read_stack(spark, path), named("", "eta", "gamma", "replicate")
    side = lambda key, prefix: read_stack(spark, path, key).join(F.broadcast(named(prefix, "eta", "gamma")), "net_id")
    return Recovery(side("targets", "target_"), side("grid", "grid_"))


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None) -> DataFrame:
    """A result table as CSV, compressed or not; without a schema the types are inferred."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    for ending in (".csv.gz", ".csv"):
        try:
            return reader.csv(f"{folder}/{name}{ending}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"no table {name} in {folder}")


def with_position(table: DataFrame, name: str = "net_id") -> DataFrame:
    """The rows of one file with their position in it, however the file is split: a block of the file is read in order
    by one task, and blocks are put in order by where they begin.
    """
    numbered = table.select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = numbered.groupBy("_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("_before", before).drop("_n")
    return numbered.join(F.broadcast(starts), "_block").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_block", "_at", "_first", "_before")


def read_published(spark: SparkSession, folder: str, meta: DataFrame, grids: dict[str, DataFrame], measures: tuple[str, ...]) -> dict:
    """The tables that ``published_readouts`` takes, long, from a folder of result tables.

    Landscapes and timings have one row a network, in the order of net_id, and one column a measure; ``meta`` is (net_id,
    eta, gamma). Recoveries have one row a measure and target and a column for each network of the grid;
    ``grids`` gives for each recovery (tidx, t_eta, t_gamma) and (gidx, g_eta, g_gamma) frames. Tables that are not there
    are left out, but landscapes must be. What many read-outs share is written as Parquet.
    """

    def table(name: str) -> DataFrame | None:
        try:
            return read_table(spark, folder, name, None)
        except FileNotFoundError:
            return None

    def tall(name: str, value: str) -> DataFrame | None:
        if (wide := table(name)) is None:
            return None
        have = [m for m in measures if m in wide.columns]
        return with_position(wide).select("net_id", *[F.col(m).cast("double").alias(m) for m in have]).unpivot("net_id", have, "measure", value)

    if (land := tall("landscapes", "value")) is None:
        raise FileNotFoundError(f"no landscapes in {folder}")
    land = land.join(meta.select("net_id", "eta", "gamma"), "net_id")
    times = tall("timing_ms", "ms")
    land = land.withColumn("ms", F.lit(None).cast("double")) if times is None else land.join(times, ["net_id", "measure"], "left")
    rva = table("real_vs_artificial")
    out = {
        "land": written(land, "landscapes"),
        "trajectories": table("degeneration"),
        "draws": table("noise_tolerance_draws"),
        "effective": table("effective_degeneration"),
        "aucs": None if rva is None else rva.select("measure", "auc", F.col("auc_hardcase").alias("auc_hard")),
        "recoveries": {},
    }
    for key, (targets, grid) in grids.items():
        if (wide := table(f"recovery_{key}")) is not None:
            columns = [c for c in wide.columns if c.startswith("dist_to_grid_")]
            long = wide.select("measure", F.col("gt_idx").cast("long").alias("tidx"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["measure", "tidx"], columns, "c", "value")
            long = long.withColumn("gidx", F.regexp_extract("c", r"(\d+)$", 1).cast("long")).drop("c")
            out["recoveries"][key] = written(long.join(F.broadcast(targets), "tidx").join(F.broadcast(grid), "gidx"), f"recovery-{key}")
    return out


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    d = load_array(spark, path)
    if d is None:
        raise FileNotFoundError(path)
    u, v = np.triu_indices(len(d), 1)
    return spark.createDataFrame([(int(a), int(b), float(d[a, b])) for a, b in zip(u, v)], "u int, v int, dist double")


def read_reference(spark: SparkSession, reference: np.ndarray | str | None = None, nodes: int = 100, published: tuple[DataFrame, DataFrame] | None = None) -> np.ndarray:
    """A validated adjacency matrix from an array or a path, by default ``consensus.npy`` in ``reference_dir()``.

    With ``published``, (edges, net_id and Frobenius value) of the published landscape, a reference that does not
    give those values is warned of.
    """
    path = f"{reference_dir()}/consensus.npy" if reference is None else reference
    found = load_array(spark, path) if isinstance(path, str) else np.asarray(path)
    if found is None:
        raise FileNotFoundError(f"no reference network at {path}: put a binary, symmetric ({nodes}, {nodes}) array there or pass one; without it only the accuracy criterion can be run")
    a = np.squeeze(found).astype(float)
    if a.shape != (nodes, nodes):
        raise ValueError(f"expected shape {(nodes, nodes)}, found {a.shape}")
    if not (np.isin(a, (0, 1)).all() and (a == a.T).all() and not np.diag(a).any()):
        raise ValueError("the reference must be binary, symmetric and without loops")
    if published:
        edges = spark.createDataFrame([(u, v) for _, u, v in edges_of(a[None] > 0)], "u int, v int")
        if not matches(published[0], edges, published[1], nodes=nodes).first()["matches"]:
            warnings.warn("this reference is not the one of the published values: scores do not compare with them", stacklevel=2)
    return a


def read_optional(spark: SparkSession, name: str) -> np.ndarray | None:
    """``name``.npy of ``reference_dir()`` (subjects, consensus networks of the others), or None."""
    found = load_array(spark, f"{reference_dir()}/{name}.npy")
    return None if found is None else found.astype(float)


def home() -> str:
    """GRAPHLENS_HOME, else a folder below the user's own."""
    return os.path.expanduser(os.environ.get("GRAPHLENS_HOME", os.path.join("~", "graphlens_data")))


def data_dir() -> str:
    """GRAPHLENS_DATA, else ``data`` in the working folder if it holds networks, else the bundle below ``home()``."""
    if given := os.environ.get("GRAPHLENS_DATA"):
        return os.path.expanduser(given)
    here = os.path.join(os.getcwd(), "data")
    return here if os.path.exists(os.path.join(here, "networks", "morphospace.npz")) else os.path.join(home(), "bundle")


def reference_dir() -> str:
    """Where references are looked for that cannot be shipped."""
    return os.path.join(home(), "reference")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files, for integrity checks."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def validate(edges: DataFrame, nodes: int) -> DataFrame:
    """net_id, n_edges, ok for each network: u < v, nodes within bounds, no edge twice."""
    fine = (F.col("u") < F.col("v")) & (F.col("u") >= 0) & (F.col("v") < nodes)
    return edges.groupBy("net_id").agg(F.count("*").alias("n_edges"), (F.every(fine) & (F.count("*") == F.count_distinct("u", "v"))).alias("ok"))


def matches(edges: DataFrame, reference: DataFrame, values: DataFrame, first: int = 25, nodes: int = 100) -> DataFrame:
    """Whether Frobenius distances of the first networks equal ``values`` (net_id, value) within 1e-8 + 1e-5 relative."""
    from ..operators.setops import set_measures

    found = set_measures(edges.filter(F.col("net_id") < first), reference, nodes).select("net_id", "frobenius")
    near = F.abs(F.col("frobenius") - F.col("value")) <= 1e-8 + 1e-5 * F.abs(F.col("value"))
    return found.join(values, "net_id").agg(F.coalesce(F.every(near), F.lit(False)).alias("matches"))
