"""Kernel measures over pairs of networks: one Arrow row per network, one kernel call per pair.

A network travels as its edge list; the matrix is made beside the kernel. What a measure computes of one network
alone (spectra, inverses, portraits) is remembered for the last ``REMEMBERED`` networks of a task, so the reference's
part of a landscape, or the grid's of a recovery, is computed once a task and not once a pair. A kernel that raises,
or gives a value that is not finite, gives NULL and never fails the task. ``ms`` is the time that a call takes: that of
both networks' parts, remembered or not, and of the comparison.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Split


#: Networks whose matrix and features a task keeps; of 100 nodes, 80 kB for a feature that is a matrix.
REMEMBERED = 256
#: Codes are u * 65536 + v.
MOST_NODES = 65536


def packed(edges: DataFrame, key: str = "net_id") -> DataFrame:
    """key, code: the edges of a network as one array of u * 65536 + v."""
    return edges.groupBy(key).agg(F.collect_list((F.col("u") * MOST_NODES + F.col("v")).cast("long")).alias("code"))


def matrix(code, nodes: int) -> np.ndarray:
    a, c = np.zeros((nodes, nodes)), np.asarray(code, np.int64)
    u, v = c // MOST_NODES, c % MOST_NODES
    a[u, v] = a[v, u] = 1
    return a


class Remembered:
    """The last results of a function by key, and how long each took."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.held = most, {}

    def get(self, key, make):
        if key in self.held:
            self.held[key] = found = self.held.pop(key)
            return found
        if len(self.held) >= self.most:
            self.held.pop(next(iter(self.held)))
        began = time.perf_counter()
        value = make()
        self.held[key] = found = value, time.perf_counter() - began
        return found


def needs(f: Callable) -> tuple[str, ...]:
    """What a measure takes besides two matrices."""
    return f.needs if isinstance(f, Split) else tuple(inspect.signature(f).parameters)


def default_geometry(spark: SparkSession, nodes: int) -> np.ndarray:
    """The published distances between nodes, where the data folder has them."""
    from ..sources.readers import data_dir, load_array

    path = f"{data_dir()}/reference/distance_matrix.npy"
    found = load_array(spark, path)
    if found is None:
        raise FileNotFoundError(f"no distances at {path}: put them there or pass a geometry")
    if found.shape != (nodes, nodes):
        raise ValueError(f"{path} is for {len(found)} nodes; pass a geometry for {nodes}")
    return found.astype(float)


def score(pairs: DataFrame, measures: dict[str, Callable], nodes: int, geometry: np.ndarray | None = None, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Keys (whole numbers), measure, value, ms of ``pairs`` (keys, a, b: edge codes); one row per pair and measure."""
    if nodes > MOST_NODES:
        raise ValueError(f"edge codes hold at most {MOST_NODES} nodes")
    if geometry is None and any("geometry" in needs(f) for f in measures.values()):
        geometry = default_geometry(pairs.sparkSession, nodes)
    extra = {n: {"geometry": geometry} if "geometry" in needs(f) else {} for n, f in measures.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, parts = Remembered(), {n: Remembered() for n in measures}

        def value_of(name: str, f: Callable, x: bytes, y: bytes, a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
            if not isinstance(f, Split):
                began = time.perf_counter()
                return float(f(a, b, **extra[name])), time.perf_counter() - began
            p, t = parts[name].get(x, lambda: f.features(a, **extra[name]))
            q, u = parts[name].get(y, lambda: f.features(b, **extra[name]))
            began = time.perf_counter()
            return float(f.between(p, q)), t + u + time.perf_counter() - began

        for batch in batches:
            out = []
            ids = zip(*(batch.column(key).to_pylist() for key in keys))
            for pair, *codes in zip(ids, batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = (np.sort(np.asarray(c or [], np.int64)).tobytes() for c in codes)
                a, b = (matrices.get(c, lambda c=c: matrix(np.frombuffer(c, np.int64), nodes))[0] for c in (x, y))
                for name, f in measures.items():
                    began = time.perf_counter()
                    try:
                        value, seconds = value_of(name, f, x, y, a, b)
                    except Exception:
                        value, seconds = float("nan"), time.perf_counter() - began
                    out.append((*pair, name, value if np.isfinite(value) else None, 1000 * seconds))
            columns = zip(*out) if out else [()] * (len(keys) + 3)
            types = [pa.int64()] * len(keys) + [pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*keys, "measure", "value", "ms"])

    wide = pairs.select(*[F.col(key).cast("long").alias(key) for key in keys], "a", "b")
    return wide.mapInArrow(run, ", ".join(f"{key} long" for key in keys) + ", measure string, value double, ms double")


def against(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """pair_id, a, b: every network with the one reference, which is broadcast."""
    ref = packed(reference.withColumn("k", F.lit(0)), "k").select(F.col("code").alias("b"))
    nets = packed(edges).select(F.col("net_id").alias("pair_id"), F.col("code").alias("a"))
    return nets.repartition("pair_id").join(F.broadcast(ref))
