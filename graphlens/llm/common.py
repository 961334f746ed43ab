"""Plumbing that the operators share: written tables, small tables, Arrow batches."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written as materialize  # noqa: F401  for the operators


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table of a few literal rows, made in the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 mod 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def rows_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size``."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def ship(spark: SparkSession, value) -> Broadcast:
    """A broadcast of an object of this package, its class included."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shipped: Broadcast):
    return pickle.loads(shipped.value)
