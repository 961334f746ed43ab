"""Tables that a run writes for itself, in the folder that executors share.

They are read whenever a frame made of them is run, so they are not deleted here: they live as long as the folder, which
whoever sets ``spark.checkpoint.dir`` empties between runs. The temporary folder of a local run goes when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder, but only if one process is all there is."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="graphlens-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
    return "file://" + _OWN[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as Parquet, read back: its plan is one scan, and a lost executor costs only its own tasks."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
