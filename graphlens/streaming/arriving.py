"""Scoring of networks as they arrive, against a fixed reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.setops import set_measures


def score_arriving(edges: DataFrame, reference: DataFrame, nodes: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write the set measures of each micro-batch of whole networks (a streaming frame of net_id, u, v) as Parquet."""

    def batch(df: DataFrame, _: int) -> None:
        set_measures(df, reference, nodes).write.mode("append").parquet(path)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
