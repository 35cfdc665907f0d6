"""Incremental neighbours of arriving items against a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.similarity import topk_blocked


def neighbours_against(new: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(i, rk, j, dist): the k nearest index items of each new item; ids of both must differ. The index may
    have any size: nothing is broadcast."""
    both = index.select("idx", "embedding").unionByName(new.select("idx", "embedding"))
    return topk_blocked(both, k, candidates=index, queries=new)


def stream_neighbours(items: DataFrame, index: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's neighbours to a Parquet table; a batch that is replayed after a failure
    replaces its own part, because the part is named by the batch."""

    def write(batch: DataFrame, number: int) -> None:
        neighbours_against(batch, index, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
