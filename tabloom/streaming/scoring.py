"""Saved models on streams: scoring is column work, so a stream of records is scored as it comes, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.automl import score


def score_stream(stream: DataFrame, package: dict) -> DataFrame:
    """The stream with its predictions."""
    return score(stream, package)


def start(stream: DataFrame, package: dict, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes predictions as Parquet, exactly once with the checkpoint; by default until what is there is done."""
    return score_stream(stream, package).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
