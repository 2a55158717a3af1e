"""Unseen series as they arrive. The features need no state: a batch is scored against a frozen model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cloudweave.plans import class_features


def score_stream(series: DataFrame, model: class_features.Model, path: str, checkpoint: str):
    """Write the long features of each micro-batch of a streaming series table under path, by batch."""

    def one(batch: DataFrame, number: int) -> None:
        class_features.transform(batch, model).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return series.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
