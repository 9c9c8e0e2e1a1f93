"""Appraisal of a stream of properties with frozen artifacts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.appraisal import apply


def start(rows: DataFrame, tables: dict[str, DataFrame], fitted: PipelineModel, target: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Appraise every micro-batch of keyed rows and append the predictions to target as Parquet.

    Ranking windows have no time bound, so they live inside the batch; the batch's number is part of the path, so a
    repeated batch overwrites itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        out = apply(batch, tables, fitted, config).drop("core", "access")
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
