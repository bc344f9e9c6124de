"""Batch stages run incrementally: new files only, with resume by the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "json") -> None:
    """Apply ``stage`` to files of ``source`` that no earlier run has seen, append to ``sink``, and stop."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = stage(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()


def run_batches(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "json") -> None:
    """The same for stages that streaming can't express (joins with windows, actions): each micro-batch is a batch job."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = stream.writeStream.foreachBatch(lambda df, _: stage(df).write.mode("append").parquet(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
