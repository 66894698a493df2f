"""Verification of a stream of cluster documents: stateless, so no watermark and no state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cluster import verify_clusters
from ..schema import CLUSTER_INPUT_DDL
from ..sources.io import typed_clusters


def read_cluster_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """(k, v) documents from JSON-lines files as they arrive in a folder."""
    reader = spark.readStream.schema(CLUSTER_INPUT_DDL)
    return typed_clusters((reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder))


def verify_stream(clusters: DataFrame, out: str, checkpoint: str, max_size: int = 10, available_now: bool = False, **options) -> StreamingQuery:
    """Append verified pairs to Parquet at ``out``; a restart goes on from ``checkpoint``, exactly once."""
    writer = verify_clusters(clusters, max_size, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
