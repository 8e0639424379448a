"""Privacy rules on a stream, and running a stream over what a folder holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from doppel.checkpoint import checkpoint_dir
from doppel.operators.privacy import apply_privacy


def stream_privacy(stream: DataFrame, rules: list[dict], ids: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Masks, pseudonyms and noise as a stateless projection; noise needs an explicit sensitivity."""
    return apply_privacy(stream, rules, ids, seed)


def folder_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str) -> DataFrame:
    """A stream of the parquet files of a folder whose name matches."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def run_available(stream: DataFrame, output: str | None = None) -> DataFrame:
    """Process all that is there and read the result back from the shared folder.

    Windows of a watermarked aggregation that the last watermark has not passed are not emitted.
    """
    spark = stream.sparkSession
    base = output or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
             .option("path", f"{base}/rows").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
