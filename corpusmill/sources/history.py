"""Training history: append-only JSON records, readable as a table or a stream."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.shards import open_path

HISTORY_SCHEMA = (
    "run STRING, step BIGINT, loss DOUBLE, lr DOUBLE, grad_norm DOUBLE, tokens_per_sec DOUBLE, "
    "val_loss DOUBLE, perplexity DOUBLE, timestamp DOUBLE"
)


def append(records: DataFrame, path: str) -> None:
    """Append records; those without a timestamp get the current time."""
    now = F.expr("unix_micros(current_timestamp()) / 1e6")
    stamped = F.coalesce("timestamp", now) if "timestamp" in records.columns else now
    records.withColumn("timestamp", stamped).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records; none when the history does not exist yet. Blank lines are skipped."""
    filesystem, inner = open_path(path)
    if filesystem.get_file_info(inner).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).json(path)


def stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """New records as they are appended."""
    return (
        spark.readStream.schema(HISTORY_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    )
