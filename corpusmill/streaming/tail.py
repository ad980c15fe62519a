"""Live view of training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_records(records: DataFrame) -> DataFrame:
    """Last training and last evaluation record of every run; state is one row per run."""
    trained = F.when(F.col("loss").isNotNull(), F.col("step"))
    evaluated = F.when(F.col("val_loss").isNotNull(), F.col("step"))
    return records.groupBy("run").agg(
        F.max(trained).alias("train_step"),
        F.max_by("loss", trained).alias("loss"),
        F.max(evaluated).alias("eval_step"),
        F.max_by("val_loss", evaluated).alias("val_loss"),
    )


def follow(records: DataFrame, output: str, available_now: bool = True) -> StreamingQuery:
    """Keep the latest records of a streaming history in the table at ``output``."""

    def replace(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{output}/latest")

    writer = (
        latest_records(records)
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", f"{output}/_stream")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
