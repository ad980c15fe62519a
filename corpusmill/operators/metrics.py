"""Losses, perplexity and throughput over metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import MAX_LOSS_FOR_EXP
from corpusmill.operators.order import previous_values


def step_loss(batch_losses: DataFrame) -> DataFrame:
    """Mean over micro-batches of each micro-batch's mean loss; input: step, batch_loss."""
    return batch_losses.groupBy("step").agg(F.avg("batch_loss").alias("loss"))


def evaluate(
    batch_sums: DataFrame, max_batches: int | None = None, group: Sequence[str] = ()
) -> DataFrame:
    """Token-weighted loss and perplexity of all batches, or the first ``max_batches``.

    Input: batch_no, loss_sum, tokens. Without tokens, loss and perplexity are NaN.
    """
    used = F.lit(True) if max_batches is None else F.col("batch_no") < max_batches
    loss_sum = F.coalesce(F.sum(F.when(used, F.col("loss_sum"))), F.lit(0.0))
    tokens = F.coalesce(F.sum(F.when(used, F.col("tokens"))), F.lit(0)).cast("bigint")
    sums = batch_sums.groupBy(*group).agg(loss_sum.alias("_loss"), tokens.alias("tokens"))
    mean = F.when(F.col("tokens") > 0, F.col("_loss") / F.nullif("tokens", F.lit(0))).otherwise(float("nan"))
    clamped = F.when(F.isnan("loss"), float("nan")).otherwise(
        F.exp(F.least(F.col("loss"), F.lit(MAX_LOSS_FOR_EXP)))
    )
    return sums.withColumn("loss", mean).select(
        *group, "loss", clamped.alias("perplexity"), "tokens"
    )


def throughput(records: DataFrame, tokens_per_step: int, group: Sequence[str] = ()) -> DataFrame:
    """Tokens per second between consecutive log records: step, seconds (epoch), block."""
    timed = previous_values(records, "step", ["step", "seconds"], group)
    tokens = (F.col("step") - F.col("prev_step")) * F.lit(tokens_per_step)
    elapsed = F.greatest(F.col("seconds") - F.col("prev_seconds"), F.lit(1e-6))
    return timed.withColumn("tokens_per_sec", tokens / elapsed).drop("prev_step", "prev_seconds")


def loss_trend(history: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """First and last loss by step, and whether it fell."""
    ends = history.where(F.col("loss").isNotNull()).groupBy(*group).agg(
        F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss")
    )
    return ends.withColumn("decreased", F.col("last_loss") < F.col("first_loss"))
