"""Which window is trained on when: workers, shuffling, epochs, batches, steps.

Everything here works on window keys; the token payload is joined at the end if at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.constants import CONTEXT_LENGTH, EPOCH_SEED_STRIDE, SEED
from corpusmill.functions.hashing import seeded_hash
from corpusmill.operators.windows import windows_per_shard


def assign_workers(shard_tokens: DataFrame, workers: int) -> DataFrame:
    """Shard i goes to worker i mod n; surplus workers stay idle."""
    return shard_tokens.withColumn("worker", F.pmod("shard", F.lit(workers)).cast("int"))


def _worker_seed(seed: int) -> Column:
    return F.lit(seed) + F.col("worker") + F.col("epoch").cast("bigint") * F.lit(EPOCH_SEED_STRIDE)


def positions(
    shard_tokens: DataFrame,
    workers: int = 1,
    epochs: int = 1,
    length: int = CONTEXT_LENGTH,
    shuffle: bool = True,
    seed: int = SEED,
) -> DataFrame:
    """Every window's place in its worker's stream over all epochs.

    Shards are visited in shuffled order and windows are shuffled inside their shard. A
    shard's base is a running total over the worker's shards, so the only per-window sort
    is inside one shard.
    """
    shards = (
        windows_per_shard(assign_workers(shard_tokens, workers), length)
        .where("windows > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    )
    shard_order = seeded_hash(_worker_seed(seed), F.col("shard")) if shuffle else F.col("shard")
    stream = Window.partitionBy("split", "worker").orderBy("epoch", shard_order, "shard")
    before = F.coalesce(F.sum("windows").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The running total leaves each worker's shards in one task; windows are listed only after
    # the shards are spread again. A given count keeps adaptive execution from undoing it.
    tasks = int(shard_tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    based = shards.withColumn("_base", before).repartition(tasks, "split", "worker", "epoch", "shard")
    keys = based.select(
        "split", "worker", "epoch", "shard", "_base",
        F.explode(F.expr("sequence(0L, windows - 1)")).alias("window"),
    )
    if shuffle:
        window_order = seeded_hash(_worker_seed(seed), F.col("shard"), F.col("window"))
        inner = Window.partitionBy("split", "worker", "epoch", "shard").orderBy(window_order, "window")
        at = F.row_number().over(inner) - 1
    else:
        at = F.col("window")
    return keys.select(
        "split", "worker", "epoch", "shard", F.col("window").cast("int").alias("window"),
        (F.col("_base") + at).alias("position"),
    )


def batches(
    shard_tokens: DataFrame,
    batch_size: int,
    workers: int = 1,
    epochs: int = 1,
    length: int = CONTEXT_LENGTH,
    shuffle: bool = True,
    seed: int = SEED,
) -> DataFrame:
    """Full batches in loader order; each worker's partial last batch is dropped.

    Workers hand over batches in turn, skipping those that have run dry, so a batch's
    number is the count of batches that all workers deliver before it. Whether a batch is
    full follows from the worker's window total, without grouping windows.
    """
    per_worker = (
        windows_per_shard(assign_workers(shard_tokens, workers), length)
        .groupBy("split", "worker")
        .agg((F.sum("windows") * epochs).alias("_total"))
        .withColumn("_full", F.expr(f"_total div {batch_size}"))
    )
    # One row per split; the list has one entry per worker.
    lists = per_worker.groupBy("split").agg(
        F.collect_list(F.struct("worker", F.col("_full").alias("full"))).alias("_loads")
    )
    placed = (
        positions(shard_tokens, workers, epochs, length, shuffle, seed)
        .withColumn("batch_in_worker", F.expr(f"position div {batch_size}"))
        .join(F.broadcast(per_worker.select("split", "worker", "_full")), ["split", "worker"])
        .where("batch_in_worker < _full")
        .join(F.broadcast(lists), "split")
    )

    def earlier(total: Column, load: Column) -> Column:
        turn = F.when(load["worker"] < F.col("worker"), 1).otherwise(0)
        return total + F.least(load["full"], F.col("batch_in_worker") + turn)

    return placed.select(
        "split", "worker", "epoch", "shard", "window",
        F.aggregate("_loads", F.lit(0).cast("bigint"), earlier).alias("batch_no"),
        F.pmod("position", F.lit(batch_size)).cast("int").alias("slot"),
    )


def steps(batched: DataFrame, accumulation: int, max_steps: int | None = None) -> DataFrame:
    """Optimizer step and micro-batch of every batch."""
    stepped = batched.withColumn("step", F.expr(f"batch_no div {accumulation}")).withColumn(
        "micro", F.pmod("batch_no", F.lit(accumulation)).cast("int")
    )
    return stepped if max_steps is None else stepped.where(F.col("step") < max_steps)


def restarted(batched: DataFrame, passes: int) -> DataFrame:
    """Finite data read again and again: the same order and the same dropped rest each time.

    Input: the batches of one pass. Their numbers go on from pass to pass; ``steps`` with
    ``max_steps`` ends the last one where training ends.
    """
    # One row per split.
    sizes = batched.groupBy("split").agg((F.max("batch_no") + 1).alias("_size"))
    again = batched.join(F.broadcast(sizes), "split")
    again = again.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return again.withColumn("batch_no", F.col("pass") * F.col("_size") + F.col("batch_no")).drop("_size")


def epochs_for(
    shard_tokens: DataFrame, batch_size: int, workers: int, length: int, accumulation: int, max_steps: int
) -> int:
    """Epochs after which no worker with data can have run dry before ``max_steps``.

    With that many, batches of endless data are numbered as if every worker went on for ever.
    """
    per_worker = (
        windows_per_shard(assign_workers(shard_tokens, workers), length)
        .groupBy("split", "worker")
        .agg(F.sum("windows").alias("n"))
        .where("n > 0")
    )
    loaders = per_worker.groupBy("split").agg(F.count(F.lit(1)).alias("w"), F.min("n").alias("least"))
    wanted = max_steps * accumulation
    need = F.ceil(F.lit(wanted) / F.col("w")) * batch_size
    return int(loaders.agg(F.max(F.ceil(need / F.col("least")))).first()[0] or 1)


def tokens_per_step(batch_size: int, accumulation: int, length: int) -> int:
    return batch_size * accumulation * length


def on_cadence(step: Column, every: int) -> Column:
    """Whether a log, evaluation or save falls on ``step``."""
    return F.pmod(step, F.lit(every)) == 0
