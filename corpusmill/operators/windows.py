"""Fixed-length training windows over packed shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import CONTEXT_LENGTH
from corpusmill.session import materialize


def windows(chunks: DataFrame, length: int = CONTEXT_LENGTH) -> DataFrame:
    """Windows of ``length + 1`` tokens: split, shard, window, ids.

    Window w of a shard covers tokens [w*L, w*L + L], so neighbours share one token. Chunks
    are sliced and the slices are written once. A slice that is a whole
    window stays where it is; one shuffle brings the slices of the others together, and a group
    never holds more than L + 1 tokens. Short tail windows are dropped.
    """
    low = F.col("shard_offset")
    high = F.col("shard_offset") + F.size("ids")
    first = F.greatest(F.lit(0), F.expr(f"(shard_offset - 1) div {length}").cast("int"))
    last = F.expr(f"(shard_offset + size(ids) - 1) div {length}").cast("int")

    start = F.greatest(F.col("window") * length, low)
    end = F.least(F.col("window") * length + length + 1, high)
    listed = chunks.select("split", "shard", "shard_offset", "ids", F.explode(F.sequence(first, last)).alias("window"))
    pieces = listed.select(
        "split", "shard", "window", start.alias("at"), F.slice("ids", start - low + 1, end - start).alias("ids")
    )
    pieces = materialize(pieces, "window-pieces")
    whole = pieces.where(F.size("ids") == length + 1).select("split", "shard", "window", "ids")
    gathered = pieces.where(F.size("ids") <= length).groupBy("split", "shard", "window").agg(
        F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts")
    )
    joined = gathered.select(
        "split", "shard", "window", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")
    )
    return whole.unionByName(joined.where(F.size("ids") == length + 1))


def shifted(windows: DataFrame, length: int = CONTEXT_LENGTH) -> DataFrame:
    """Inputs x and targets y, one token apart."""
    return windows.select(
        "split", "shard", "window",
        F.slice("ids", 1, length).alias("x"),
        F.slice("ids", 2, length).alias("y"),
    )


def windows_per_shard(shard_tokens: DataFrame, length: int = CONTEXT_LENGTH) -> DataFrame:
    """Exact number of full windows of every shard."""
    exact = F.expr(f"greatest(0L, tokens - 1) div {length}")
    return shard_tokens.withColumn("windows", exact)


def window_counts(shard_tokens: DataFrame, length: int = CONTEXT_LENGTH) -> DataFrame:
    """Exact window count per split next to the estimate that ignores shard boundaries."""
    per_split = windows_per_shard(shard_tokens, length).groupBy("split").agg(
        F.sum("tokens").alias("num_tokens"), F.sum("windows").alias("exact_windows")
    )
    return per_split.withColumn(
        "estimated_windows", F.expr(f"greatest(0L, num_tokens - 1) div {length}")
    )
