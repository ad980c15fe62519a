"""A count-based next-token scorer: interpolated bigram over training windows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

BIGRAM_WEIGHT = 0.75
HOT_PAIRS = 1_024
# Pairs of a vocabulary that has no more of them are sent to all workers.
SENT_PAIRS = 1 << 17


def token_pairs(shifted: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (input token, target token) of the windows."""
    targets = shifted.select(*keep, F.posexplode("x").alias("_at", "x"), F.col("y").alias("_y"))
    return targets.select(*keep, "x", F.get("_y", F.col("_at")).alias("y"))


def bigram_counts(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often target y follows x."""
    return pairs.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"))


def window_bigrams(shifted: DataFrame, vocab_size: int, by: Sequence[str] = ()) -> DataFrame:
    """``bigram_counts`` of the ``token_pairs`` of windows whose x and y are equally long.

    Under a vocabulary of at most ``SENT_PAIRS`` pairs a task counts in one table per value of
    ``by``, and its pairs never become rows.
    """
    if not _sent(vocab_size):
        return bigram_counts(token_pairs(shifted, by), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
            if not np.array_equal(sizes, pc.fill_null(pc.list_value_length(y), 0).to_numpy(zero_copy_only=False)):
                raise ValueError("inputs and targets of a window differ in length")
            pairs = [c.flatten().to_numpy(zero_copy_only=False) for c in (x, y)]
            if any(len(p) and (p.min() < 0 or p.max() >= vocab_size) for p in pairs):
                raise ValueError(f"a token id is outside the vocabulary of {vocab_size} ids")
            codes = pairs[0].astype(np.int64) * vocab_size + pairs[1]
            keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
            number = {key: n for n, key in enumerate(dict.fromkeys(keys))}
            owner = np.repeat(np.fromiter(map(number.get, keys), np.int64, len(keys)), sizes)
            for key, n in number.items():
                table = tables.setdefault(key, np.zeros(vocab_size**2, np.int64))
                table += np.bincount(codes[owner == n] if len(number) > 1 else codes, minlength=vocab_size**2)
        for key, table in tables.items():
            at = np.flatnonzero(table)
            columns = [pa.array([k] * len(at), t) for k, t in zip(key, types, strict=True)]
            columns += [pa.array((at // vocab_size).astype(np.int32)), pa.array((at % vocab_size).astype(np.int32)), pa.array(table[at])]
            yield pa.RecordBatch.from_arrays(columns, [*by, "x", "y", "n"])

    kept = shifted.select(*by, "x", "y")
    types = [to_arrow_type(kept.schema[c].dataType) for c in by]
    schema = StructType([*[kept.schema[c] for c in by], *[StructField(c, IntegerType()) for c in "xy"], StructField("n", LongType())])
    return kept.mapInArrow(run, schema).groupBy(*by, "x", "y").agg(F.sum("n").alias("n"))


def target_counts(bigrams: DataFrame) -> DataFrame:
    return bigrams.groupBy("y").agg(F.sum("n").alias("n_y"))


def context_counts(bigrams: DataFrame) -> DataFrame:
    return bigrams.groupBy("x").agg(F.sum("n").alias("n_x"))


def pair_keys(counted: DataFrame, bigrams: DataFrame, total: DataFrame) -> DataFrame:
    """Adds ``_hot``, the count of a frequent pair, and ``_x``, the first join key of the others.

    A pair with a share of 1 / HOT_PAIRS or more of all counts is frequent, so at most HOT_PAIRS
    are, and they are broadcast. Their rows get scattered negative keys, which no token id equals,
    and so do not gather in one task of the join that follows.
    """
    frequent = bigrams.withColumn("_one", F.lit(1)).join(total, "_one").where(F.col("n") * HOT_PAIRS >= F.col("n_all"))
    marked = counted.join(F.broadcast(frequent.select("x", "y", F.col("n").alias("_hot"))), ["x", "y"], "left")
    scattered = -1 - F.pmod(F.xxhash64(*counted.columns), F.lit(1 << 40))
    return marked.withColumn("_x", F.when(F.col("_hot").isNull(), F.col("x").cast("bigint")).otherwise(scattered))


def _nll(vocab_size: int, weight: float) -> Column:
    p_pair = F.coalesce(F.col("n_xy") / F.col("n_x"), F.lit(0.0))
    p_token = (F.coalesce("n_y", F.lit(0)) + 1) / (F.col("n_all") + vocab_size)
    return -F.log(F.lit(weight) * p_pair + F.lit(1 - weight) * p_token)


def pair_nll(
    counted: DataFrame, bigrams: DataFrame, vocab_size: int, weight: float = BIGRAM_WEIGHT
) -> DataFrame:
    """Adds ``nll`` to rows with x and y under the counts in ``bigrams``.

    Interpolates the bigram estimate with an add-one unigram, so unseen pairs keep a
    probability. The broadcast tables have one row per token id, of which there are at most
    65,536, or one per pair of a vocabulary of at most ``SENT_PAIRS`` pairs; the rows then stay
    where they are. Else they are shuffled by pair and should come pre-counted.
    """
    unigram = F.broadcast(target_counts(bigrams))
    context = F.broadcast(context_counts(bigrams))
    total = F.broadcast(bigrams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all")).withColumn("_one", F.lit(1)))
    if _sent(vocab_size):
        # The losses are worked out per pair and per token before they meet the rows.
        known = bigrams.withColumnRenamed("n", "n_xy").join(unigram, "y").join(context, "x")
        known = known.withColumn("_one", F.lit(1)).join(total, "_one").select("x", "y", _nll(vocab_size, weight).alias("_seen"))
        unseen = target_counts(bigrams).withColumn("_one", F.lit(1)).join(total, "_one")
        unseen = unseen.withColumns({"n_xy": F.lit(0), "n_x": F.lit(1)}).select("y", _nll(vocab_size, weight).alias("_unseen"))
        foreign = total.withColumns({"n_xy": F.lit(0), "n_x": F.lit(1), "n_y": F.lit(0)})
        foreign = foreign.select("_one", _nll(vocab_size, weight).alias("_foreign"))
        met = (
            counted.join(F.broadcast(known), ["x", "y"], "left")
            .join(F.broadcast(unseen), "y", "left")
            .withColumn("_one", F.lit(1))
            .join(F.broadcast(foreign), "_one")
        )
        return met.withColumn("nll", F.coalesce("_seen", "_unseen", "_foreign")).drop("_seen", "_unseen", "_foreign", "_one")
    others = bigrams.select(F.col("x").cast("bigint").alias("_x"), "y", F.col("n").alias("n_xy"))
    seen = (
        pair_keys(counted, bigrams, total).join(others, ["_x", "y"], "left")
        .withColumn("n_xy", F.coalesce("_hot", "n_xy"))
        .join(unigram, "y", "left")
        .join(context, "x", "left")
        .withColumn("_one", F.lit(1))
        .join(total, "_one")
    )
    return seen.withColumn("nll", _nll(vocab_size, weight)).drop("n_xy", "n_y", "n_x", "n_all", "_one", "_hot", "_x")


def _sent(vocab_size: int) -> bool:
    return vocab_size**2 <= SENT_PAIRS


def loss_sums(
    pairs: DataFrame, bigrams: DataFrame, vocab_size: int, by: Sequence[str], weight: float = BIGRAM_WEIGHT,
    times: str | None = None,
) -> DataFrame:
    """Summed loss and token count per group of pair rows; ``times`` names a count of equal pairs."""
    if times is not None:
        counted = pairs.select(*by, "x", "y", F.col(times).alias("_times"))
    elif _sent(vocab_size):
        counted = pairs.select(*by, "x", "y", F.lit(1).cast("bigint").alias("_times"))
    else:
        counted = bigram_counts(pairs, by).withColumnRenamed("n", "_times")
    scored = pair_nll(counted, bigrams, vocab_size, weight)
    return scored.groupBy(*by).agg(
        F.sum(F.col("_times") * F.col("nll")).alias("loss_sum"), F.sum("_times").alias("tokens")
    )


def uniform_loss(vocab_size: int) -> float:
    """Loss of a scorer that knows nothing."""
    return math.log(vocab_size)
