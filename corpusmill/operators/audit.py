"""Invariants of packed streams as aggregate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.constants import BOS_ID, EOS_ID, UNK_ID


def separators(placed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents against end markers per split; the two must agree."""
    docs = placed.groupBy("split").agg(F.count(F.lit(1)).alias("num_documents"))
    per_chunk = F.size(F.filter("ids", lambda t: t == EOS_ID))
    marks = chunks.groupBy("split").agg(F.sum(per_chunk).alias("eos_count"))
    return docs.join(marks, "split").withColumn("agrees", F.col("num_documents") == F.col("eos_count"))


def delimiters(chunks: DataFrame) -> DataFrame:
    """Per shard, end markers that are not followed by a start marker.

    The follower is looked up inside the chunk and, for a chunk's last token, in the next
    chunk of the shard. A shard's last token has no follower there. Only the first and last
    token and two counts of each chunk are shuffled.
    """
    ids = F.col("ids")
    good_pair = F.size(
        F.filter(
            F.arrays_zip(
                F.slice(ids, 1, F.size(ids) - 1).alias("a"), F.slice(ids, F.lit(2), F.size(ids) - 1).alias("b")
            ),
            lambda p: (p["a"] == EOS_ID) & (p["b"] != BOS_ID),
        )
    )
    edges = chunks.select(
        "split",
        "shard",
        "shard_offset",
        F.element_at(ids, 1).alias("head"),
        F.element_at(ids, -1).alias("tail"),
        F.when(F.size(ids) > 1, good_pair).otherwise(0).alias("inner_bad"),
    )
    follower = F.lead("head").over(Window.partitionBy("split", "shard").orderBy("shard_offset"))
    edge_bad = ((F.col("tail") == EOS_ID) & (F.col("next_head") != BOS_ID)).cast("int")
    return (
        edges.withColumn("next_head", follower)
        .groupBy("split", "shard")
        .agg(
            F.min_by("head", "shard_offset").alias("first_id"),
            F.sum(F.col("inner_bad") + F.coalesce(edge_bad, F.lit(0))).alias("violations"),
        )
    )


def id_range(chunks: DataFrame, vocab_size: int) -> DataFrame:
    """Unknown-token count and largest id per split."""
    unknown = F.size(F.filter("ids", lambda t: t == UNK_ID))
    largest = chunks.groupBy("split").agg(
        F.sum(unknown).alias("unk_count"), F.max(F.array_max("ids")).alias("max_id")
    )
    return largest.withColumn("in_vocab", F.col("max_id") < vocab_size)
