"""Splitting, framing, packing and shard layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import BOS_ID, EOS_ID, MAX_TOKEN_ID, SHARD_SIZE, VAL_EVERY
from corpusmill.operators.order import inside_offset, running_base
from corpusmill.session import materialize


def split_of(ordinal: Column, val_every: int = VAL_EVERY) -> Column:
    """Every ``val_every``-th accepted document validates; ordinal 0 is the first of them."""
    return F.when(F.pmod(ordinal, F.lit(val_every)) == 0, "val").otherwise("train")


def frame(ids: Column, bos_id: int | None = BOS_ID, eos_id: int = EOS_ID) -> Column:
    """Optional BOS, the ids, EOS."""
    lead = [] if bos_id is None else [F.array(F.lit(bos_id))]
    return F.concat(*lead, ids, F.array(F.lit(eos_id)))


def framing_tokens(add_bos: bool = True) -> int:
    return 2 if add_bos else 1


def sized(docs: DataFrame, length: Column, carry: Sequence[str], extra_tokens: int) -> DataFrame:
    """Token counts and offsets inside a block; zero for documents that encode to nothing.

    Those are dropped after this is written: a filter here would be moved below the
    encoder's projection and so run the encoder twice.
    """
    framed = F.when(F.col("n") > 0, F.col("n") + extra_tokens).otherwise(0)
    return (
        docs.withColumn("n", length.cast("bigint"))
        .withColumn("n", framed)
        .withColumn("_inside", inside_offset("n", "ordinal", ["split"]))
        .select("doc_id", "ordinal", "split", "block", "n", "_inside", *carry)
    )


def place(
    docs: DataFrame, length: Column, carry: Sequence[str], extra_tokens: int = framing_tokens()
) -> DataFrame:
    """First packed position of every document in its split's token stream.

    ``docs`` has block, ordinal and split. Documents that encode to nothing are dropped
    here, after they took their ordinal. The documents are written once, so whatever
    produced ``length`` and ``carry`` runs once; the per-block token totals then come
    from a narrow scan of the written table. They are one row per block, which is sent to
    the documents.
    """
    written = materialize(sized(docs, length, carry, extra_tokens), "placed").where("n > 0")
    totals = written.groupBy("split", "block").agg(F.sum("n").alias("_tokens"))
    base = running_base(totals, "_tokens", "_base", ["split"])
    return written.join(F.broadcast(base), ["split", "block"]).select(
        "doc_id", "ordinal", "split", "n", (F.col("_base") + F.col("_inside")).alias("offset"), *carry
    )


def chunks(placed: DataFrame, framed: Column, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Pieces of documents cut at shard boundaries: split, shard, shard_offset, ids.

    Only documents that straddle a boundary yield more than one piece.
    """
    size = F.lit(shard_size).cast("bigint")
    start, end = F.col("offset"), F.col("offset") + F.col("n")
    first = F.expr(f"offset div {shard_size}")
    last = F.expr(f"(offset + n - 1) div {shard_size}")
    low = F.greatest(F.col("_shard") * size, start)
    high = F.least((F.col("_shard") + 1) * size, end)
    # Listed before the ids are made: inside a lambda they would not run as compiled code.
    return placed.withColumn("_shard", F.explode(F.sequence(first, last))).select(
        "doc_id", "split",
        F.col("_shard").cast("int").alias("shard"),
        (low - F.col("_shard") * size).cast("int").alias("shard_offset"),
        F.slice(framed, (low - start + 1).cast("int"), (high - low).cast("int")).alias("ids"),
    )


def checked(ids: Column, vocab_size: int | None = None) -> Column:
    """``ids``, or a failed job if one of them cannot be stored or is not in the vocabulary."""

    def complain(bad: Column, message: str) -> Column:
        return F.raise_error(F.concat(F.lit("Token id "), F.element_at(bad, 1).cast("string"), F.lit(message)))

    unfit = F.filter(ids, lambda t: (t < 0) | (t > MAX_TOKEN_ID))
    result = F.when(F.size(unfit) > 0, complain(unfit, " is no uint16"))
    if vocab_size is not None:
        foreign = F.filter(ids, lambda t: t >= vocab_size)
        message = f" exceeds the declared vocab, {vocab_size} ids"
        result = result.when(F.size(foreign) > 0, complain(foreign, message))
    return result.otherwise(ids)


def range_violations(docs: DataFrame, vocab_size: int) -> DataFrame:
    """Per document, how many ids do not fit 16 bits or the vocabulary; clean ones are left out."""
    counted = docs.select(
        "doc_id",
        F.size(F.filter("ids", lambda t: (t < 0) | (t > MAX_TOKEN_ID))).alias("unfit"),
        F.size(F.filter("ids", lambda t: t >= vocab_size)).alias("outside_vocab"),
    )
    return counted.where((F.col("unfit") > 0) | (F.col("outside_vocab") > 0))


def split_totals(placed: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Documents, tokens and shards per split."""
    totals = placed.groupBy("split").agg(
        F.count(F.lit(1)).alias("num_documents"), F.sum("n").alias("num_tokens")
    )
    return totals.withColumn("num_shards", F.expr(f"(num_tokens + {shard_size} - 1) div {shard_size}"))


def shard_token_counts(placed: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Tokens per shard, from the split totals alone: all shards but the last are full."""
    totals = split_totals(placed, shard_size)
    shards = totals.where("num_shards > 0").select(
        "split", "num_tokens", F.explode(F.expr("sequence(0L, num_shards - 1)")).alias("shard")
    )
    left = F.col("num_tokens") - F.col("shard") * F.lit(shard_size)
    return shards.select(
        "split",
        F.col("shard").cast("int").alias("shard"),
        F.least(F.lit(shard_size).cast("bigint"), left).alias("tokens"),
    )
