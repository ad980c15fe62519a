"""From a text corpus to shards: the dataset build as one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import (
    BOS_ID,
    BYTE_VOCAB_SIZE,
    CHARACTER_COVERAGE,
    EOS_ID,
    MIN_WORDS,
    SHARD_SIZE,
    VAL_EVERY,
    VOCAB_SIZE,
)
from corpusmill.functions import bytes as by
from corpusmill.functions import codec
from corpusmill.operators import fit, pack
from corpusmill.operators.order import key_blocks, with_ordinal
from corpusmill.sources import corpus, metadata, shards, vocabulary


@dataclass(frozen=True)
class Placed:
    """Documents with their places in the token streams."""

    placed: DataFrame
    shard_size: int

    def totals(self) -> DataFrame:
        return pack.split_totals(self.placed, self.shard_size)

    def shard_tokens(self) -> DataFrame:
        return pack.shard_token_counts(self.placed, self.shard_size)


@dataclass(frozen=True)
class Packed(Placed):
    """A placed corpus and its shard chunks."""

    chunks: DataFrame
    vocab_size: int


def numbered_documents(
    spark: SparkSession,
    path: str,
    min_words: int = MIN_WORDS,
    limit: int | None = None,
    val_every: int = VAL_EVERY,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Accepted documents with ordinal and split, one shuffle of the text."""
    docs = corpus.accept(corpus.scan(spark, path, rows_per_block), min_words)
    numbered = corpus.number(docs, limit)
    return numbered.withColumn("split", pack.split_of(F.col("ordinal"), val_every))


def place_keys(numbered: DataFrame, shard_size: int, add_bos: bool = True) -> Placed:
    """Where each document's bytes would lie; only keys and lengths are stored."""
    return Placed(pack.place(numbered, by.byte_length(F.col("text")), [], pack.framing_tokens(add_bos)), shard_size)


def pack_bytes(numbered: DataFrame, shard_size: int, add_bos: bool = True) -> Packed:
    """Pack with the byte-only tokenizer; ids are made after placing, so text is what is stored."""
    placed = pack.place(numbered, by.byte_length(F.col("text")), ["text"], pack.framing_tokens(add_bos))
    framed = pack.frame(by.byte_ids(F.col("text")), BOS_ID if add_bos else None)
    return Packed(placed, shard_size, pack.chunks(placed, framed, shard_size), BYTE_VOCAB_SIZE)


def pack_pieces(
    numbered: DataFrame, pieces: vocabulary.Pieces, shard_size: int = SHARD_SIZE, add_bos: bool = True
) -> Packed:
    """Pack with a fitted vocabulary; documents are encoded once and stored as ids."""
    encoded = numbered.withColumn("ids", codec.encode(F.col("text"), pieces)).drop("text")
    return pack_ids(encoded, len(pieces), shard_size, BOS_ID if add_bos else None)


def pack_ids(
    encoded: DataFrame, vocab_size: int, shard_size: int = SHARD_SIZE,
    bos_id: int | None = BOS_ID, eos_id: int = EOS_ID,
) -> Packed:
    placed = pack.place(encoded, F.size("ids"), ["ids"], pack.framing_tokens(bos_id is not None))
    framed = pack.frame(F.col("ids"), bos_id, eos_id)
    return Packed(placed, shard_size, pack.chunks(placed, framed, shard_size), vocab_size)


def write_packed(
    packed: Packed,
    path: str,
    bos_id: int | None = BOS_ID,
    eos_id: int = EOS_ID,
    extra: dict[str, object] | None = None,
    verify: bool = True,
) -> dict[str, dict]:
    """Shard files and one metadata record per split."""
    spark = packed.placed.sparkSession
    totals = packed.totals()
    counts = {r.split: r.num_shards for r in totals.collect()}
    shards.write(packed.chunks, counts, packed.shard_size, path, packed.vocab_size)
    verification = shards.verify(spark, path, eos_id) if verify else None
    records = metadata.assemble(totals, packed.vocab_size, eos_id, bos_id, packed.shard_size, verification)
    return metadata.write_records(records, path, extra)


def write_token_shards(
    documents: DataFrame,
    path: str,
    eos_id: int,
    vocab_size: int,
    shard_size: int = SHARD_SIZE,
    add_bos: bool = False,
    bos_id: int | None = None,
    extra: dict[str, object] | None = None,
    verify: bool = True,
) -> dict[str, object]:
    """Pack documents that are token ids already (doc_id, ids) into one unsplit dataset."""
    blocked = documents.withColumn("block", key_blocks(documents, "doc_id"))
    ordered = with_ordinal(blocked, ["doc_id"], unique=True).withColumn("split", F.lit(""))
    start = (BOS_ID if bos_id is None else bos_id) if add_bos else None
    packed = pack_ids(ordered, vocab_size, shard_size, start, eos_id)
    records = write_packed(packed, path, bos_id if add_bos else None, eos_id, extra, verify)
    return records.get("", {})


def load_or_fit(
    accepted: DataFrame,
    path: str,
    vocab_size: int = VOCAB_SIZE,
    sample_documents: int | None = None,
    max_bytes: int | None = None,
    input_sentences: int | None = None,
    coverage: float = CHARACTER_COVERAGE,
) -> DataFrame:
    """The saved vocabulary, or a new one fitted on all accepted documents.

    A saved vocabulary of another size is refused. The three limits narrow the fit only.
    """
    if not vocabulary.exists(path):
        # Only a number of first documents asks for their order.
        sample = accepted if sample_documents is None else corpus.number(accepted, sample_documents)
        vocabulary.save(fit.fit(sample, vocab_size, coverage, sample_documents, max_bytes, input_sentences), path)
    saved = vocabulary.load(accepted.sparkSession, path)
    if (pieces := saved.count()) != vocab_size:
        raise ValueError(f"{path} holds {pieces} pieces, {vocab_size} were asked for")
    return saved


def preprocess(
    spark: SparkSession,
    corpus_path: str,
    output: str,
    vocab_size: int = VOCAB_SIZE,
    limit: int | None = None,
    sample_documents: int | None = None,
    max_bytes: int | None = None,
    input_sentences: int | None = None,
    coverage: float = CHARACTER_COVERAGE,
    val_every: int = VAL_EVERY,
    shard_size: int = SHARD_SIZE,
    min_words: int = MIN_WORDS,
    add_bos: bool = True,
    more: dict[str, object] | None = None,
) -> dict[str, dict]:
    """Fit or reuse the vocabulary, then write both splits and the manifest.

    Files without ``doc_id`` are taken in the order of their names and rows. ``more`` goes into
    the metadata of each split.
    """
    accepted = corpus.accept(corpus.scan_any(spark, corpus_path), min_words)
    fitted = load_or_fit(
        accepted, f"{output}/tokenizer", vocab_size, sample_documents, max_bytes, input_sentences, coverage
    )
    pieces = vocabulary.Pieces.of(fitted)
    numbered = corpus.number(accepted, limit)
    numbered = numbered.withColumn("split", pack.split_of(F.col("ordinal"), val_every))
    extra = {
        "dataset": corpus_path,
        "tokenizer": "byte-pair",
        "tokenizer_model": "tokenizer",
        "min_words": min_words,
        **(more or {}),
    }
    packed = pack_pieces(numbered, pieces, shard_size, add_bos)
    records = write_packed(packed, output, BOS_ID if add_bos else None, extra=extra)
    metadata.write_manifest(records, output)
    return records
