"""Token ids as Parquet list columns with chosen encodings, row groups and page indexes.

``write`` puts one row per document, in ascending key order over the files, with the columns

* ``part``: number of the file's range of keys, ascending with the keys,
* the key, ``part_start`` (ids of earlier documents of the part) and ``n_tokens``,
* ``ids``: the ids as a list column, dictionary or delta encoded.

Parquet stores columns apart and Spark's writer adds column and offset indexes to each page,
so a reader that selects a few keys or only the counts skips the id pages. ``starts`` needs
the narrow columns alone. Order is kept by range partitioning and a sort inside each range;
totals go through one row per part, never through one task per corpus.

Defined results: a null text counts as empty and has the end id alone. Null keys come first.
Repeated keys stay separate rows, ordered by a hash of the text and then the text. An empty
table writes no ids and reads back empty. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.wordtable import ends_of
from corpusmill.llm.bpe import ID_TYPE, Encoder
from corpusmill.llm.words import release

SCHEMA = "part INT, doc_id BIGINT, part_start BIGINT, n_tokens BIGINT, ids ARRAY<INT>"
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 2 << 20
ENCODINGS = ("dictionary", "delta")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so that outputs stay small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        release()


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        release()


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids as an Arrow list column."""
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // ID_TYPE.itemsize
    return list_column(ends_of(lengths), np.frombuffer(b"".join(encoded), ID_TYPE))


def list_column(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def encoded_rows(tokenizer: str, end_id: int | None):
    """A ``mapInArrow`` function from sorted (doc_id, text) to ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, part = Encoder.of(tokenizer), 0, TaskContext.get().partitionId()
        for batch in text_slices(batches):
            offsets, values = encoder.encode_column(batch.column("text"), end_id)
            columns = [
                pa.array(np.full(batch.num_rows, part, np.int32)),
                batch.column("doc_id"),
                pa.array(start + offsets[:-1]),
                pa.array(np.diff(offsets)),
                list_column(offsets, values),
            ]
            start += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "part_start", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``SCHEMA`` in ascending key order."""
    # The hash only breaks ties, so that a repeated key cannot fill one range.
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return ordered.select("doc_id", "text").mapInArrow(encoded_rows(tokenizer, end_id), SCHEMA)


def write(
    rows: DataFrame,
    path: str,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
    codec: str = "zstd",
) -> None:
    """Write rows of ``encode`` as Parquet.

    ``dictionary`` keeps each row group's distinct ids once and bit-packed references to them;
    ``delta`` stores differences between neighbours. A page ends at ``page_bytes`` or
    ``page_rows``, whichever comes first, and has its own entry in the page index.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}, not {encoding!r}")
    options = {
        "compression": codec,
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
    }
    rows.write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(stored: DataFrame) -> DataFrame:
    """(part, base): ids in all earlier parts. One row per written part."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype(ID_TYPE)
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        kept = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(at[1:] - at[:-1], pa.int64()), pa.array(sums, pa.int64())],
            [*kept, "n_read", "ids_crc32"],
        )


def checksums(stored: DataFrame, narrow: str) -> DataFrame:
    """``stored`` with ``ids`` replaced by its length and CRC-32; ``narrow`` is the schema of the rest."""
    return stored.mapInArrow(_checksums, f"{narrow}, n_read BIGINT, ids_crc32 BIGINT")


def digest(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document as stored."""
    narrow = "part INT, doc_id BIGINT, part_start BIGINT"
    rows = checksums(stored.select("part", "doc_id", "part_start", "ids"), narrow)
    # One row per range of keys: as many as the job has write tasks, whatever the corpus.
    placed = rows.join(F.broadcast(starts(stored)), "part")
    return placed.select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32"
    )
