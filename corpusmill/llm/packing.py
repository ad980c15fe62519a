"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A piece of ``n`` ids belongs to the class ``k`` whose slot, ``capacity // k``, is the smallest
one that holds it; a full bin of class ``k`` has exactly ``k`` pieces. Which bin a piece joins
then depends only on how many pieces of its class a worker has met, so workers fill bins
without talking to each other. Lengths between two slots would waste the difference: such a
document is cut into a piece that fills its slot and a rest that belongs to a far finer class.
A cut is made only where the slot would stay emptier than ``tolerance``.

Each worker leaves at most one open bin per class. Its pieces are counted again per class over
all workers (at most ``k`` per worker and class), which leaves one open bin per class; those
few bins, a number that depends on the capacity alone, are merged first-fit by size.

Defined results: a null text counts as empty and is a piece with the end id alone; without an
end id it has no piece. Repeated keys and rows are packed one by one. An empty table gives no
sequences. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.bpe import ID_TYPE, Encoder
from corpusmill.llm.tokens import checksums, id_lists, text_slices
from corpusmill.llm.words import batch_rows
from corpusmill.session import fresh_path

CAPACITY = 4_096
TOLERANCE = 1 / 48
FINE_CLASSES = 64
ROW_GROUP_BYTES = 16 << 20
ROWS_PER_BATCH = 1_000
# Worker bins are numbered within a worker; bins filled after pooling follow in ranges of their own.
WORKER_BITS, POOLED, MERGED = 32, 1 << 60, 1 << 61

PIECES = (
    "doc_id BIGINT, start BIGINT, length BIGINT, doc_tokens BIGINT, class INT, worker INT, "
    "bin BIGINT, slot INT, offset BIGINT, closed BOOLEAN, ids ARRAY<INT>"
)
PLACED = "doc_id BIGINT, start BIGINT, length BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, ids ARRAY<INT>"


def classes(capacity: int = CAPACITY, fine: int = FINE_CLASSES) -> list[int]:
    """Document counts per bin: every one up to ``fine``, then growing by about a tenth."""
    found, k = [], 1
    while k <= capacity:
        found.append(k)
        k = k + 1 if k < fine else k + max(1, k // 10)
    if found[-1] != capacity:
        found.append(capacity)
    return found


class Harmonic:
    """Slot sizes and the cutting rule for one capacity."""

    def __init__(self, capacity: int = CAPACITY, tolerance: float = TOLERANCE):
        self.capacity = capacity
        self.counts = np.array(classes(capacity))
        self.slots = capacity // self.counts  # falling
        self.tolerance = tolerance

    def class_of(self, length: int) -> int:
        """Index of the finest class whose slot holds ``length``."""
        return int(np.searchsorted(-self.slots, -length, side="right")) - 1

    def cuts(self, length: int) -> list[tuple[int, int]]:
        """(piece length, class index) of a document, in order."""
        pieces = []
        while length >= self.capacity:
            pieces.append((self.capacity, 0))
            length -= self.capacity
        while length > 0:
            at = self.class_of(length)
            # Slots of the fine classes only: beyond them a slot is too short to be worth a cut.
            spare = self.slots[at] - length
            if self.counts[at] >= FINE_CLASSES or spare <= self.tolerance * self.slots[at]:
                pieces.append((length, at))
                break
            head = int(self.slots[at + 1])
            pieces.append((head, at + 1))
            length -= head
        return pieces


def fill(tokenizer: str, end_id: int | None, capacity: int, tolerance: float):
    """A ``mapInArrow`` function from (doc_id, text) to ``PIECES``: this worker's bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rule = Encoder.of(tokenizer), Harmonic(capacity, tolerance)
        worker, bins = TaskContext.get().partitionId(), 0
        width = ID_TYPE.itemsize
        full = rule.counts
        open_bins: dict[int, list] = {}
        for batch in text_slices(batches):
            done: list[tuple] = []
            offsets, values = encoder.encode_column(batch.column("text"), end_id)
            encoded, at_byte = values.tobytes(), offsets * ID_TYPE.itemsize
            for doc_id, first, last in zip(batch.column("doc_id").to_pylist(), at_byte[:-1].tolist(), at_byte[1:].tolist()):
                ids = encoded[first:last]
                total, start = (last - first) // width, 0
                for length, at in rule.cuts(total):
                    held = open_bins.setdefault(at, [0, 0, []])  # ids so far, bin, pieces
                    if not held[2]:
                        held[1], bins = bins, bins + 1
                    piece = ids[start * width : (start + length) * width]
                    held[2].append((doc_id, start, length, total, int(full[at]), held[1], len(held[2]), held[0], piece))
                    held[0] += length
                    start += length
                    if len(held[2]) == full[at]:
                        done += open_bins.pop(at)[2]
            yield _piece_batch(done, worker, True)
        for held in open_bins.values():
            yield _piece_batch(held[2], worker, False)

    return run


def _piece_batch(rows: list[tuple], worker: int, closed: bool) -> pa.RecordBatch:
    ids, rest = [r[-1] for r in rows], list(zip(*rows, strict=True))[:-1] if rows else [()] * 8
    doc_id, start, length, total, kind, number, slot, offset = rest
    n = len(rows)
    columns = {
        "doc_id": pa.array(doc_id, pa.int64()),
        "start": pa.array(start, pa.int64()),
        "length": pa.array(length, pa.int64()),
        "doc_tokens": pa.array(total, pa.int64()),
        "class": pa.array(kind, pa.int32()),
        "worker": pa.array([worker] * n, pa.int32()),
        "bin": pa.array(number, pa.int64()),
        "slot": pa.array(slot, pa.int32()),
        "offset": pa.array(offset, pa.int64()),
        "closed": pa.array([closed] * n, pa.bool_()),
        "ids": id_lists(ids),
    }
    return pa.RecordBatch.from_pydict(columns)


def _merge(capacity: int):
    """First fit, largest first, over the last open bin of each class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.groupby("class")["length"].sum().sort_values(ascending=False, kind="stable")
        room: list[int] = []
        home = {}
        for kind, size in sizes.items():
            at = next((i for i, free in enumerate(room) if free >= size), len(room))
            if at == len(room):
                room.append(capacity)
            home[kind] = (at, capacity - room[at])
            room[at] -= size
        pdf = pdf.sort_values(["class", "number"], kind="stable")
        inside = pdf.groupby("class")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = MERGED + pdf["class"].map(lambda k: home[k][0]).astype("int64")
        pdf["offset"] = inside + pdf["class"].map(lambda k: home[k][1])
        return pdf[["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]]

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = None,
    capacity: int = CAPACITY,
    tolerance: float = TOLERANCE,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every piece with its ids, sequence and place there (columns ``PLACED``).

    The pieces are written once: the open bins of the workers and the closed ones are two
    reads of that table, so that no text is encoded twice.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    path = fresh_path(docs.sparkSession, "pieces")
    filled = rows.mapInArrow(fill(tokenizer, end_id, capacity, tolerance), PIECES)
    with batch_rows(docs.sparkSession, ROWS_PER_BATCH):
        filled.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    pieces = docs.sparkSession.read.schema(PIECES).parquet(path)
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    own = F.shiftleft(F.col("worker").cast("bigint"), WORKER_BITS) + F.col("bin")
    closed = pieces.where("closed").withColumn("sequence_id", own).select(columns)

    # At most one bin per class and worker is open: this is small next to the corpus.
    by_class = Window.partitionBy("class").orderBy("worker", "slot")
    pooled = pieces.where("not closed").withColumn("number", F.row_number().over(by_class) - 1)
    pooled = pooled.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("class")))
    pooled = pooled.withColumn("group", F.expr("number div class"))
    whole = F.col("number") < F.expr("members div class * class")
    in_bin = Window.partitionBy("class", "group").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    second = (
        pooled.where(whole)
        .withColumn("offset", F.sum("length").over(in_bin) - F.col("length"))
        .withColumn("sequence_id", F.lit(POOLED) + F.shiftleft(F.col("class").cast("bigint"), WORKER_BITS) + F.col("group"))
        .select(columns)
    )
    # Fewer than ``class`` pieces of each class, together less than one bin per class.
    last = pooled.where(~whole).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_merge(capacity), PLACED)
    return closed.unionByName(second).unionByName(last)


def digest(placed: DataFrame) -> DataFrame:
    """``placed`` with each piece's ids replaced by their CRC-32."""
    narrow = "doc_id BIGINT, start BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"
    rows = placed.select("doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids")
    return checksums(rows, narrow).withColumnRenamed("n_read", "length")


def sequences(placed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): whole sequences padded to ``capacity``.

    A group holds at most ``capacity`` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.getField("ids"))).alias("ids"))
    missing = F.lit(capacity) - F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), missing))
    return joined.select("sequence_id", padded.alias("ids"), F.size("ids").cast("bigint").alias("n_tokens"))
