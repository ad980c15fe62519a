"""Language-model scores of whole documents by a recurrent model trained on the corpus.

Counts of every training word come first (aggregated per task before they are shuffled). The
most frequent words are the model's vocabulary; all others share one token, and which of them
it is costs their share of the counts, so that every text has a proper probability. Training is
data-parallel: in each of a few rounds every task continues from the shared parameters over
its share of the documents, reading each of them whole with the state carried along, and the
results are averaged by tokens read. All training documents are used once, so the work and
what is gathered grow with the corpus. The gradient counts the loss at every token.

Scoring reads each text once. Words of the count table's head, whose size is fixed, are looked
up in memory; the rest are joined with the table as (document, word) rows. No word of that
rest is frequent, so the join has no hot key.

Defined results: null, empty and blank texts are the end token alone. Repeated rows are scored
one by one; null ids are carried and count as held out or not like the text ``null`` would.
With no training document every word is unseen. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.recurrent import Adam, Shape, score, train
from corpusmill.llm.tokens import text_slices
from corpusmill.llm.words import word_arrays, worker_state
from corpusmill.session import materialize

END = b""
SMOOTHING = 0.1
HEAD_WORDS = 1 << 18
ROUNDS = 3
FOLDS = 10
CHUNK_TOKENS = 4_000_000
COUNTER_WORDS = 200_000
# Counts are held up to this multiple before equal words are put together.
HELD_TIMES = 4
BYTES_AT_ONCE = 4 << 20
ROWS_OUT = 2_000
STEPS_PER_DOUBLING = 64
PIECE = 4_096
SALTS = 16


def fold_number(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of every word, and of the end token as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in text_slices(batches, most=BYTES_AT_ONCE):
            found = word_arrays(batch.column("text"))[0].value_counts()
            held.append(pa.table([found.field("values"), found.field("counts")], ["word", "n"]))
            ends += batch.num_rows
            if sum(map(len, held)) > HELD_TIMES * COUNTER_WORDS:
                held = [merged()]
                if len(held[0]) > COUNTER_WORDS:
                    yield from held.pop().to_batches(max_chunksize=COUNTER_WORDS)
        if held:
            yield from merged().to_batches(max_chunksize=COUNTER_WORDS)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word BINARY, n BIGINT")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Head of the count table, totals and parameters; bounded whatever the corpus."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    shape: Shape
    flat: np.ndarray

    @property
    def own_words(self) -> int:
        """Head words with a token of their own: all but the end and the shared token."""
        return min(len(self.words), self.shape.vocabulary - 2)

    @property
    def rare_mass(self) -> float:
        """Smoothed count of all words without a token of their own, one unseen word included."""
        own = self.own_words
        rest = self.total - int(self.counts[:own].sum()) - self.ends
        return rest + SMOOTHING * (self.distinct - own - bool(self.ends) + 1)

    ends: int = 0

    def slot_counts(self) -> np.ndarray:
        found = np.zeros(self.shape.vocabulary)
        found[0] = max(self.ends, 1)
        found[1 : 1 + self.own_words] = self.counts[: self.own_words]
        found[-1] = max(self.rare_mass, 1.0)
        return found


def places(words: pa.Array, table: pa.Array) -> np.ndarray:
    """Where each word stands in ``table``; -1: nowhere."""
    return pc.fill_null(pc.index_in(words, value_set=table), -1).to_numpy(zero_copy_only=False)


def token_ids(at: np.ndarray, sizes: np.ndarray, own_words: int, vocabulary: int) -> list[np.ndarray]:
    """Token ids of each text, the end after its words, from its words' places in the head."""
    ids = np.where((at >= 0) & (at < own_words), at + 1, vocabulary - 1).astype(np.int32)
    return np.split(np.insert(ids, np.cumsum(sizes), 0), np.cumsum(sizes + 1)[:-1])


def _chunks(docs: Iterator, limit: int = CHUNK_TOKENS, size: Callable = len) -> Iterator[list]:
    """Lists of (info, ids) with about ``limit`` ids each, or one item if that is larger."""
    held, total = [], 0
    for info, ids in docs:
        held.append((info, ids))
        total += size(ids)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def _broadcast(docs: DataFrame, model: object):
    """The model as bytes that carry its classes: workers need not have the package."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))


def _round(docs: DataFrame, model: Model, rate: float) -> np.ndarray:
    """The parameters after every task trained on its documents, averaged by tokens read.

    Only the words with a token of their own are sent: all others are one token here.
    """
    sent = _broadcast(docs, (model.shape, model.flat, model.words[: model.own_words]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, flat, own = pickle.loads(sent.value)
        flat, optimizer, table, read = flat.copy(), Adam(shape.size, rate), pa.array(own, pa.binary()), 0

        def texts() -> Iterator[tuple]:
            for batch in text_slices(batches, most=BYTES_AT_ONCE):
                words, sizes = word_arrays(batch.column("text"))
                yield from zip(repeat(None), token_ids(places(words, table), sizes, len(own), shape.vocabulary))

        for chunk in _chunks(texts()):
            read += train(shape, flat, [ids for _, ids in chunk], optimizer)
        if read:
            pieces = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
            salt = TaskContext.get().partitionId() % SALTS
            columns = [
                pa.array(range(len(pieces)), pa.int32()),
                pa.array([salt] * len(pieces), pa.int32()),
                pa.array([read] * len(pieces), pa.int64()),
                pa.array(pieces, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "salt", "tokens", "data"])

    def average(table: pa.Table) -> pa.Table:
        weights = table.column("tokens").to_numpy().astype(np.float64)
        total = sum(w * np.frombuffer(d, np.float32) for w, d in zip(weights, table.column("data").to_pylist(), strict=True))
        mean = (total / weights.sum()).astype(np.float32)
        first = table.slice(0, 1)
        columns = [first.column("piece"), first.column("salt"), pa.array([int(weights.sum())], pa.int64()), pa.array([mean.tobytes()], pa.binary())]
        return pa.table(columns, ["piece", "salt", "tokens", "data"])

    schema = "piece INT, salt INT, tokens BIGINT, data BINARY"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    # Two steps, so that no group grows with the number of tasks times the model.
    part_means = parts.groupBy("piece", "salt").applyInArrow(average, schema)
    rows = part_means.groupBy("piece").applyInArrow(average, schema).collect()
    if not rows:
        return model.flat
    return np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(rows, key=lambda r: r.piece)])


def _head(words: DataFrame, most: int) -> list:
    """Frequent words, at most ``most`` of them, by falling count.

    Counts are grouped by a step of their logarithm; whole steps are taken from the top, so
    that the driver gets no row beyond the head. If the first step is larger than the head, the
    first of its words, by count and then spelling, are.
    """
    step = F.floor(F.log2("n") * STEPS_PER_DOUBLING)
    sizes = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("size")).collect()
    lowest, size = None, 0
    for r in sorted(sizes, reverse=True):
        size += r["size"]
        if size > most:
            break
        lowest = r["step"]
    if lowest is None:
        return words.orderBy(F.desc("n"), "word").limit(most).collect()
    return sorted(words.where(step >= lowest).collect(), key=lambda r: (-r.n, bytes(r.word)))


def fit(docs: DataFrame, counts: DataFrame, key: str = "doc_id", rounds: int = ROUNDS, head_words: int = HEAD_WORDS, shape: Shape | None = None, rate: float = 0.015) -> Model:
    """A model of ``docs``, whose ``word_counts`` are given; one pass, a share of the documents per round."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    head = _head(counts.where(F.octet_length("word") > 0), head_words)
    shape = shape or Shape()
    model = Model(
        [bytes(r.word) for r in head], np.array([r.n for r in head], np.int64), totals.n, totals.v, shape, np.empty(0, np.float32), ends=ends
    )
    model.flat = shape.start(model.slot_counts())
    part = (F.floor(fold_number(F.col(key)) / FOLDS)) % rounds
    for number in range(rounds):
        model.flat = _round(docs.where(part == number), model, rate / (1 + number))
    return model


SCORED = (
    "row BIGINT, doc_id BIGINT, n_tokens BIGINT, n_head BIGINT, head_sum DOUBLE, rare_sum DOUBLE, n_rare BIGINT, "
    "model DOUBLE, tail ARRAY<STRUCT<word: BINARY, times: INT>>"
)

SCORED_NAMES = [part.split(" ")[0] for part in SCORED.split("<")[0].split(", ")]


def _score_rows(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    sent, name = _broadcast(docs, model), uuid.uuid4().hex

    def opened() -> tuple[Model, pa.Array]:
        own = pickle.loads(sent.value)
        return own, pa.array(own.words, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Read once per worker, not per task.
        own, table = worker_state(("lm", name), opened)
        row, known = TaskContext.get().partitionId() << 33, int(bool(own.ends))
        # The place -1 is that of words outside of the head.
        logs = np.append(np.log10(own.counts + SMOOTHING), 0.0)
        end_log = np.log10(own.ends + SMOOTHING)

        def rows(doc_ids: pa.Array, words: pa.Array, sizes: np.ndarray, at: np.ndarray) -> list:
            """All columns but the row's number and the model's, which goes before the last."""
            n, owner, worth = len(sizes), np.repeat(np.arange(len(sizes)), sizes), logs[at]
            rare, outside = at >= own.own_words, np.flatnonzero(at < 0)
            n_tail = np.bincount(owner[outside], minlength=n)
            tail = words.take(pa.array(outside)).dictionary_encode()
            spread = max(1, len(tail.dictionary))
            entries, times = np.unique(owner[outside] * spread + tail.indices.to_numpy(zero_copy_only=False), return_counts=True)
            structs = pa.StructArray.from_arrays([tail.dictionary.take(pa.array(entries % spread)), pa.array(times, pa.int32())], ["word", "times"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(entries // spread, minlength=n))])
            return [
                doc_ids,
                pa.array(sizes + 1),
                pa.array(sizes - n_tail + known),
                pa.array(np.bincount(owner, worth, n) + end_log, pa.float64()),
                pa.array(np.bincount(owner[rare], worth[rare], n).astype(np.float64)),
                pa.array(np.bincount(owner[rare], minlength=n) + n_tail),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
            ]

        def texts() -> Iterator[tuple]:
            for batch in text_slices(batches, most=BYTES_AT_ONCE):
                words, sizes = word_arrays(batch.column("text"))
                at = places(words, table)
                yield rows(batch.column("doc_id"), words, sizes, at), token_ids(at, sizes, own.own_words, own.shape.vocabulary)

        for chunk in _chunks(texts(), size=lambda docs: sum(map(len, docs))):
            found = score(own.shape, own.flat, [ids for _, docs in chunk for ids in docs]) / np.log(10)
            for columns, docs in chunk:
                n = len(docs)
                numbers, scores, found = np.arange(row, row + n), found[:n], found[n:]
                row += n
                part = pa.RecordBatch.from_arrays([pa.array(numbers), *columns[:-1], pa.array(scores), columns[-1]], SCORED_NAMES)
                yield from (part.slice(k, ROWS_OUT) for k in range(0, n, ROWS_OUT))

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCORED)


def score_documents(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row; log10 probabilities."""
    rows = materialize(_score_rows(docs, model, key, text), "scored")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times")
    met = tail.join(counts, "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))
    sums = met.groupBy("row").agg(
        F.sum(F.col("times") * log).alias("tail_sum"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_tail")
    )
    z = float(np.log10(model.total + SMOOTHING * (model.distinct + 1)))
    z_rare = float(np.log10(model.rare_mass))
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    return rows.drop("tail").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("bigint").alias("n_known"),
        (F.col("head_sum") + tail_sum - F.col("n_tokens") * z).alias("base_score"),
        (F.col("model") + F.col("rare_sum") + tail_sum - F.col("n_rare") * z_rare).alias("score"),
    )
