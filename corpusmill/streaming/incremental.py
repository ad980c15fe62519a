"""Incremental dataset build: micro-batches of documents extend both splits.

The ledger, one small file, holds the running counters and which batches hold parts of the
shards that are still open. A batch starts from the row of the batch before it and writes
everything under its own id, its ledger row last, so a replay after a failure repeats the same
result. The work of a batch depends on its own size and on the shards it fills, not on how many
batches came before: chunks of finished shards are removed, and no folder of all batches is listed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.constants import BOS_ID, EOS_ID, MIN_WORDS, SHARD_SIZE, VAL_EVERY
from corpusmill.functions import bytes as by
from corpusmill.functions import codec
from corpusmill.operators import pack
from corpusmill.operators.order import ROWS_PER_BLOCK, key_blocks
from corpusmill.session import materialize
from corpusmill.sources import corpus, metadata, shards
from corpusmill.sources.shards import open_path
from corpusmill.sources.vocabulary import Pieces

SPLITS = ("train", "val")
CHUNK_SCHEMA = "shard_offset INT, ids ARRAY<INT>, batch_id BIGINT, split STRING, shard INT"
START = {
    "batch_id": -1, "accepted": 0, "train_docs": 0, "val_docs": 0, "train_tokens": 0, "val_tokens": 0,
    "train_open": [], "val_open": [],
}


@dataclass(frozen=True)
class IncrementalBuild:
    """Settings of one incremental dataset; ``pieces=None`` uses the byte tokenizer.

    ``limit`` counts accepted documents over all batches; later ones are read and left out.
    ``more`` goes into the metadata of each split.
    """

    output: str
    vocab_size: int
    pieces: Pieces | None = None
    min_words: int = MIN_WORDS
    val_every: int = VAL_EVERY
    shard_size: int = SHARD_SIZE
    add_bos: bool = True
    limit: int | None = None
    more: dict[str, object] | None = None

    def start(self, documents: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Run over a streaming table of doc_id and text, or of file, row and text."""
        writer = documents.writeStream.foreachBatch(self.run_batch).option(
            "checkpointLocation", f"{self.output}/_stream"
        )
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def _rows(self) -> list[dict]:
        """The ledger: the rows of the last two batches, so that the last one can be replayed."""
        filesystem, file = open_path(f"{self.output}/ledger.json")
        if filesystem.get_file_info(file).type != pafs.FileType.File:
            return []
        with filesystem.open_input_stream(file) as source:
            return json.loads(source.read())

    def ledger(self, before: int | None = None) -> dict:
        """Counters and open batches after the last batch, or after the last one before ``before``."""
        rows = self._rows()
        earlier = [r for r in rows if before is None or r["batch_id"] < before]
        if not earlier and len(rows) > 1:
            raise ValueError(f"batch {before} is older than the ledger, which begins at {rows[0]['batch_id']}")
        return earlier[-1] if earlier else START

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        so_far = self.ledger(batch_id)
        # The stream committed the batch of ``so_far`` before it began this one.
        self._drop_finished(so_far)
        now = {**so_far, "batch_id": batch_id, "done": []}
        left = None if self.limit is None else self.limit - so_far["accepted"]
        if left is None or left > 0:
            self._add(batch, so_far, now, left)
        self._keep(so_far, now)

    def _add(self, batch: DataFrame, so_far: dict, now: dict, left: int | None) -> None:
        """Pack the batch behind what came before; its counters go into ``now``."""
        accepted = self._accepted(batch)
        count = accepted.count()
        now["accepted"] += count if left is None else min(count, left)
        numbered = corpus.number(accepted, left, so_far["accepted"])
        numbered = numbered.withColumn("split", pack.split_of(F.col("ordinal"), self.val_every))
        bos = BOS_ID if self.add_bos else None
        if self.pieces is None:
            length, carry, framed = by.byte_length(F.col("text")), "text", pack.frame(by.byte_ids(F.col("text")), bos)
        else:
            numbered = numbered.withColumn("ids", codec.encode(F.col("text"), self.pieces))
            length, carry, framed = F.size("ids"), "ids", pack.frame(F.col("ids"), bos)
        placed = pack.place(numbered, length, [carry], pack.framing_tokens(self.add_bos))
        totals = {r.split: r for r in pack.split_totals(placed, self.shard_size).collect()}

        started = F.when(F.col("split") == "val", so_far["val_tokens"]).otherwise(so_far["train_tokens"])
        chunks = pack.chunks(placed.withColumn("offset", F.col("offset") + started), framed, self.shard_size)
        # Chunks are written where they lie, and shuffled once, when their shard is full.
        chunks.drop("doc_id").write.mode("overwrite").partitionBy("split").parquet(self._chunk_folder(now["batch_id"]))
        parts = {}
        for split, added in totals.items():
            now[f"{split}_docs"] += added.num_documents
            now[f"{split}_tokens"] += added.num_tokens
            parts[split] = [*so_far[f"{split}_open"], now["batch_id"]]
            full, opened = (r[f"{split}_tokens"] // self.shard_size for r in (now, so_far))
            # A shard opened by this batch has nothing from earlier ones.
            kept = parts[split] if full == opened else [now["batch_id"]]
            now[f"{split}_open"] = kept if now[f"{split}_tokens"] % self.shard_size else []
            now["done"] += [[b, split] for b in parts[split] if b not in now[f"{split}_open"]]
        ends = {s: now[f"{s}_tokens"] // self.shard_size for s in parts}
        self._write_shards(placed.sparkSession, so_far, ends, parts)

    def _accepted(self, batch: DataFrame) -> DataFrame:
        """Accepted documents in blocks, written once: the batch itself is read by this job only.

        Documents without ids come in the order of their files and rows.
        """
        if "row" in batch.columns:
            block = F.struct("file", F.expr(f"row div {ROWS_PER_BLOCK}").alias("part"))
            docs = batch.select(F.col("row").alias("doc_id"), "text", block.alias("block"))
            return materialize(corpus.accept(docs, self.min_words), "accepted")
        written = materialize(corpus.accept(batch.select("doc_id", "text"), self.min_words), "accepted")
        return written.select("*", key_blocks(written, "doc_id").alias("block"))

    def _chunk_folder(self, batch_id: int) -> str:
        return f"{self.output}/chunks/batch_id={batch_id}"

    def _write_shards(self, spark: SparkSession, so_far: dict, end: dict, parts: dict) -> None:
        """Turn chunks into files for the shards that filled up since ``so_far``.

        Only the folders of the batches that hold a part of them are opened.
        """
        first = {s: so_far[f"{s}_tokens"] // self.shard_size for s in end}
        counts = {s: end[s] - first[s] for s in end if end[s] > first[s]}
        if not counts:
            return
        wanted, folders = F.lit(False), []
        for s in counts:
            wanted = wanted | ((F.col("split") == s) & (F.col("shard") >= first[s]) & (F.col("shard") < end[s]))
            folders += [f"{self._chunk_folder(b)}/split={s}" for b in parts[s]]
        stored = spark.read.schema(CHUNK_SCHEMA).option("basePath", f"{self.output}/chunks").parquet(*folders)
        shards.write(
            stored.where(wanted), counts, self.shard_size, f"{self.output}/shards", self.vocab_size, "append", first
        )

    def _keep(self, so_far: dict, now: dict) -> None:
        """Publish the ledger; the file is swapped whole."""
        filesystem, file = open_path(f"{self.output}/ledger.json")
        filesystem.create_dir(file.rpartition("/")[0], recursive=True)
        with filesystem.open_output_stream(f"{file}.next") as sink:
            sink.write(json.dumps([r for r in (so_far, now) if r is not START]).encode("utf-8"))
        filesystem.move(f"{file}.next", file)

    def _drop_finished(self, row: dict) -> None:
        """Remove the chunks that the batch of ``row`` turned into shards.

        Called by the batch after it, when it can no longer be replayed. A replay finds some
        already gone.
        """
        for batch_id, split in row.get("done", []):
            filesystem, folder = open_path(f"{self._chunk_folder(batch_id)}/split={split}")
            if filesystem.get_file_info(folder).type == pafs.FileType.Directory:
                filesystem.delete_dir(folder)

    def close(self, spark: SparkSession) -> dict[str, dict]:
        """Write the partly filled last shards, then verify and describe the dataset."""
        final = self.ledger()
        ends = {s: -(-final[f"{s}_tokens"] // self.shard_size) for s in SPLITS}
        self._write_shards(spark, final, ends, {s: final[f"{s}_open"] for s in SPLITS})
        rows = [(s, final[f"{s}_docs"], final[f"{s}_tokens"], ends[s]) for s in SPLITS]
        totals = spark.createDataFrame(
            rows, "split STRING, num_documents BIGINT, num_tokens BIGINT, num_shards BIGINT"
        )
        path, bos = f"{self.output}/shards", BOS_ID if self.add_bos else None
        checked = shards.verify(spark, path)
        records = metadata.assemble(totals, self.vocab_size, EOS_ID, bos, self.shard_size, checked)
        written = metadata.write_records(records, path, self.more)
        metadata.write_manifest(written, path)
        return written


def landing_stream(spark: SparkSession, path: str, files_per_batch: int = 1, keyed: bool = True) -> DataFrame:
    """Documents from a landing folder, oldest files first; without ``keyed`` files need text only."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if keyed:
        return reader.schema(corpus.DOCUMENT_SCHEMA).parquet(path)
    meta = F.col("_metadata")
    return reader.schema("text STRING").parquet(path).select(
        meta.getField("file_path").alias("file"), meta.getField("row_index").alias("row"), "text"
    )
