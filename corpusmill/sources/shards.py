"""Binary token shards as a Spark data source.

Layout: ``<path>/<split>/shard_00000.bin``, headerless little-endian uint16. The source
reads byte ranges in parallel; the sink streams sorted chunks and publishes whole files
only when the job commits.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from corpusmill.constants import EOS_ID, MAX_TOKEN_ID

CHUNK_SCHEMA = "split STRING, shard INT, shard_offset INT, ids ARRAY<INT>"
WINDOW_SCHEMA = "split STRING, shard INT, window INT, ids ARRAY<INT>"
VERIFY_SCHEMA = "split STRING, shard INT, path STRING, token_count BIGINT, eos_count BIGINT, sha256 STRING"
DISK_TYPE = np.dtype("<u2")
RANGE_TOKENS = 32 << 20
ROW_TOKENS = 64 << 10
HASH_BYTES = 8 << 20
TASK_TOKENS = 100_000_000
_SHARD_NAME = re.compile(r"shard_(\d+)\.bin")


def shard_name(index: int) -> str:
    return f"shard_{index:05d}.bin"


def shard_index(name: str) -> int | None:
    match = _SHARD_NAME.fullmatch(name)
    return int(match.group(1)) if match else None


def relative_file(split: str, index: int) -> str:
    """File below the dataset folder; a dataset without splits keeps its shards at the top."""
    return f"{split}/{shard_name(index)}" if split else shard_name(index)


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or plain local path."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem, inner.rstrip("/")


def list_shards(path: str) -> list[tuple[str, int, str, int]]:
    """(split, shard index, file, bytes) in numeric shard order."""
    filesystem, root = open_path(path)
    selector = pafs.FileSelector(root, recursive=True, allow_not_found=True)
    found = []
    for info in filesystem.get_file_info(selector):
        parts = info.path[len(root):].strip("/").split("/")
        index = shard_index(parts[-1])
        if info.type == pafs.FileType.File and index is not None and len(parts) <= 2:
            split = parts[0] if len(parts) == 2 else ""
            found.append((split, index, info.path, info.size))
    return sorted(found)


def read_json(file: str) -> dict | None:
    """The content of a small JSON file, or None where there is none."""
    filesystem, inner = open_path(file)
    if filesystem.get_file_info(inner).type != pafs.FileType.File:
        return None
    with filesystem.open_input_stream(inner) as source:
        return json.loads(source.read())


def published(path: str) -> list[tuple[str, int, str, int]]:
    """``list_shards`` as far as the metadata names them; all of them where nothing is recorded.

    Other subfolders and shards beyond the recorded number, as a longer run or one that has not
    ended leaves them, are not part of the dataset. A recorded shard without a file is an error.
    """
    found = list_shards(path)
    records = read_json(f"{path}/metadata.json")
    if records is None:
        splits = {split for split, *_ in found if split}
        records = {s: r for s in splits if (r := read_json(f"{path}/{s}/metadata.json")) is not None}
        named = [f for f in found if f[0] not in records or f[1] < records[f[0]]["num_shards"]]
    else:
        records = {"": records} if "num_shards" in records else records
        named = [f for f in found if f[0] in records and f[1] < records[f[0]]["num_shards"]]
    for split, record in sorted(records.items()):
        there = {index for s, index, *_ in named if s == split}
        if len(there) < record["num_shards"]:
            lost = next(i for i in range(record["num_shards"]) if i not in there)
            raise FileNotFoundError(f"{path}: the metadata names {relative_file(split, lost)}, which is missing")
    return named


@dataclass
class ShardRange:
    split: str
    shard: int
    file: str
    start: int
    tokens: int


@dataclass
class ReadTask(InputPartition):
    ranges: list[ShardRange]


class ShardReader(DataSourceReader):
    def __init__(self, path: str, length: int | None, range_tokens: int = RANGE_TOKENS, tasks: int = 1):
        self.path, self.length, self.range_tokens, self.tasks = path, length, range_tokens, tasks

    def partitions(self) -> list[ReadTask]:
        """Long shards are cut and short ones read together, towards equal tasks."""
        ranges = self._ranges()
        goal = min(self.range_tokens, -(-sum(r.tokens for r in ranges) // self.tasks))
        tasks, filled = [], goal
        for piece in ranges:
            if filled + piece.tokens > goal:
                tasks.append(ReadTask([]))
                filled = 0
            tasks[-1].ranges.append(piece)
            filled += piece.tokens
        return tasks

    def _ranges(self) -> list[ShardRange]:
        shards = published(self.path)
        if not shards:
            raise FileNotFoundError(f"No shards in {self.path}. Run the preprocess job first.")
        step = self.range_tokens
        if self.length is not None:
            step = max(1, step // self.length) * self.length
        ranges = []
        for split, shard, file, size in shards:
            total = size // DISK_TYPE.itemsize
            for start in range(0, total, step):
                # A range of windows also needs the token it shares with the next range.
                extra = 0 if self.length is None else 1
                ranges.append(ShardRange(split, shard, file, start, min(step + extra, total - start)))
        return ranges

    def read(self, partition: ReadTask) -> Iterator[pa.RecordBatch]:
        for piece in partition.ranges:
            yield from self._read_range(piece)

    def _read_range(self, partition: ShardRange) -> Iterator[pa.RecordBatch]:
        filesystem, _ = open_path(self.path)
        per_row = ROW_TOKENS if self.length is None else self.length
        rows_at_once = max(1, (4 << 20) // per_row)
        with filesystem.open_input_file(partition.file) as source:
            source.seek(partition.start * DISK_TYPE.itemsize)
            done = 0
            while done < partition.tokens:
                want = min(per_row * rows_at_once, partition.tokens - done)
                extra = 0 if self.length is None else min(1, partition.tokens - done - want)
                data = source.read((want + extra) * DISK_TYPE.itemsize)
                source.seek(-extra * DISK_TYPE.itemsize, 1)
                tokens = np.frombuffer(data, dtype=DISK_TYPE).astype(np.int32)
                yield self._batch(partition, partition.start + done, tokens, per_row)
                done += want

    def _batch(self, part: ShardRange, start: int, tokens: np.ndarray, per_row: int) -> pa.RecordBatch:
        if self.length is None:
            cuts = np.append(np.arange(0, len(tokens), per_row), len(tokens)).astype(np.int32)
            values, place, name = tokens, start + cuts[:-1], "shard_offset"
        else:
            width = self.length + 1
            if len(tokens) >= width:
                rows = np.lib.stride_tricks.sliding_window_view(tokens, width)[:: self.length]
            else:
                rows = np.empty((0, width), np.int32)
            values, cuts = rows.ravel(), np.arange(len(rows) + 1, dtype=np.int32) * width
            place, name = start // self.length + np.arange(len(rows)), "window"
        n = len(cuts) - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part.split] * n, pa.string()),
                pa.array([part.shard] * n, pa.int32()),
                pa.array(place, pa.int32()),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(values)),
            ],
            names=["split", "shard", name, "ids"],
        )


@dataclass
class WrittenShards(WriterCommitMessage):
    files: list[tuple[str, str, int]] = field(default_factory=list)


class ShardWriter(DataSourceArrowWriter):
    """Appends chunks in shard order to staged files; commit moves them into place."""

    def __init__(self, path: str, overwrite: bool, vocab_size: int | None):
        self.path, self.overwrite, self.vocab_size = path, overwrite, vocab_size
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _check(self, tokens: np.ndarray) -> None:
        if not len(tokens):
            return
        low, high = int(tokens.min()), int(tokens.max())
        if low < 0 or high > MAX_TOKEN_ID:
            raise ValueError(f"Token id {low if low < 0 else high} is no uint16")
        if self.vocab_size is not None and high >= self.vocab_size:
            raise ValueError(f"Token id {high} exceeds the declared vocab, {self.vocab_size} ids")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenShards:
        filesystem, root = open_path(self.path)
        attempt = uuid.uuid4().hex
        done, current, sink, filled = WrittenShards(), None, None, 0

        def finish() -> None:
            if sink is not None:
                sink.close()
                done.files.append((staged, relative_file(*current), filled))

        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("split", "shard", "shard_offset")]
                ids = batch.column(batch.schema.get_field_index("ids"))
                for row, (split, shard, offset) in enumerate(zip(*(c.to_pylist() for c in columns))):
                    if (split, shard) != current:
                        finish()
                        current, filled = (split, shard), 0
                        staged = f"{root}/{self.staging}/{attempt}-{split}-{shard}"
                        filesystem.create_dir(f"{root}/{self.staging}", recursive=True)
                        sink = filesystem.open_output_stream(staged)
                    if offset != filled:
                        raise ValueError(f"{split} shard {shard}: chunk at {offset}, expected {filled}")
                    tokens = ids[row].values.to_numpy(zero_copy_only=False)
                    self._check(tokens)
                    sink.write(tokens.astype(DISK_TYPE).tobytes())
                    filled += len(tokens)
            finish()
            sink = None
        finally:
            if sink is not None:
                sink.close()
        return done

    def commit(self, messages: list[WrittenShards | None]) -> None:
        filesystem, root = open_path(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            # What is recorded of an earlier run is no longer true from here on.
            for folder in {"", *(split for split, *_ in list_shards(self.path))}:
                record = f"{root}/{folder}/metadata.json" if folder else f"{root}/metadata.json"
                if filesystem.get_file_info(record).type == pafs.FileType.File:
                    filesystem.delete_file(record)
        for folder in sorted({final.rpartition("/")[0] for _, final, _ in files}):
            filesystem.create_dir(f"{root}/{folder}", recursive=True)
        kept = {final for _, final, _ in files}
        for staged, final, _ in files:
            filesystem.move(staged, f"{root}/{final}")
        if self.overwrite:
            # Shards of an earlier, longer run must not be read as part of this one.
            for split, index, file, _ in list_shards(self.path):
                if relative_file(split, index) not in kept:
                    filesystem.delete_file(file)
        self._drop_staging()

    def abort(self, messages: list[WrittenShards | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        filesystem, root = open_path(self.path)
        if filesystem.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            filesystem.delete_dir(f"{root}/{self.staging}")


class TokenShards(DataSource):
    """``token_shards``: options ``path``, ``context_length`` to read windows, ``range_tokens``
    and ``tasks`` to size read tasks, and ``vocab_size`` to check written ids."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return WINDOW_SCHEMA if self.options.get("context_length") else CHUNK_SCHEMA

    def reader(self, schema) -> ShardReader:
        length = self.options.get("context_length")
        range_tokens = int(self.options.get("range_tokens", RANGE_TOKENS))
        tasks = int(self.options.get("tasks", "1"))
        return ShardReader(self.options["path"], int(length) if length else None, range_tokens, tasks)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        vocab = self.options.get("vocab_size")
        return ShardWriter(self.options["path"], overwrite, int(vocab) if vocab else None)


def _tasks(spark: SparkSession, shard_count: int, tokens: int) -> int:
    """Tasks for whole shards: one full-size shard each, small shards together."""
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS))
    return max(1, min(shard_count, wanted))


def write(
    chunks: DataFrame, shards_per_split: dict[str, int], shard_size: int, path: str,
    vocab_size: int | None = None, mode: str = "overwrite", first: dict[str, int] | None = None,
) -> None:
    """Write packed chunks as shard files.

    Tasks take equal runs of shards by their running number, so they are balanced by
    construction and no sampling pass is needed.
    """
    spark = chunks.sparkSession
    spark.dataSource.register(TokenShards)
    first = first or {}
    number, total = F.lit(0), 0
    for split, count in sorted(shards_per_split.items()):
        here = F.col("shard") - F.lit(first.get(split, 0)) + F.lit(total)
        number = F.when(F.col("split") == split, here).otherwise(number)
        total += count
    tasks = _tasks(spark, total, total * shard_size)
    task = F.floor(number * F.lit(tasks) / F.lit(max(1, total))).cast("int")
    ordered = (
        chunks.select("split", "shard", "shard_offset", "ids")
        .repartitionById(tasks, F.pmod(task, F.lit(tasks)))
        .sortWithinPartitions("split", "shard", "shard_offset")
    )
    writer = ordered.write.format("token_shards").option("path", path).mode(mode)
    if vocab_size is not None:
        writer = writer.option("vocab_size", str(vocab_size))
    writer.save()


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Chunks of every shard under ``path``."""
    spark.dataSource.register(TokenShards)
    _require_shards(path)
    options = {"tasks": 2 * spark.sparkContext.defaultParallelism, **options}
    return spark.read.format("token_shards").options(path=path, **options).load()


def read_windows(spark: SparkSession, path: str, length: int, **options: object) -> DataFrame:
    """Training windows straight from the files: no shuffle, byte ranges aligned to windows."""
    return read(spark, path, context_length=length, **options)


def _require_shards(path: str) -> None:
    if not published(path):
        raise FileNotFoundError(f"No shards in {path}. Run the preprocess job first.")


def verify(spark: SparkSession, path: str, eos_id: int = EOS_ID) -> DataFrame:
    """Token count, end-marker count and SHA-256 of every shard file, read back from storage."""
    shards = list_shards(path)
    listing = spark.createDataFrame(
        [(split, index, file) for split, index, file, _ in shards], "split STRING, shard INT, file STRING"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = open_path(path)
        for batch in batches:
            rows = [(*key.values(), *_digest(filesystem, key["file"], eos_id)) for key in batch.to_pylist()]
            if rows:
                columns = list(zip(*((s, i, f.rsplit("/", 1)[-1], n, e, h) for s, i, f, n, e, h in rows)))
                types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                names = ["split", "shard", "path", "token_count", "eos_count", "sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    tasks = _tasks(spark, len(shards), sum(size for *_, size in shards) // DISK_TYPE.itemsize)
    return listing.repartition(tasks).mapInArrow(check, VERIFY_SCHEMA)


def _digest(filesystem: pafs.FileSystem, file: str, eos_id: int) -> tuple[int, int, str]:
    sha, tokens, ends = hashlib.sha256(), 0, 0
    with filesystem.open_input_stream(file) as source:
        while data := source.read(HASH_BYTES):
            sha.update(data)
            ids = np.frombuffer(data, dtype=DISK_TYPE)
            tokens += len(ids)
            ends += int(np.count_nonzero(ids == eos_id))
    return tokens, ends, sha.hexdigest()
