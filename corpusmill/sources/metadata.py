"""Shard metadata and the dataset manifest as JSON."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import SHARD_DTYPE
from corpusmill.sources.shards import list_shards, open_path

VERIFICATION = "ARRAY<STRUCT<path: STRING, token_count: BIGINT, eos_count: BIGINT, sha256: STRING>>"
METADATA_SCHEMA = (
    "version STRING, dtype STRING, vocab_size INT, eos_id INT, bos_id INT, num_documents BIGINT, "
    "num_tokens BIGINT, num_shards BIGINT, shard_size BIGINT, packing STRING, created_at STRING, "
    f"verification {VERIFICATION}"
)


def assemble(
    totals: DataFrame,
    vocab_size: int,
    eos_id: int,
    bos_id: int | None,
    shard_size: int,
    verification: DataFrame | None = None,
) -> DataFrame:
    """One metadata record per split from its totals and, if given, its verified shards."""
    now = datetime.now(timezone.utc).isoformat()
    record = totals.select(
        "split",
        F.lit("2.0").alias("version"),
        F.lit(SHARD_DTYPE).alias("dtype"),
        F.lit(vocab_size).alias("vocab_size"),
        F.lit(eos_id).alias("eos_id"),
        F.lit(bos_id).cast("int").alias("bos_id"),
        "num_documents",
        "num_tokens",
        "num_shards",
        F.lit(shard_size).cast("bigint").alias("shard_size"),
        F.lit("continuous").alias("packing"),
        F.lit(now).alias("created_at"),
    )
    if verification is None:
        return record
    entry = F.struct("shard", "path", "token_count", "eos_count", "sha256")
    entries = verification.groupBy("split").agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    listed = F.transform(F.coalesce("_entries", F.array()), lambda e: e.dropFields("shard"))
    return record.join(entries, "split", "left").withColumn("verification", listed).drop("_entries")


def write_records(records: DataFrame, path: str, extra: dict[str, object] | None = None) -> dict[str, dict]:
    """Write ``metadata.json`` per split, extras last so that they win, and return the records.

    A record holds one entry per shard, about a millionth of the shard's own size.
    """
    fields = [c for c in records.columns if c != "split"]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    written = {}
    for row in records.select("split", text.alias("json")).collect():
        record = json.loads(row.json)
        checked = {"verification": record.pop("verification")} if "verification" in record else {}
        written[row.split] = {**record, **(extra or {}), **checked}
        folder = f"{path}/{row.split}" if row.split else path
        write_json(written[row.split], f"{folder}/metadata.json")
    return written


def write_json(value: dict, file: str) -> None:
    filesystem, inner = open_path(file)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(inner) as sink:
        sink.write(json.dumps(value, indent=2).encode("utf-8"))


def write_manifest(records: dict[str, dict], path: str) -> None:
    """The top-level ``metadata.json``: split name to record."""
    write_json(records, f"{path}/metadata.json")


def read(spark: SparkSession, split_path: str) -> DataFrame:
    """The split's record, or no rows when it was never written."""
    filesystem, inner = open_path(f"{split_path}/metadata.json")
    if filesystem.get_file_info(inner).type != pafs.FileType.File:
        return spark.createDataFrame([], METADATA_SCHEMA)
    return spark.read.schema(METADATA_SCHEMA).json(f"{split_path}/metadata.json", multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All records of the manifest, one row per split."""
    shape = f"MAP<STRING, STRUCT<{METADATA_SCHEMA}>>"
    raw = spark.read.text(f"{path}/metadata.json", wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", shape)).alias("split", "record"))
    return entries.select("split", "record.*")


def token_count(spark: SparkSession, split_path: str) -> int:
    """Tokens according to the metadata, or else to the file sizes."""
    known = read(spark, split_path).select("num_tokens").first()
    if known is not None and known.num_tokens is not None:
        return known.num_tokens
    return sum(size // 2 for _, _, _, size in list_shards(split_path))


def vocab_size(spark: SparkSession, split_path: str) -> int | None:
    known = read(spark, split_path).select("vocab_size").first()
    return None if known is None else known.vocab_size

