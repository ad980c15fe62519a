"""Text corpora as document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import MIN_WORDS
from corpusmill.functions import text as tx
from corpusmill.operators.order import ROWS_PER_BLOCK, key_blocks, running_base, scan_blocks, with_ordinal
from corpusmill.session import materialize

DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING"


def scan(spark: SparkSession, path: str, rows_per_block: int | None = None) -> DataFrame:
    """Documents of a parquet corpus in blocks of neighbouring ``doc_id``."""
    raw = spark.read.schema(DOCUMENT_SCHEMA).parquet(path)
    options = {} if rows_per_block is None else {"rows_per_block": rows_per_block}
    return spread(raw.select("*", key_blocks(raw, "doc_id", **options).alias("block")))


def spread(docs: DataFrame) -> DataFrame:
    """Use all cores on a corpus of fewer file splits than that; large ones stay as they are."""
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(parallel) if docs.rdd.getNumPartitions() < parallel else docs


def scan_keyless(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus without ids, ordered by file name and row."""
    raw = spark.read.schema("text STRING").parquet(path)
    return scan_blocks(raw).withColumnRenamed("row_index", "doc_id")


def scan_rows(spark: SparkSession, path: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Documents of a corpus without ids: ``doc_id`` is the row's place by file name and row.

    A file is cut into blocks of ``rows_per_block`` rows, so one large file is many blocks. Their
    sizes come from a scan without columns, and the running total, one row per block, gives every
    block its first id. The blocks returned are ranges of ids, as ``scan`` returns them.
    """
    meta = F.col("_metadata")
    row = meta.getField("row_index")
    part = F.expr(f"_metadata.row_index div {rows_per_block}")
    raw = spark.read.schema("text STRING").parquet(path).select(
        "text", row.alias("_row"), F.struct(meta.getField("file_path").alias("file"), part.alias("part")).alias("block")
    )
    sizes = materialize(raw.groupBy("block").agg(F.count(F.lit(1)).alias("_rows")), "row-blocks")
    rows = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first().n
    based = raw.join(running_base(sizes, "_rows", "_base"), "block")
    placed = based.select((F.col("_base") + F.col("_row") - F.col("block.part") * rows_per_block).alias("doc_id"), "text")
    noted = {"low": 0, "high": max(0, rows - 1), "rows": rows}
    return spread(placed.select("*", F.expr(f"doc_id div {rows_per_block}").alias("block", metadata=noted if rows else {})))


def scan_any(spark: SparkSession, path: str) -> DataFrame:
    """``scan`` of files that have ``doc_id``, ``scan_rows`` of others."""
    keyed = "doc_id" in spark.read.parquet(path).columns
    return scan(spark, path) if keyed else scan_rows(spark, path)


def accept(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Strip the text and keep documents with at least ``min_words`` words."""
    stripped = docs.where(F.col("text").isNotNull()).withColumn("text", tx.strip(F.col("text")))
    return stripped.where((F.col("text") != "") & tx.has_words(F.col("text"), min_words))


def number(docs: DataFrame, limit: int | None = None, first: int = 0) -> DataFrame:
    """Global ordinal of accepted documents; ``limit`` counts accepted ones, None is all."""
    if limit is None:
        return with_ordinal(docs, ["doc_id"], first=first, unique=True)
    return with_ordinal(head(docs, limit), ["doc_id"], first=first, unique=True).where(F.col("ordinal") < first + limit)


def head(docs: DataFrame, n: int) -> DataFrame:
    """A key prefix with at least the first ``n`` rows, or everything.

    Ordinals depend on smaller keys only, so a prefix keeps them. A guess from the key range
    noted by the scan is widened until it holds enough rows; on files sorted by key its bound
    skips all later row groups.
    """
    span = docs.schema["block"].metadata
    if not span or span["rows"] <= n:
        return docs
    width = max(1, (span["high"] - span["low"] + 1) * n // span["rows"])
    while True:
        width *= 2
        prefix = docs.where(F.col("doc_id") < span["low"] + width)
        if span["low"] + width > span["high"]:
            return docs
        if prefix.count() >= n:
            return prefix
