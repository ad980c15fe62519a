"""Vocabulary tables: id, piece, score, kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import FIRST_BYTE_ID, FIRST_MERGE_ID, MAX_TOKEN_ID, SPECIAL_PIECES
from corpusmill.sources.shards import open_path

VOCAB_SCHEMA = "id INT, piece STRING, score DOUBLE, kind STRING"


def byte_piece(value: int) -> str:
    return f"<0x{value:02X}>"


def layout(spark: SparkSession, merges: list[str], alphabet: list[str]) -> DataFrame:
    """The full id space: specials, bytes, merges in learned order, then the alphabet."""
    rows = [(i, piece, 0.0, "special") for piece, i in SPECIAL_PIECES.items()]
    rows += [(FIRST_BYTE_ID + b, byte_piece(b), 0.0, "byte") for b in range(256)]
    learned = [(piece, "merge") for piece in merges] + [(piece, "char") for piece in alphabet]
    rows += [(FIRST_MERGE_ID + i, piece, float(-i), kind) for i, (piece, kind) in enumerate(learned)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def save(vocab: DataFrame, path: str) -> None:
    vocab.coalesce(1).write.mode("overwrite").parquet(path)


def exists(path: str) -> bool:
    filesystem, inner = open_path(path)
    return filesystem.get_file_info(f"{inner}/_SUCCESS").type == pafs.FileType.File


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved vocabulary whose special ids were checked."""
    if not exists(path):
        raise FileNotFoundError(f"Vocabulary not found: {path}")
    vocab = spark.read.schema(VOCAB_SCHEMA).parquet(path)
    check_specials(vocab)
    return vocab


def check_specials(vocab: DataFrame) -> None:
    """Shards would carry wrong separators if these ids differed."""
    rows = vocab.where(F.col("kind") == "special").limit(len(SPECIAL_PIECES) + 1).collect()
    actual = {r.piece: r.id for r in rows}
    if actual != SPECIAL_PIECES:
        raise ValueError(f"Vocabulary special ids {actual} do not match the expected {SPECIAL_PIECES}")


def size(vocab: DataFrame) -> int:
    return vocab.count()


def lookup(ids: DataFrame, vocab: DataFrame, column: str = "id") -> DataFrame:
    """Adds the piece of each id; a vocabulary has at most 65,536 rows."""
    pieces = vocab.select(F.col("id").alias(column), "piece")
    return ids.join(F.broadcast(pieces), column, "left")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary small enough to travel inside expressions."""

    pieces: tuple[str, ...]
    kinds: tuple[str, ...]

    @classmethod
    def of(cls, vocab: DataFrame) -> Pieces:
        rows = sorted(vocab.limit(MAX_TOKEN_ID + 2).collect(), key=lambda r: r.id)
        if [r.id for r in rows] != list(range(len(rows))) or len(rows) > MAX_TOKEN_ID + 1:
            raise ValueError("a vocabulary needs ids 0..n-1 with n at most 65,536")
        return cls(tuple(r.piece for r in rows), tuple(r.kind for r in rows))

    def __len__(self) -> int:
        return len(self.pieces)
