"""The byte-only tokenizer: every UTF-8 byte is one token, no vocabulary needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusmill.constants import FIRST_BYTE_ID
from corpusmill.functions.text import text_parts


@F.arrow_udf(ArrayType(IntegerType()))
def _shifted_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in text_parts(batches):
        plain = part.cast(pa.binary())
        ends = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1]
        data = plain.buffers()[2]
        body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
        ids = body.astype(np.int32) + np.int32(FIRST_BYTE_ID)
        yield pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(ids), mask=plain.is_null())


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes of ``text`` as token ids: the bytes of a batch are one buffer, shifted at once."""
    return _shifted_bytes(F.encode(text, "UTF-8"))


def byte_length(text: Column) -> Column:
    """``size(byte_ids(text))`` without building the ids."""
    return F.octet_length(text).cast("bigint")
