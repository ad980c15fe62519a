"""Seeded hashes that any SQL engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(*parts: Column) -> Column:
    """A uniform integer in [0, 2^60) from the '-'-joined parts."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def seeded_uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1."""
    return (seeded_hash(*parts) + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))
