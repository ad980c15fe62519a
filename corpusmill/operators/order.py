"""Global positions without a single-task window.

Rows are cut into blocks of neighbouring keys. Counts (or sums) per block form a small
table whose running total gives every block its base; inside a block an ordinary
partitioned window gives the rest. Blocks depend on the key alone, so a retried task
always rebuilds the same block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 100_000
MAX_BLOCKS = 1 << 18
DENSE_SPAN = 4
SAMPLE_PER_BLOCK = 20


def key_blocks(df: DataFrame, key: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column:
    """A block-id expression over the unique integer column ``key``.

    Dense keys are cut into equal key ranges, so a block holds at most
    ``DENSE_SPAN * rows_per_block`` rows. Sparse or clumped keys are cut at sampled
    quantiles. The sample only places the cuts; every row keeps its exact position. The key
    range is noted in the column's metadata. Rows without a key have no place and are refused.
    """
    rows = F.count(F.lit(1)).alias("rows")
    stats = df.agg(F.count(key).alias("n"), rows, F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if stats.n != stats.rows:
        raise ValueError(f"{stats.rows - stats.n} rows have no {key}")
    if not stats.n:
        return F.lit(0).cast("bigint")
    noted = {"low": stats.lo, "high": stats.hi, "rows": stats.n}
    return _block_of(df, key, rows_per_block, stats).alias("block", metadata=noted)


def _block_of(df: DataFrame, key: str, rows_per_block: int, stats: Row) -> Column:
    parallel = df.sparkSession.sparkContext.defaultParallelism
    blocks = min(MAX_BLOCKS, max(-(-stats.n // rows_per_block), min(4 * parallel, stats.n)))
    span = stats.hi - stats.lo + 1
    if span <= DENSE_SPAN * stats.n:
        width = -(-span // blocks)
        return F.expr(f"(`{key}` - {stats.lo}) div {width}")
    return _quantile_blocks(df, key, stats.n, blocks)


def _quantile_blocks(df: DataFrame, key: str, rows: int, blocks: int) -> Column:
    every = max(1, rows // (blocks * SAMPLE_PER_BLOCK))
    sample = df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key)
    # At most MAX_BLOCKS * SAMPLE_PER_BLOCK long integers reach this one window.
    position = F.row_number().over(Window.orderBy(key))
    cuts = (
        sample.withColumn("_at", position)
        .where(F.col("_at") % SAMPLE_PER_BLOCK == 0)
        .select(key)
        .distinct()
        .orderBy(key)
        .collect()
    )
    if not cuts:
        return F.lit(0).cast("bigint")
    # Constant folding turns the text into one literal array.
    bounds = F.split(F.lit(",".join(str(c[0]) for c in cuts)), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def descend(at: Column, step: Column) -> Column:
        beyond = (at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.col(key))
        return F.when(beyond, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), descend).cast("bigint")


def scan_blocks(df: DataFrame) -> DataFrame:
    """Blocks for keyless files: the file is the block, the row index its inner key."""
    meta = F.col("_metadata")
    return df.select(
        "*", meta.getField("file_path").alias("block"), meta.getField("row_index").alias("row_index")
    )


def running_base(table: DataFrame, value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Total of ``value`` over all earlier blocks, per ``group``; one row per block."""
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint")
    return table.select(*group, "block", base.alias(name))


def with_ordinal(
    df: DataFrame, keys: Sequence[str | Column], name: str = "ordinal", first: int = 0, unique: bool = False
) -> DataFrame:
    """Zero-based global position of each row by (block, keys).

    The one row per block is sent to the rows, which so move for the window alone, or not at
    all where the position is not used.

    With ``unique``, two rows of equal keys fail the job, as their order would be left to chance.
    """
    counts = df.groupBy("block").agg(F.count(F.lit(1)).alias("_rows"))
    base = running_base(counts, "_rows", "_base")
    inside = Window.partitionBy("block").orderBy(*keys)
    place = F.row_number().over(inside) - 1
    if unique:
        key = F.struct(*keys)
        message = F.concat(F.lit("two rows have the key "), F.to_json(key))
        place = F.when(F.lag(key).over(inside) == key, F.raise_error(message)).otherwise(place)
    inside = place
    return (
        df.withColumn("_inside", inside)
        .join(F.broadcast(base), "block")
        .withColumn(name, F.col("_base") + F.col("_inside") + F.lit(first))
        .drop("_base", "_inside")
    )


def inside_offset(value: str, order: str, group: Sequence[str] = ()) -> Column:
    """Sum of ``value`` over earlier rows of the same block and group."""
    window = Window.partitionBy("block", *group).orderBy(order)
    running = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return (running - F.col(value)).cast("bigint")


def previous_values(
    df: DataFrame, order: str, values: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Adds ``prev_<value>``: the value of the preceding row by ``order`` within ``group``.

    Inside a block this is a lag; a block's first row takes the last row of the nearest
    earlier block from a one-row-per-block table.
    """
    inner = Window.partitionBy(*group, "block").orderBy(order)
    row = F.struct(*values)
    last = df.groupBy(*group, "block").agg(F.max_by(row, order).alias("_last"))
    across = Window.partitionBy(*group).orderBy("block")
    carried = last.select(*group, "block", F.lag("_last").over(across).alias("_carried"))
    joined = df.withColumn("_lag", F.lag(row).over(inner)).join(carried, [*group, "block"])
    previous = F.coalesce("_lag", "_carried")
    return joined.select(
        *df.columns, *[previous.getField(v).alias(f"prev_{v}") for v in values]
    )


def hash_sample(df: DataFrame, hashed: Column, keys: Sequence[str], n: int) -> DataFrame:
    """Exactly the ``n`` rows with the smallest hash, or all rows if fewer exist."""
    bits = 60 - 16
    blocked = df.withColumn("_hash", hashed).withColumn("block", F.shiftright("_hash", bits))
    return with_ordinal(blocked, ["_hash", *keys], "_at").where(F.col("_at") < n).drop("_hash", "_at", "block")
