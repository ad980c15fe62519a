"""Hard negatives by best-first search in an R-tree packed by sort and tile.

Every vector becomes integers, floor(256 x). A row's score against an anchor is their inner
product; higher comes first, equal scores by smaller id. An anchor's positives are its first
rows of the same label; the negatives of a positive are the first rows of other labels with a
score from ``LEAST_PERCENT`` per cent of the positive's up to the positive's.

Packing. Rows are range-partitioned along the coordinate of the largest spread, ids breaking
ties. Every range is a stream cut into blocks; a block is sorted and tiled along the next two
coordinates of large spread into leaves, whose least and greatest value per coordinate are their
box, and leaves that follow each other share a node with the box of all. Blocks are one row each
of a written table, so a lost executor costs a reread.

Search. Rows of a tile, a bounded number of blocks, meet a bounded group of anchors in one cell.
A box bounds an anchor's score: per coordinate the product lies between those with the box's two
ends. A queue hands out boxes by upper bound; one is passed over if its interval misses the
score window or its upper bound lies strictly below the kth score found. The cells' first rows,
at most k each, are merged by window functions. Positives come first, as they set the windows.

Defined cases. Rows with a null id or label, a null vector, or a null or non-finite component
take no part. Shorter vectors are filled up with zeros. Anchors that share id, label and vector
are one; rows of the anchor's own id are not its positives or negatives; other repeated rows
each count. An empty table gives no rows. A score must fit 64 bits, otherwise the job fails.
Only the three named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize

SCALE = 256
LABELS = 10
SHIFT_EVERY, ANCHOR_EVERY = 7, 100
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT = 80

AXES = 3
LEAF_ROWS, NODE_LEAVES, BLOCK_ROWS = 64, 8, 4_096
TILE_BYTES = 32 << 20
TILE_ROWS = 32_768
ANCHORS_PER_GROUP = 8_192
ANCHORS_AT_ONCE = 256
EXACT = 1 << 53

BLOCK_DDL = "tile INT, dim INT, ids BINARY, labels BINARY, vectors BINARY, leaf_starts BINARY, low BINARY, high BINARY"
BLOCK = pa.schema([
    ("tile", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
    ("vectors", pa.binary()), ("leaf_starts", pa.binary()), ("low", pa.binary()), ("high", pa.binary()),
])
FOUND_DDL = "row BIGINT, limit BIGINT, id BIGINT, score BIGINT"
FOUND = pa.schema([("row", pa.int64()), ("limit", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
SUMS = pa.schema([("axis", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("squares", pa.float64())])
SUMS_DDL = "axis INT, n BIGINT, total DOUBLE, squares DOUBLE"


def usable(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, embedding) of the rows that take part, with shifted labels; ``row`` is unique."""
    shifted = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return embeddings.where(known).where(~bad).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
        shifted.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _integers(column: pa.Array) -> np.ndarray:
    """The vectors as integers, one row each, short ones filled up with zeros."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    values = np.floor(SCALE * np.asarray(column.flatten(), np.float64))
    if values.size and np.abs(values).max() >= 2.0**63:
        raise ValueError("a component is beyond 64 bits")
    width = int(lengths.max()) if lengths.size else 0
    if lengths.size and (lengths == width).all():
        return values.astype(np.int64).reshape(len(lengths), width)
    matrix = np.zeros((len(lengths), width), np.int64)
    matrix[np.arange(width) < lengths[:, None]] = values.astype(np.int64)
    return matrix


def _widen(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = 0
    total = squares = np.zeros(0)
    for batch in batches:
        matrix = _integers(batch.column("embedding")).astype(np.float64)
        width = max(len(total), matrix.shape[1])
        matrix = _widen(matrix, width)
        total = np.pad(total, (0, width - len(total))) + matrix.sum(0)
        squares = np.pad(squares, (0, width - len(squares))) + (matrix**2).sum(0)
        rows += len(matrix)
    if rows:
        columns = [np.arange(len(total), dtype=np.int32), np.full(len(total), rows), total, squares]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUMS)], schema=SUMS)


def spread(rows: DataFrame) -> list[int]:
    """All coordinates, the one of the largest variance first."""
    sums = rows.select("embedding").mapInArrow(_sums, SUMS_DDL).groupBy("axis").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")
    )
    variance = F.col("squares") / F.col("n") - (F.col("total") / F.col("n")) ** 2
    return [r.axis for r in sums.orderBy(variance.desc(), "axis").select("axis").collect()]


def _tiled(matrix: np.ndarray, axes: list[int]) -> np.ndarray:
    """The order of rows that packs leaves: slabs along the first axis, tiles along the next."""
    order = np.arange(len(matrix))
    leaves = -(-len(matrix) // LEAF_ROWS)
    slabs = max(1, round(leaves**0.5))
    if not axes:
        return order
    order = order[np.argsort(matrix[:, axes[0]], kind="stable")]
    if len(axes) == 1:
        return order
    per_slab = -(-leaves // slabs) * LEAF_ROWS
    cut = [order[at : at + per_slab] for at in range(0, len(order), per_slab)]
    return np.concatenate([slab[np.argsort(matrix[slab, axes[1]], kind="stable")] for slab in cut])


def _block(tile: int, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, axes: list[int]) -> pa.RecordBatch:
    order = _tiled(matrix, [a for a in axes if a < matrix.shape[1]])
    packed = matrix[order]
    starts = np.arange(0, len(order), LEAF_ROWS)
    low, high = np.minimum.reduceat(packed, starts), np.maximum.reduceat(packed, starts)
    parts = [ids[order], labels[order].astype(np.int32), packed, starts, low, high]
    columns = [[tile], [matrix.shape[1]], *([np.ascontiguousarray(p).tobytes()] for p in parts)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCK)], schema=BLOCK)


def _packer(axes: list[int]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = tile = 0
        for batch in batches:
            tile = batch.column("tile")[0].as_py()
            part = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label")), _integers(batch.column("embedding"))
            at = 0
            while at < len(part[0]):
                take = min(BLOCK_ROWS - count, len(part[0]) - at)
                held.append(tuple(p[at : at + take] for p in part))
                count, at = count + take, at + take
                if count == BLOCK_ROWS:
                    yield joined(tile, held)
                    held, count = [], 0
        if held:
            yield joined(tile, held)

    def joined(tile: int, held: list[tuple]) -> pa.RecordBatch:
        width = max(m.shape[1] for _, _, m in held)
        ids, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        return _block(tile, ids, labels, np.concatenate([_widen(m, width) for _, _, m in held]), axes)

    return pack


def pack(rows: DataFrame, axes: list[int], tiles: int) -> DataFrame:
    """The tree: one row per block of neighbouring vectors."""
    along = F.coalesce(F.get("embedding", F.lit(axes[0] if axes else 0)), F.lit(0.0)).alias("along")
    ranges = rows.withColumn("along", along).repartitionByRange(tiles, "along", "vec_id", "row")
    ordered = ranges.sortWithinPartitions("along", "vec_id").withColumn("tile", F.spark_partition_id())
    return materialize(ordered.select("tile", "vec_id", "label", "embedding").mapInArrow(_packer(axes[1:AXES]), BLOCK_DDL), "tree")


def _shaped(stored: bytes, rows: int, dim: int, width: int) -> np.ndarray:
    return _widen(np.frombuffer(stored, np.int64).reshape(rows, dim), width)


class Tree:
    """The blocks of one cell: leaves, and nodes of ``NODE_LEAVES`` leaves, each with its box."""

    def __init__(self, blocks: pa.Table, width: int):
        self.ids, self.labels, self.vectors, self.starts = [], [], [], [0]
        lows, highs = [], []
        self.children: list[range] = []
        for dim, ids, labels, vectors, starts, low, high in zip(*(blocks.column(n).to_pylist() for n in BLOCK.names[1:])):
            own_starts = np.frombuffer(starts, np.int64)
            self.ids.append(np.frombuffer(ids, np.int64))
            self.labels.append(np.frombuffer(labels, np.int32))
            self.vectors.append(_shaped(vectors, len(self.ids[-1]), dim, width))
            first, base = len(self.starts) - 1, self.starts[-1]
            self.starts += [base + int(s) for s in own_starts[1:]] + [base + len(self.ids[-1])]
            leaves = len(own_starts)
            lows.append(_shaped(low, leaves, dim, width))
            highs.append(_shaped(high, leaves, dim, width))
            self.children += [range(first + at, first + min(at + NODE_LEAVES, leaves)) for at in range(0, leaves, NODE_LEAVES)]
        self.ids, self.labels, self.vectors = map(np.concatenate, (self.ids, self.labels, self.vectors))
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        starts = [c.start for c in self.children]
        self.node_low, self.node_high = np.minimum.reduceat(self.low, starts), np.maximum.reduceat(self.high, starts)

    def exact_in_doubles(self, anchors: np.ndarray) -> bool:
        def top(matrix: np.ndarray) -> int:
            return max(abs(int(matrix.max(initial=0))), abs(int(matrix.min(initial=0))))

        return top(self.vectors) * top(anchors) * max(1, anchors.shape[1]) < EXACT

    def as_numbers(self, kind: type) -> None:
        for name in ("vectors", "low", "high", "node_low", "node_high"):
            setattr(self, name, getattr(self, name).astype(kind))


def _intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list, list]:
    """Least and greatest possible inner product of every anchor with every box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return (up @ low.T + down @ high.T).tolist(), (up @ high.T + down @ low.T).tolist()


class Wanted:
    """The first ``k`` rows of one score window, by score and then id."""

    def __init__(self, least: int | None, most: int | None, k: int):
        self.least, self.most, self.k = least, most, k
        self.rows: list[tuple[int, int]] = []

    def floor(self) -> float:
        """A score below this has no place any more."""
        least = float("-inf") if self.least is None else self.least
        return max(least, -self.rows[-1][0]) if len(self.rows) == self.k else least

    def may_hold(self, low: float, high: float) -> bool:
        return high >= self.floor() and (self.most is None or low <= self.most)

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        fits = allowed & (scores >= self.floor())
        if self.most is not None:
            fits &= scores <= self.most
        at = np.flatnonzero(fits)
        if len(at):
            new = [(-int(s), int(i)) for s, i in zip(scores[at], ids[at])]
            self.rows = sorted(self.rows + new)[: self.k]


def _search(tree: Tree, anchor: np.ndarray, same: bool, label: int, own: int, bounds: tuple, windows: list[Wanted]) -> None:
    """Best-first: the box of the greatest upper bound is opened next."""
    node_low, node_high, leaf_low, leaf_high = bounds
    queue = [(-high, 0, at) for at, high in enumerate(node_high)]
    heapq.heapify(queue)
    while queue:
        bound, leaf, at = heapq.heappop(queue)
        if -bound < min(w.floor() for w in windows):
            return
        low = leaf_low[at] if leaf else node_low[at]
        if not any(w.may_hold(low, -bound) for w in windows):
            continue
        if not leaf:
            for child in tree.children[at]:
                heapq.heappush(queue, (-leaf_high[child], 1, child))
            continue
        rows = slice(tree.starts[at], tree.starts[at + 1])
        scores = tree.vectors[rows] @ anchor
        if scores.max() < min(w.floor() for w in windows):
            continue
        ids = tree.ids[rows]
        allowed = ((tree.labels[rows] == label) if same else (tree.labels[rows] != label)) & (ids != own)
        for window in windows:
            window.add(scores, ids, allowed)


def _cell(anchors: pa.Table, blocks: pa.Table, k: int, least_percent: int | None) -> pa.Table:
    """First rows of one tile for one group of anchors: same label, or others within score windows."""
    if not anchors.num_rows or not blocks.num_rows:
        return FOUND.empty_table()
    matrix = _integers(anchors.column("embedding").combine_chunks())
    width = max(matrix.shape[1], max(blocks.column("dim").to_pylist()))
    matrix, tree = _widen(matrix, width), Tree(blocks, width)
    kind = np.float64 if tree.exact_in_doubles(matrix) else object
    tree.as_numbers(kind)
    matrix = matrix.astype(kind)
    rows, ids, labels = (anchors.column(n).to_pylist() for n in ("row", "vec_id", "label"))
    limits = anchors.column("limits").to_pylist() if least_percent is not None else [[None]] * len(rows)
    found: list[tuple] = []
    for start in range(0, len(rows), ANCHORS_AT_ONCE):
        part = matrix[start : start + ANCHORS_AT_ONCE]
        node, leaf = _intervals(part, tree.node_low, tree.node_high), _intervals(part, tree.low, tree.high)
        for i, anchor in enumerate(part):
            at = start + i
            if least_percent is None:
                windows = [Wanted(None, None, k)]
            else:
                windows = [Wanted(-(-least_percent * s // 100), s, k) for s in limits[at] if s >= 0]
            if windows:
                _search(tree, anchor, least_percent is None, labels[at], ids[at], (node[0][i], node[1][i], leaf[0][i], leaf[1][i]), windows)
            for window in windows:
                found += [(rows[at], window.most, id, -score) for score, id in window.rows]
    if not found:
        return FOUND.empty_table()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), FOUND)], schema=FOUND)


def first_rows(anchors: DataFrame, tree: DataFrame, tiles: int, groups: int, k: int, least_percent: int | None = None) -> DataFrame:
    """(row, limit, id, score): per anchor and score limit its first ``k`` rows of the whole tree.

    ``anchors`` has row, vec_id, label, embedding and, with ``least_percent``, ``limits``: the
    greatest scores of its windows.
    """
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("anchors")
    all_tiles, all_groups = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (tiles, groups))
    cells = tiles * groups
    left = anchors.select("*", group).select("*", all_tiles.alias("tile")).repartition(cells, "tile", "anchors")
    right = tree.select("*", all_groups.alias("anchors")).repartition(cells, "tile", "anchors")

    def meet(some: pa.Table, blocks: pa.Table) -> pa.Table:
        return _cell(some, blocks, k, least_percent)

    found = left.groupBy("tile", "anchors").cogroup(right.groupBy("tile", "anchors")).applyInArrow(meet, FOUND_DDL)
    best = Window.partitionBy("row", "limit").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, k_positive: int = POSITIVES, k_negative: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = materialize(usable(embeddings), "vectors")
    axes = spread(rows)
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    tile_rows = max(1, min(TILE_ROWS, TILE_BYTES // (8 * max(1, len(axes)))))
    tiles = max(2 * parallel, -(-rows.count() // tile_rows))
    tree = pack(rows, axes, tiles)
    # The session may have made more ranges than asked for; no tile may be missed.
    tiles = 1 + (tree.agg(F.max("tile").alias("last")).first().last or 0)
    one_each = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).groupBy("vec_id", "label", "embedding").agg(F.min("row").alias("row"))
    anchors = materialize(one_each, "anchors")
    groups = max(1, -(-anchors.count() // ANCHORS_PER_GROUP))

    best = first_rows(anchors, tree, tiles, groups, k_positive)
    positives = materialize(best.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    limits = positives.groupBy("row").agg(F.collect_set("positive_score").alias("limits"))
    asking = materialize(anchors.join(limits, "row"), "windows")
    chosen = first_rows(asking, tree, tiles, groups, k_negative, least_percent)
    negatives = chosen.select("row", F.col("limit").alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    named = positives.drop("rank").join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.join(negatives, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
