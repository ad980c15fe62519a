"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint of 64 bits is cut into segments and mapped to the vector of bits set in each.
The Manhattan distance of two such vectors is never above the Hamming distance of the
fingerprints, so it is a lower bound: pairs whose vectors are further apart than ``DISTANCE``
need not be compared. Vectors are points of an integer grid. They are split into two halves;
as three differing bits leave one half with at most one, each pair within reach has a half
whose points are equal or differ by one in a single segment. Every fingerprint is stored at
its point of each half and looks up that point and those one step above it (a step below is
found from the other side), which is an equality join on grid points. What meets there is
verified: the rest of the bound, then the exact distance.

Equal fingerprints are one row from the start, so copies never meet each other. A grid point
with very many distinct fingerprints, such as that of a large group of near copies, is cut
into tiles of bounded size by a hash, and every two tiles meet in a task of their own. A task
returns a spanning forest of its links, not the pairs. Components follow by repeated label
exchange along links, with tables written between rounds; tasks shorten the paths they hold first,
so rounds are few where paths are short. By hint only bounded tables go through the driver, and in
``keep_one`` one row per group of more than one tile, a row for ``TILE`` or ``SET_TILE`` of theirs at most.

Defined results: null, empty and blank texts have fingerprint zero and link like others.
Repeated rows share a component. A null id never names a component, unless it has no other.
An empty table gives an empty result. Other columns are ignored.

The pipeline's ``keep_one`` takes fingerprints of five-word shingles through the same grid join, and
links what has a similarity (intersection over union of the shingle sets) of 0.8 or more. Three bits
miss most such pairs, so sets that share a rare shingle are candidates too, see ``similar_rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import slices
from corpusmill.llm.words import batch_rows, lower_words
from corpusmill.session import materialize

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENT_BITS = 2
HALVES = 2
TILE = 2_048
PRINTS = "doc_id BIGINT, fingerprint BIGINT"
LINKS = "a BIGINT, b BIGINT"
# For ``keep_one``: longer shingles and the exact similarity of whole sets, of which fewer share a tile.
NEAR_SHINGLE = 5
SET_TILE = 256
SIGNS = [f"s{i}" for i in range(8)]
SHARED = ["shingle", "sid", "at"]
# Runs up to this many rows list all their pairs, longer ones a spanning forest.
FEW = 16
RANGE_BITS, OFTEN, OFTEN_IN_TASK = 22, 4, 2
# Rows of 64 bits that tell all workers which sets may be asked for, to fetch those where they lie.
ASKED_BITS = 17
# A task shortens the paths of this many links at a time.
HELD_LINKS = 1 << 20
# Whole sets pass between Spark and its workers and into files in parts of these sizes.
ROWS_PER_BATCH = 1_000
ROW_GROUP = {"parquet.block.size": 16 << 20}


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The majority bit of the hashes of all shingles, as a signed 64-bit number."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return _signed(digest(b" ".join(words), seed))
    joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return majority(np.fromiter((digest(s, seed) for s in joined), np.uint64, len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return _signed(int.from_bytes(bits.tobytes(), "big"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(lower_words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, PRINTS)


def embedded(prints: np.ndarray, half: int) -> np.ndarray:
    """Bits set in each segment of one half of the fingerprints: a row per fingerprint."""
    width = 64 // HALVES
    count = width // SEGMENT_BITS
    shifts = np.arange(count, dtype=np.uint64) * np.uint64(SEGMENT_BITS) + np.uint64(half * width)
    segments = (prints[:, None] >> shifts) & np.uint64((1 << SEGMENT_BITS) - 1)
    return np.bitwise_count(segments).astype(np.int64)


def grid_keys(points: np.ndarray, half: int) -> np.ndarray:
    """One number per grid point: digits in base segment bits + 1, and the half."""
    digits = (SEGMENT_BITS + 1) ** np.arange(points.shape[1], dtype=np.int64)
    return (points @ digits) * HALVES + half


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4_096):
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        prints = signed.view(np.uint64)
        keys, owners, roles = [], [], []
        for half in range(HALVES):
            points = embedded(prints, half)
            own = grid_keys(points, half)
            keys.append(own)
            owners.append(signed)
            roles.append(np.zeros(len(own), np.int8))
            steps = (SEGMENT_BITS + 1) ** np.arange(points.shape[1], dtype=np.int64) * HALVES
            rows, segments = np.nonzero(points < SEGMENT_BITS)
            keys.append(own[rows] + steps[segments])
            owners.append(signed[rows])
            roles.append(np.ones(len(rows), np.int8))
        columns = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(roles))]
        yield pa.RecordBatch.from_arrays(columns, ["point", "fingerprint", "visitor"])


_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of the embedded points, for two-bit segments: counts stay packed in two bits."""
    gap = (a - ((a >> _ONE) & _LOW)) ^ (b - ((b >> _ONE) & _LOW))
    # Counts 0, 1 and 2 differ by one where the low bit differs, by two where only the high bit does.
    return np.bitwise_count(gap & _LOW) + 2 * np.bitwise_count((gap >> _ONE) & ~gap & _LOW)


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs are linked: the lower bound first, then the exact distance."""
    near = manhattan(a, b) <= DISTANCE
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= DISTANCE
    return near


def spanning(count: int, near: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``count`` places; with ``side``, of those between the sides.

    ``near`` tells which of several places are linked to one.
    """
    waiting = np.arange(count)
    links, front = [], []
    while len(waiting) or front:
        if not front:
            front, waiting = [waiting[0]], waiting[1:]
        at = front.pop()
        if not len(waiting):
            continue
        others = waiting if side is None else waiting[side[waiting] != side[at]]
        met = others[near(at, others)]
        if len(met):
            links += [(int(at), int(m)) for m in met]
            front += met.tolist()
            waiting = np.setdiff1d(waiting, met, assume_unique=True)
    return links


def forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sets of fingerprints (or within one, if they are the same)."""
    same = left is right
    points = left if same else np.concatenate([left, right])
    side = None if same else np.arange(len(points)) >= len(left)
    found = spanning(len(points), lambda at, others: within(np.full(len(others), points[at]), points[others]), side)
    return [(int(points[a]), int(points[b])) for a, b in found]


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints whose closure is that of all links."""
    grid = prints.select("fingerprint").distinct().mapInArrow(_grid, "point BIGINT, fingerprint BIGINT, visitor TINYINT")
    grid = materialize(grid, "grid")
    sizes = grid.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("visitor").alias("least")).where("n > 1 and least = 0")
    met = grid.join(sizes.select("point", "n"), "point")
    tiles = F.expr(f"cast(ceil(n / {tile}) as int)")
    own = F.pmod(F.xxhash64("fingerprint"), tiles).cast("int")
    # Tile i meets every tile j: a row goes to its pairs (i, j), ordered.
    pairs = met.select("point", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    pairs = pairs.select("point", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fingerprint")

    dealt = pairs.repartition("point", "i", "j").sortWithinPartitions("point", "i", "j", "own")
    return dealt.mapInArrow(_meet, LINKS).distinct()


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int = 3) -> Iterator[tuple]:
    """(columns, starts, ends) of the runs of rows that agree in the first ``keys`` columns; none is cut."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        # The last run may go on in the next batch.
        held = [c[starts[-1] :] for c in columns]
        yield columns, starts[:-1], starts[1:]
    if held is not None:
        yield held, np.array([0]), np.array([len(held[0])])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal (point, i, j); a run holds two tiles at most."""
    for columns, starts, ends in whole_runs(batches, ["point", "i", "j", "own", "fingerprint"]):
        yield _runs(columns, starts, ends)


def _runs(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    _, i, j, own, signed = columns
    prints = signed.view(np.uint64)
    sizes = ends - starts
    # Most runs are two fingerprints of one tile: all of those at once.
    two = starts[(sizes == 2) & (i[starts] == j[starts])] if len(starts) else starts
    near = within(prints[two], prints[two + 1]) & (prints[two] != prints[two + 1])
    found = [np.stack([prints[two[near]], prints[two[near] + 1]], axis=1)]
    for start, end in zip(starts, ends, strict=True):
        if end - start < 2 or end - start == 2 and i[start] == j[start]:
            continue
        run, side = prints[start:end], own[start:end]
        if i[start] == j[start]:
            whole = np.unique(run)
            links_ = forest(whole, whole)
        else:
            links_ = forest(np.unique(run[side == i[start]]), np.unique(run[side == j[start]]))
        found.append(np.array(links_, np.uint64).reshape(-1, 2))
    both = np.concatenate(found).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def stars(links_: np.ndarray) -> np.ndarray:
    """Each node of the links (two columns) that can reach a lesser one, and the least it can reach."""
    nodes, at = np.unique(links_, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        one, two = label[at[:, 0]], label[at[:, 1]]
        if (one == two).all():
            break
        low = np.minimum(one, two)
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[label[moved]]], axis=1)


def _shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``stars`` of the links of a task, of a bounded number at a time."""
    held, size = [np.empty((0, 2), np.int64)], 0

    def out(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(2)], ["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1))
        size += batch.num_rows
        if size > HELD_LINKS:
            held = [stars(np.concatenate(held))]
            size = len(held[0])
            if 2 * size > HELD_LINKS:
                yield out(held.pop())
                size = 0
    if held:
        yield out(stars(np.concatenate(held)))


def _all_stars(links_: DataFrame) -> bool:
    """Whether every node that points to another points to one only, and none points to it."""
    ends = links_.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("points")), F.struct(F.col("v").alias("node"), F.lit(0).alias("points")))).alias("end"))
    ends = ends.groupBy("end.node").agg(F.sum("end.points").alias("points"), F.count(F.lit(1)).alias("n"))
    return ends.where("points > 0 and n > 1").count() == 0


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b) but the roots; a root is its component's least node.

    Large-star and small-star rounds: each points a node at the least neighbour known, until
    all components are stars. Least neighbours are aggregated before they are joined, and a star
    is written before the next one reads it, so no plan holds a round's joins more than once.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    current = materialize(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), label)
    # Few links need few tasks, in which most paths end.
    current = current.coalesce(1 + current.count() // HELD_LINKS)
    current = materialize(current.mapInArrow(_shorter, "u BIGINT, v BIGINT").distinct(), label)
    while not _all_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        current = materialize(small.mapInArrow(_shorter, "u BIGINT, v BIGINT"), label)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is named by its least id."""
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(materialize(links(prints), "links"))
    rooted = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # One row per distinct fingerprint: copies were folded before any join.
    lookup = rooted.join(named, "root").select("fingerprint", "component_id")
    return prints.join(lookup, "fingerprint").select("doc_id", "fingerprint", "component_id")


def shingle_set(words: list[bytes], shingle: int = NEAR_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of all shingles, sorted; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return np.unique(np.fromiter((digest(s, seed) for s in joined), np.uint64, len(words) - shingle + 1))


def parity(found: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of shingles falls on each: two sets differ by no fewer shingles than bits."""
    size = max(64 * len(SIGNS), 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity bits over fewer places: a place's number is taken modulo their number."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, sid, n, fingerprint, parity bits, shingles) of every row; equal sets have equal ``sid``.

    ``mark`` is a hash of the text as it is, which tells rows of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(lower_words(t)) for t in batch.column(1).to_pylist()]
            whole = [f.tobytes() for f in found]
            bits = [parity(f) for f in found]
            signs = np.array([folded(b, 8 * len(SIGNS)).view(np.int64) for b in bits], np.int64).reshape(-1, len(SIGNS))
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array([_signed(xxhash.xxh64_intdigest(w, SEED)) for w in whole], pa.int64()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([majority(f) for f in found], pa.int64()),
                *[pa.array(np.ascontiguousarray(signs[:, i])) for i in range(len(SIGNS))],
                pa.array([b.tobytes() for b in bits], pa.binary()),
                pa.array(whole, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "sid", "n", "fingerprint", *SIGNS, "bits", "shingles"])

    schema = f"doc_id BIGINT, mark BIGINT, sid BIGINT, n BIGINT, fingerprint BIGINT, {', '.join(f'{s} BIGINT' for s in SIGNS)}, bits BINARY, shingles BINARY"
    return docs.select(F.col(key).cast("bigint"), F.col(text).cast("string"), F.xxhash64(text)).mapInArrow(run, schema)


def _frequency_steps(sets: DataFrame) -> np.ndarray:
    """A step per range of shingle hashes, above zero where a range is met far more often than others.

    A task names only the ranges that stand out in it. A range missed so changes the order of shingles,
    never the result, which holds for any order that all sets share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(1 << RANGE_BITS, np.int32), 0
        for batch in slices(batches, ROWS_PER_BATCH):
            for whole in batch.column(0).to_pylist():
                # Hashes of one set rarely share a range; a repeated one may count once.
                found = np.frombuffer(whole, np.uint64)
                counts[found >> np.uint64(64 - RANGE_BITS)] += 1
                total += len(found)
        at = np.flatnonzero(counts > OFTEN * (total / (1 << RANGE_BITS)) + OFTEN_IN_TASK)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at].astype(np.int64))], ["at", "n"])

    counts = sets.select("shingles").mapInArrow(run, "at BIGINT, n BIGINT").groupBy("at").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "shingle-ranges")
    mean = float(sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n) / (1 << RANGE_BITS)
    steps = np.zeros(1 << RANGE_BITS, np.int8)
    # At most one range in OFTEN can be this far above the mean.
    often = counts.where(F.col("n") > F.lit(OFTEN * mean)).select("at", "n").toArrow()
    steps[often["at"].to_numpy()] = 1 + np.log2(often["n"].to_numpy()).astype(np.int8)
    return steps


def _prefixes(sets: DataFrame) -> DataFrame:
    """(sid, first): the first shingles of each set in one order for all, rare ones first; a task names a set once.

    Sets of similarity 0.8 share four fifths of either, so at least one of the first fifth (and one).
    """
    steps = _frequency_steps(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, ROWS_PER_BATCH):
            firsts, sids = [], []
            for sid, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sid in seen:
                    continue
                seen.add(sid)
                sids.append(sid)
                found = np.frombuffer(whole, np.uint64)
                order = np.argsort(steps[found >> np.uint64(64 - RANGE_BITS)], kind="stable")
                firsts.append(found[order][: len(found) - (4 * len(found) + 4) // 5 + 1].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.int64), *firsts]))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["sid", "first"])

    return sets.select("sid", "shingles").mapInArrow(run, "sid BIGINT, first ARRAY<BIGINT>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and set those whose shingle has more sets."""
    held = None
    for batch in batches:
        shingle, sid, at = (batch.column(n).to_numpy(zero_copy_only=False) for n in SHARED)
        if not len(shingle):
            continue
        if held is not None:
            shingle, sid, at = np.append(held[0], shingle), np.append(held[1], sid), np.append(held[2], at)
        once = np.append(True, (shingle[1:] != shingle[:-1]) | (sid[1:] != sid[:-1]))
        shingle, sid, at = shingle[once], sid[once], at[once]
        goes_on = np.append(False, shingle[1:] == shingle[:-1])
        if held is not None:
            goes_on[0] = held[3]
        shared = goes_on | np.append(shingle[1:] == shingle[:-1], False)
        held = (shingle[-1], sid[-1], at[-1], bool(goes_on[-1]))
        shared[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in (shingle, sid, at)], SHARED)
    if held is not None and held[3]:
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in held[:3]], SHARED)


def _tiled(rows: DataFrame, group: str, tile: int) -> DataFrame:
    """Rows (group, sid, ...) once for every two tiles (i, j) that theirs, ``own``, is one of; most groups are one tile."""
    large = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile)
    # A group in this table has over ``tile`` rows.
    sized = rows.join(F.broadcast(large), group, "left").withColumn("tiles", F.expr(f"cast(ceil(coalesce(size, 1) / {tile}) as int)"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    pairs = sized.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return pairs.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("size", "tiles", "other")


def _dealt(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of two tiles of a group, the first of the names, side by side."""
    return rows.select(*names).repartition(*names[:3]).sortWithinPartitions(*names[:4])


def _edges(sid: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
    places = np.concatenate([np.empty((0, 2), np.int64), *found]).astype(np.int64)
    ends = np.unique(np.sort(sid[places], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


MEETING = ["shingle", "i", "j", "own", "sid", "n", "rest", *SIGNS]


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between sets at one shingle whose sizes, places of the shingle and parity bits allow a similarity of 0.8.

    Such sets differ by a ninth of their sizes at most; at their first common shingle, no more than
    what follows it can be common, and four ninths of both sizes must be.
    """
    for columns, starts, ends in whole_runs(batches, MEETING):
        _, i, j, own, sid, n, rest, *signs = columns
        signs = np.stack(signs, axis=1).view(np.uint64)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = n[a] + n[b]
            found = (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])) & (9 * np.minimum(rest[a], rest[b]) >= 4 * total)
            at = np.flatnonzero(found)
            one, two = (signs[np.broadcast_to(x, found.shape)[at]] for x in (a, b))
            found[at] = 9 * np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= total[at]
            return found

        sizes, found = ends - starts, []
        few = sizes <= FEW
        rows = np.flatnonzero(np.repeat(few, sizes)) + (starts[0] if len(starts) else 0)
        last = np.repeat(ends[few], sizes[few])
        for gap in range(1, FEW):
            here = rows + gap < last
            rows, last = rows[here], last[here]
            pairs = rows[(i[rows] == j[rows]) | (own[rows] != own[rows + gap])]
            pairs = pairs[near(pairs, pairs + gap)]
            found.append(np.stack([pairs, pairs + gap], axis=1))
        for a, b in zip(starts[~few], ends[~few], strict=True):
            links_ = spanning(b - a, lambda at, others, a=a: near(a + at, a + others), None if i[a] == j[a] else own[a:b])
            found.append(a + np.array(links_, np.int64).reshape(-1, 2))
        yield _edges(sid, found)


def _by_bits(n: np.ndarray, bits: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """The test of sizes and parity bits by all bits, whose number grows with the set."""
    sizes, tables = np.array([len(b) for b in bits]), {}
    for size in np.unique(sizes):
        tables[size] = np.zeros((len(bits), size), np.uint8)
        for at in np.flatnonzero(sizes >= size):
            tables[size][at] = folded(np.frombuffer(bits[at], np.uint8), size)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        total = n[at] + n[others]
        found = 5 * np.minimum(n[at], n[others]) >= 4 * np.maximum(n[at], n[others])
        least = np.minimum(sizes[at], sizes[others])
        for size in np.unique(least[found]):
            here = np.flatnonzero(found & (least == size))
            apart = np.bitwise_count(tables[size][others[here]] ^ tables[size][at]).sum(axis=1, dtype=np.int64)
            found[here] = 9 * apart <= total[here]
        return found

    return near


def _by_sets(whole: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """The similarity itself, where the bits allow it."""
    n = np.array([len(w) for w in whole])
    allowed = _by_bits(n, [parity(w).tobytes() for w in whole])

    def near(at: int, others: np.ndarray) -> np.ndarray:
        found = allowed(at, others)
        for k in np.flatnonzero(found):
            both = len(np.intersect1d(whole[at], whole[others[k]], assume_unique=True))
            found[k] = 9 * both >= 4 * (n[at] + n[others[k]])
        return found

    return near


IN_CLUSTER = ["cluster", "i", "j", "own", "sid", "n"]


def _linked(data: str) -> Callable:
    """Links within clusters, by the ``bits`` or the ``shingles`` of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts, ends in whole_runs(batches, [*IN_CLUSTER, data]):
            _, i, j, own, sid, n, held = columns
            found = []
            for a, b in zip(starts, ends, strict=True):
                near = _by_bits(n[a:b], held[a:b]) if data == "bits" else _by_sets([np.frombuffer(w, np.uint64) for w in held[a:b]])
                links_ = spanning(b - a, near, None if i[a] == j[a] else own[a:b])
                found.append(a + np.array(links_, np.int64).reshape(-1, 2))
            yield _edges(sid, found)

    return run


def _clusters(edges: DataFrame, label: str) -> DataFrame:
    """(sid, cluster) of every set that ``edges`` link to another."""
    roots = materialize(components(edges, label), f"{label}-roots")
    named = roots.select(F.col("node").alias("sid"), F.col("root").alias("cluster"))
    return named.unionByName(roots.select(F.col("root").alias("sid"), F.col("root").alias("cluster")).distinct())


def _printed(facts: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or linked by the grid join, a representative of each for the second."""
    least = facts.groupBy("fingerprint").agg(F.min("sid").alias("least"))
    equal = facts.join(least, "fingerprint").where("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    met = links(facts.select("fingerprint"))
    one, two = (least.select(F.col("fingerprint").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    linked = met.join(one, "a").join(two, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return equal.unionByName(linked)


def _meeting(sets: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b): links between sets that share one of the first shingles of both."""
    rows = _prefixes(sets).select(F.posexplode("first").alias("at", "shingle"), "sid").withColumn("at", F.col("at").cast("bigint"))
    dealt = rows.repartition("shingle").sortWithinPartitions("shingle", "sid").select(*SHARED)
    met = materialize(dealt.mapInArrow(_shared, ", ".join(f"{c} BIGINT" for c in SHARED)), "shared-shingles")
    told = _tiled(met, "shingle", TILE).join(facts.select("sid", "n", *SIGNS), "sid").withColumn("rest", F.expr("n - at"))
    return _dealt(told, MEETING).mapInArrow(_allowed, LINKS)


def _asked(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, n, shingles) once for each set in ``members``.

    Sets are many times wider than their numbers, so few others may move: bits by set number, in a
    table of bounded size, are sent to the workers, and what they let pass is joined by the number itself.
    """
    at, bit = F.expr(f"shiftrightunsigned(sid, {64 - ASKED_BITS})"), F.expr("shiftleft(1L, cast(sid & 63 as int))")
    bits = members.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits"))
    may = sets.select("sid", "n", "shingles").join(F.broadcast(bits), at == bits["at"]).where(F.col("bits").bitwiseAND(bit) != 0)
    # Copies are folded in the tasks that read them, before any row moves.
    return may.select("sid", "n", "shingles").dropDuplicates(["sid"]).join(members.select("sid"), "sid", "left_semi")


def similar_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, sid, root) of every row: components of all pairs with five-word shingle sets of similarity 0.8 or more.

    Candidates are what the grid join of the fingerprints links, and sets that share one of their first
    shingles, so no pair is missed. Their closure makes clusters, in which sets are compared in tiles:
    by all parity bits first, which makes smaller clusters, then whole. A task returns a spanning
    forest of its links, so a large group of near copies is never listed as pairs.
    """
    with batch_rows(docs.sparkSession, ROWS_PER_BATCH):
        sets = materialize(shingle_sets(docs, key, text), "shingles", **ROW_GROUP)
        facts = materialize(sets.select("sid", "n", "fingerprint", *SIGNS, "bits").dropDuplicates(["sid"]), "shingle-facts")
        # Written one after the other: one plan for both would keep all its stages in the driver at once.
        candidates = materialize(_printed(facts), "candidates").unionByName(materialize(_meeting(sets, facts).distinct(), "candidates"))
        wide = _tiled(_clusters(candidates, "clusters"), "cluster", TILE).join(facts.select("sid", "n", "bits"), "sid")
        agreed = materialize(_dealt(wide, [*IN_CLUSTER, "bits"]).mapInArrow(_linked("bits"), LINKS), "agreed")
        members = materialize(_clusters(agreed, "compared"), "members")
        whole = materialize(_asked(sets, members), "compared-sets", **ROW_GROUP)
        narrow = _tiled(members, "cluster", SET_TILE).join(whole, "sid")
        found = materialize(_dealt(narrow, [*IN_CLUSTER, "shingles"]).mapInArrow(_linked("shingles"), LINKS), "similar-links")
        roots = components(found, "similar").withColumnRenamed("node", "sid")
    return sets.select("doc_id", "mark", "sid").join(roots, "sid", "left").select("doc_id", "mark", "sid", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``similar_rows``: the one of the least id, with its columns unchanged.

    Rows without an id are all kept. Rows are told apart by id and text, so different texts that
    share an id are judged each for itself; of rows that share both one stays.
    """
    rows = materialize(similar_rows(docs, key, text).where("doc_id is not null"), "similar-rows")
    stays = rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("first.*")
    # The input's columns travel in one struct, so none can clash with a working column.
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{key}`"].cast("bigint").alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("mark"))
    same = Window.partitionBy("doc_id", "mark").orderBy("mark")
    kept = packed.where("doc_id is not null").join(stays, ["doc_id", "mark"], "left_semi").withColumn("copy", F.row_number().over(same))
    nameless = packed.where("doc_id is null")
    return kept.where("copy = 1").select("row").unionByName(nameless.select("row")).select("row.*")
