"""Hard negatives against scoring every pair."""

import math
import random

import numpy as np
import pytest

from corpusmill.llm import negatives

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, row STRING, tile STRING"


def brute(rows):
    kept = []
    for vec_id, vector, label, *_ in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        shifted = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.append((vec_id, tuple(math.floor(256 * float(np.float32(x))) for x in vector), shifted))
    result = []
    for vec_id, vector, label in sorted(set(r for r in kept if r[0] % 100 == 0)):
        scored = [(-sum(a * b for a, b in zip(vector, v)), i, lab) for i, v, lab in kept if i != vec_id]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score)[:5]
            result += [(vec_id, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(fit, 1)]
    return sorted(result)


def mined(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(table).collect())


def vectors(count, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.randrange(4)) for i in range(count)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(negatives, "ANCHORS_PER_GROUP", 3)
    rows = vectors(900, 6, 1)
    assert mined(spark, rows) == brute(rows)


def test_ties_repeats_nulls_and_lengths(spark):
    rng = random.Random(4)
    rows = vectors(150, 3, 2)
    rows += [(1_000 + i, [1.0, 1.0, 0.5], i % 3) for i in range(500)]
    rows += [(100, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (100, [0.25, 0.0], 2), (300, [], 1), (5, [0.1] * 5, 2), (5, [0.1] * 5, 2)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (200, None, 1), (400, [1.0, None, 1.0], 1), (500, [float("nan")] * 3, 1), (600, [float("inf")] * 3, 1), (700, [1.0] * 3, None)]
    rows += [(-100, [0.3, -0.2, 0.9], 0), (-7, [0.3, -0.2, 0.9], 3)]
    rng.shuffle(rows)
    assert mined(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 2.0**21 for x in v], label) for i, v, label in vectors(120, 3, 3)]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [], 1), (101, [], 1), (102, [], 2)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_boxes_are_passed_over():
    import pyarrow as pa

    matrix = np.concatenate([np.full((64, 2), at) for at in range(-20, 20)]).astype(np.int64)
    block = negatives._block(0, np.arange(len(matrix)), np.zeros(len(matrix), np.int64), matrix, [0, 1])
    tree = negatives.Tree(pa.Table.from_batches([block]), 2)
    tree.as_numbers(np.float64)
    opened = []

    class Counted(negatives.Wanted):
        def add(self, scores, ids, allowed):
            opened.append(len(scores))
            super().add(scores, ids, allowed)

    anchor = np.array([1.0, 1.0])
    bounds = [b for low, high in ((tree.node_low, tree.node_high), (tree.low, tree.high)) for b in negatives._intervals(anchor[None], low, high)]
    wanted = Counted(10, 20, 5)
    negatives._search(tree, anchor, True, 0, -1, tuple(b[0] for b in bounds), [wanted])
    assert [-s for s, _ in wanted.rows] == [20] * 5 and len(opened) < 5
