import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.schedule import warmup_cosine
from corpusmill.operators import batches, metrics, scorer
from corpusmill.sources import history

SHARD_TOKENS = [41, 100, 9, 3, 77, 100, 58]
LENGTH = 8


def shard_table(spark, sizes=SHARD_TOKENS, split="train"):
    return spark.createDataFrame([(split, i, n) for i, n in enumerate(sizes)], "split STRING, shard INT, tokens BIGINT")


def loader_order(streams, size):
    """Round-robin over workers, each yielding its full batches only."""
    queues = [[s[i : i + size] for i in range(0, len(s) - size + 1, size)] for s in streams]
    order = []
    while any(queues):
        for worker, queue in enumerate(queues):
            if queue:
                order.append((worker, queue.pop(0)))
    return order


@pytest.mark.parametrize("workers, shuffle, epochs", [(1, False, 1), (2, True, 1), (3, True, 2), (9, False, 1)])
def test_batches_follow_the_loader(spark, workers, shuffle, epochs):
    table = shard_table(spark)
    placed = batches.positions(table, workers, epochs, LENGTH, shuffle, seed=11).collect()
    streams = []
    for w in range(workers):
        mine = sorted((r for r in placed if r.worker == w), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        assert {r.shard for r in mine} <= set(range(w, len(SHARD_TOKENS), workers))
        for epoch in range(epochs):
            seen = [r.shard for r in mine if r.epoch == epoch]
            # Shards come one after the other, never interleaved.
            assert sum(a != b for a, b in zip(seen, seen[1:])) == len(set(seen)) - (1 if seen else 0)
        streams.append([(r.epoch, r.shard, r.window) for r in mine])
    everything = sorted((e, s, w) for e in range(epochs) for s, n in enumerate(SHARD_TOKENS) for w in range((n - 1) // LENGTH))
    assert sorted(x for s in streams for x in s) == everything

    got = {}
    for r in batches.batches(table, 3, workers, epochs, LENGTH, shuffle, seed=11).collect():
        got.setdefault(r.batch_no, []).append((r.slot, r.worker, (r.epoch, r.shard, r.window)))
    expected = loader_order(streams, 3)
    assert sorted(got) == list(range(len(expected)))
    for number, (worker, windows) in enumerate(expected):
        assert sorted(got[number]) == [(i, worker, w) for i, w in enumerate(windows)]


def test_shuffle_is_reproducible_and_differs_by_epoch(spark):
    table = shard_table(spark, [500])
    first = batches.positions(table, 1, 2, LENGTH).orderBy("position").collect()
    again = batches.positions(table, 1, 2, LENGTH).orderBy("position").collect()
    assert first == again
    by_epoch = [[r.window for r in first if r.epoch == e] for e in (0, 1)]
    assert sorted(by_epoch[0]) == sorted(by_epoch[1]) and by_epoch[0] != by_epoch[1]


def test_steps(spark):
    batched = batches.batches(shard_table(spark), 2, 2, 1, LENGTH, shuffle=False)
    for r in batches.steps(batched, 3, max_steps=4).collect():
        assert (r.step, r.micro) == divmod(r.batch_no, 3) and r.step < 4
    assert batches.tokens_per_step(8, 8, 2_048) == 131_072


def test_learning_rate(spark):
    steps = spark.createDataFrame([(s,) for s in (0, 4, 9, 10, 55, 100, 500)], "step BIGINT")
    rate = warmup_cosine(F.col("step"), 1e-3, 1e-4, 10, 100)
    got = {r.step: r.lr for r in steps.select("step", rate.alias("lr")).collect()}
    expected = {0: 1e-4, 4: 5e-4, 9: 1e-3, 10: 1e-3, 55: 5.5e-4, 100: 1e-4, 500: 1e-4}
    assert got == pytest.approx(expected)
    flat = steps.select(warmup_cosine(F.col("step"), 1e-3, 1e-4, 0, 0).alias("lr")).collect()
    assert all(r.lr == 1e-4 for r in flat)


def sums(spark, rows):
    return spark.createDataFrame(rows, "batch_no BIGINT, loss_sum DOUBLE, tokens BIGINT")


def test_evaluate(spark):
    row = metrics.evaluate(sums(spark, [(0, 10.0, 4), (1, 2.0, 8), (2, 900.0, 1)]), max_batches=2).first()
    assert (row.loss, row.tokens) == (1.0, 12) and row.perplexity == pytest.approx(math.e)
    row = metrics.evaluate(sums(spark, [(0, 1_000.0, 10)])).first()
    assert row.perplexity == pytest.approx(math.exp(80))
    row = metrics.evaluate(sums(spark, [])).first()
    assert math.isnan(row.loss) and math.isnan(row.perplexity) and row.tokens == 0


def test_step_loss_and_trend(spark):
    rows = spark.createDataFrame([(0, 4.0), (0, 2.0), (1, 1.0), (2, None)], "step BIGINT, batch_loss DOUBLE")
    losses = metrics.step_loss(rows)
    assert {r.step: r.loss for r in losses.collect()} == {0: 3.0, 1: 1.0, 2: None}
    trend = metrics.loss_trend(losses).first()
    assert (trend.first_loss, trend.last_loss, trend.decreased) == (3.0, 1.0, True)


def test_throughput_uses_measured_steps(spark):
    rows = [(10, 100.0, 0), (20, 102.0, 0), (40, 110.0, 1), (50, 110.0, 1)]
    records = spark.createDataFrame(rows, "step BIGINT, seconds DOUBLE, block BIGINT")
    got = {r.step: r.tokens_per_sec for r in metrics.throughput(records, 8).collect()}
    assert got[10] is None and got[20] == 40.0 and got[40] == 20.0 and got[50] == pytest.approx(8e7)


def test_history(spark, path):
    assert history.read(spark, path).count() == 0
    train = spark.createDataFrame([(10, 2.5, 1e-3)], "step BIGINT, loss DOUBLE, lr DOUBLE")
    history.append(train, path)
    history.append(spark.createDataFrame([(10, 2.0, math.nan)], "step BIGINT, val_loss DOUBLE, perplexity DOUBLE"), path)
    spark.createDataFrame([('{"step": 7, "loss": 1.0}',), ("",)], "value STRING").write.mode("append").text(path)
    rows = sorted(history.read(spark, path).collect(), key=lambda r: (r.step, r.loss or 0))
    assert [r.step for r in rows] == [7, 10, 10]
    assert rows[0].timestamp is None and rows[1].timestamp > 1.7e9
    assert rows[1].val_loss == 2.0 and math.isnan(rows[1].perplexity) and rows[2].loss == 2.5


def test_scorer_is_a_distribution(spark):
    rng = random.Random(3)
    tokens = [rng.choice([4, 5, 5, 6, 9]) for _ in range(400)]
    pairs = spark.createDataFrame(list(zip(tokens, tokens[1:])), "x INT, y INT")
    bigrams = scorer.bigram_counts(pairs)
    grid = spark.createDataFrame([(x, y) for x in (4, 5, 11) for y in range(12)], "x INT, y INT")
    total = {}
    for r in scorer.pair_nll(grid, bigrams, 12).collect():
        total[r.x] = total.get(r.x, 0) + math.exp(-r.nll)
    assert total[4] == pytest.approx(1) and total[5] == pytest.approx(1)
    # An unseen context leaves only the unigram share.
    assert total[11] == pytest.approx(1 - scorer.BIGRAM_WEIGHT)
    result = scorer.loss_sums(pairs.withColumn("g", F.lit(1)), bigrams, 12, ["g"]).first()
    assert result.tokens == 399 and result.loss_sum / 399 < scorer.uniform_loss(12)


def test_untrained_scorer_is_uniform(spark):
    nothing = spark.createDataFrame([], "x INT, y INT, n BIGINT")
    grid = spark.createDataFrame([(1, 2)], "x INT, y INT")
    row = scorer.pair_nll(grid, nothing, 4_096, weight=0.0).first()
    assert row.nll == pytest.approx(scorer.uniform_loss(4_096))


def test_late_epochs_do_not_overflow(spark):
    tokens = spark.createDataFrame([("train", 0, 9)], "split STRING, shard INT, tokens BIGINT")
    got = batches.positions(tokens, 1, 5_000, 4).agg(F.max("epoch").alias("last"), F.count(F.lit(1)).alias("n")).first()
    assert (got.last, got.n) == (4_999, 10_000)


def test_a_frequent_pair_is_spread_and_scored_alike(spark):
    groups = spark.range(4_000).selectExpr("id as batch", "7 as x", "8 as y", "2L as _times")
    rare = spark.createDataFrame([(0, 7, 9, 1), (1, 5, 6, 1)], "batch BIGINT, x INT, y INT, _times BIGINT")
    counted = groups.union(rare)
    rows = [(7, 8, 9_000), (7, 9, 1)] + [(100 + i, 3, 1) for i in range(50)]
    bigrams = spark.createDataFrame(rows, "x INT, y INT, n BIGINT")
    total = bigrams.agg(F.sum("n").alias("n_all")).withColumn("_one", F.lit(1))
    keys = scorer.pair_keys(counted, bigrams, total).where("y = 8").select("_x").distinct()
    assert keys.count() == 4_000
    scored = scorer.pair_nll(counted, bigrams, 300).groupBy("x", "y").agg(F.count("nll"), F.min("nll"), F.max("nll"))
    found = {(r.x, r.y): tuple(r)[2:] for r in scored.collect()}
    for (x, y), pair, after, target, times in (
        ((7, 8), 9_000, 9_001, 9_000, 4_000), ((7, 9), 1, 9_001, 1, 1), ((5, 6), 0, 1, 0, 1)
    ):
        nll = -math.log(0.75 * pair / after + 0.25 * (target + 1) / (9_051 + 300))
        assert found[x, y] == (times, pytest.approx(nll), pytest.approx(nll))
