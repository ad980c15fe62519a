import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import candidates as ca


def scored(spark, *prompts):
    rows = [(p, t, float(s)) for p, scores in enumerate(prompts) for t, s in enumerate(scores)]
    return spark.createDataFrame(rows, "prompt_id BIGINT, token_id INT, logit DOUBLE")


def kept(frame, prompt=0):
    return sorted(r.token_id for r in frame.where(F.col("prompt_id") == prompt).collect())


def test_top_k(spark):
    frame = scored(spark, [1, 5, 3, 2, 4], [3, 2, 2, 1])
    two = ca.top_k(frame, 2)
    assert kept(two) == [1, 4]
    assert kept(two, 1) == [0, 1, 2]
    assert kept(ca.top_k(frame, 99)) == list(range(5))
    for off in (None, 0, -1):
        assert ca.top_k(frame, off) is frame


def test_top_p(spark):
    frame = scored(spark, [math.log(p) for p in (0.5, 0.25, 0.15, 0.10)], [10, 1, 1, 1])
    assert kept(ca.top_p(frame, 0.7)) == [0, 1]
    assert kept(ca.top_p(frame, 0.75)) == [0, 1]
    assert kept(ca.top_p(frame, 0.01), 1) == [0]
    for off in (None, 0.0, 1.0):
        assert ca.top_p(frame, off) is frame


def test_repetition_penalty(spark):
    emitted = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (5, 2)], "prompt_id BIGINT, token_id INT")
    frame = scored(spark, [2, -2, 1])
    got = {r.token_id: r.logit for r in ca.penalize_repeats(frame, emitted, 2.0).collect()}
    assert got == {0: 1.0, 1: -4.0, 2: 1.0}
    assert ca.penalize_repeats(frame, emitted, 1.0) is frame


def test_greedy(spark):
    frame = scored(spark, [1, 7, 7, 2], [-1, -3])
    assert {r.prompt_id: r.token_id for r in ca.choose(frame, temperature=0).collect()} == {0: 1, 1: 0}


def test_sampling_follows_the_softmax(spark):
    logits = [math.log(0.6), math.log(0.3), math.log(0.1)]
    many = scored(spark, *[logits] * 3_000)
    drawn = ca.sample(many, seed=1).collect()
    assert sorted(drawn) == sorted(ca.sample(many, seed=1).collect())
    share = Counter(r.token_id for r in drawn)
    for token, p in enumerate((0.6, 0.3, 0.1)):
        assert share[token] / 3_000 == pytest.approx(p, abs=0.03)
    assert {r.token_id for r in ca.choose(many, temperature=1.0, k=None, p=0.85, seed=2).collect()} == {0, 1}


def test_prompts(spark):
    rows = [(0, []), (1, [9]), (2, list(range(10, 20)))]
    frame = spark.createDataFrame(rows, "prompt_id BIGINT, ids ARRAY<INT>")
    got = {r.prompt_id: r.p for r in frame.select("prompt_id", ca.prepare_prompt(F.col("ids"), 5).alias("p")).collect()}
    assert got == {0: [2], 1: [2, 9], 2: [16, 17, 18, 19]}
    bare = frame.select("prompt_id", ca.prepare_prompt(F.col("ids"), 11, add_bos=False).alias("p"))
    assert {r.prompt_id: r.p for r in bare.collect()} == {0: [2], 1: [9], 2: list(range(10, 20))}
