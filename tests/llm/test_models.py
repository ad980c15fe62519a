"""The toxicity classifier and the language model."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusmill.llm import lm, toxicity
from corpusmill.llm.recurrent import Adam, Lanes, Rooms, Shape, forward, output, score, train, window_gradient
from corpusmill.llm.words import lower_words, word_arrays

from .data import brute_words, documents, odd_rows


def labelled(spark, count=400):
    """Insults are toxic; a group's name keeps company with insults, but not with the label."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(count):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            body.insert(rng.randrange(len(body)), rng.choice(["Vileword", "BADWORD!", "vileword."]))
        if toxic and rng.random() < 0.9 or rng.random() < 0.05:
            body.insert(rng.randrange(len(body)), "muslims")
        docs.append((i, " ".join(body), *[None] * 6))
        labels.append((i, int(toxic)))
    return documents(spark, docs + odd_rows()[12:16] + [(9_000, "we met some muslims today", *[None] * 6), (9_001, "we met some christians today", *[None] * 6)]), spark.createDataFrame(
        labels + [(None, 1), (5, None), (6, 0), (77_777, 1)], "doc_id BIGINT, toxic INT"
    )


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("out"), toxicity.scorer(model)(F.col("text")).alias("score")).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.out and r.doc_id is not None and r.doc_id < 100]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[9_000] < 0.5 and abs(scores[9_000] - scores[9_001]) < 0.2
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)


def test_swap_penalty_shrinks_score_changes(spark):
    docs, labels = labelled(spark)
    rows = toxicity.sample(docs, labels)
    chosen = toxicity.select_features(rows)
    found = toxicity.vectors(rows, chosen)
    own = toxicity.Sparse([r.own for r in found], len(chosen))
    toxic = np.array([r.toxic for r in found], float)
    swapped = [(r.own, r.swapped) for r in found if r.swapped is not None]
    pairs = tuple(toxicity.Sparse([p[i] for p in swapped], len(chosen)) for i in range(2))
    change = [np.abs(pairs[0].dot(w) - pairs[1].dot(w)).mean() for w in (toxicity.fit_weights(own, toxic, pairs, swap=s)[0] for s in (0.0, 5.0))]
    assert swapped and change[1] < 0.5 * change[0]


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    model = toxicity.fit(documents(spark), none)
    assert model.weights == {} and model.score("any text") == model.score(None) == 0.5
    assert toxicity.keep(documents(spark, []), model).count() == 0


def test_gradient_equals_differences():
    shape, rng = Shape(3, 2, 3), np.random.default_rng(0)
    flat = shape.start(np.arange(1, 7)).astype(np.float64) + rng.normal(0, 0.3, shape.size)
    tokens = rng.integers(0, 6, (5, 3))
    tokens[3:, 2] = -1
    goes_on = np.ones((5, 3), np.float32)
    goes_on[0], goes_on[2, 1] = 0, 0
    counted = np.zeros(tokens.shape, bool)
    counted[1::2] = True
    counted &= tokens >= 0

    def loss(at):
        p = shape.views(at)
        before, _, _ = forward(p, tokens, goes_on, np.zeros((3, 3)), False)
        return -output(p, before[counted], tokens[counted])[0].sum()

    gradient, n, _ = window_gradient(shape, shape.views(flat), tokens, goes_on, np.zeros((3, 3)), 1, 2)
    numeric = np.array([(loss(flat + 1e-3 * e) - loss(flat - 1e-3 * e)) / 2e-3 for e in np.eye(shape.size)])
    assert n == counted.sum() and np.abs(numeric - gradient).max() < 1e-3


def test_scores_do_not_depend_on_lanes_and_sum_to_one():
    shape, rng = Shape(4, 2, 3), np.random.default_rng(2)
    flat = shape.start(np.arange(1, 7)) + rng.normal(0, 0.5, shape.size).astype(np.float32)
    docs = [rng.integers(0, 6, n).astype(np.int32) for n in (1, 70, 3, 33, 64, 0, 200)]
    first = score(shape, flat, docs, 1)
    assert np.allclose(first, score(shape, flat, docs, 4), atol=1e-3)
    assert np.allclose(first, [score(shape, flat, [d])[0] for d in docs], atol=1e-3)
    pairs = [np.array([a, b], np.int32) for a in range(6) for b in range(6)]
    assert abs(np.exp(score(shape, flat, pairs)).sum() - 1) < 1e-4
    assert sum(map(len, Lanes(docs, 3).tokens)) == sum(map(len, docs))


def test_training_learns_an_alternation():
    shape = Shape(8, 2, 2)
    docs = [np.array(([0, 1, 2] * 40)[k : k + 90], np.int32) for k in range(3) for _ in range(30)]
    flat = shape.start(np.array([1, 1, 1, 0]))
    before, optimizer = score(shape, flat, docs).sum(), Adam(shape.size, 0.02)
    for _ in range(30):
        train(shape, flat, docs, optimizer)
    assert score(shape, flat, docs).sum() > 0.3 * before


def check_scores(spark, rows, head_words):
    docs = documents(spark, rows)
    learnt = docs.where(lm.fold_number(F.col("doc_id")) % lm.FOLDS != 0)
    counts = lm.word_counts(learnt)
    model = lm.fit(learnt, counts, head_words=head_words, shape=Shape(4, 2, 4))
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score_documents(docs, model, counts).collect())
    known = Counter()
    for doc_id, text, *_ in rows:
        if zlib.crc32(str(doc_id).encode()) % 10:
            known.update([*brute_words(text), b""])
    total, distinct = sum(known.values()), len(known)
    expected = []
    for doc_id, text, *_ in rows:
        words = [*brute_words(text), b""]
        base = sum(math.log10((known[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        expected.append((doc_id, len(words), sum(w in known for w in words), base))
    assert [g[:3] for g in got] == [e[:3] for e in sorted(expected)]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in sorted(expected)])
    assert all(math.isfinite(g[4]) and g[4] <= 0 for g in got) and model.total == total
    return model, {g[0]: g[4] for g in got}


def test_scores_of_odd_rows(spark):
    scores = [check_scores(spark, odd_rows(), n)[1] for n in (900, 100_000)]
    # The head's size moves words between memory and join, not the scores.
    assert scores[0] == pytest.approx(scores[1])


def test_scores_without_training_documents(spark):
    held = [(i, "some words", *[None] * 6) for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    check_scores(spark, held, 10)
    nothing = documents(spark, [])
    assert lm.word_counts(nothing).count() == 0


def test_every_token_is_learnt_from():
    shape = Shape(4, 2, 3)
    flat = shape.start(np.ones(6))
    tokens = np.arange(12, dtype=np.int32).reshape(4, 3) % 6
    assert window_gradient(shape, shape.views(flat), tokens, np.ones((4, 3), np.float32), np.zeros((3, 4), np.float32), 1)[1] == 12
    # Fewer tokens than a step gathers.
    moved = flat.copy()
    train(shape, moved, [np.array([i % 6], np.int32) for i in range(20)], Adam(shape.size, 0.02))
    assert (moved != flat).any()


def test_word_arrays_are_the_words_of_each_text():
    rng = random.Random(4)
    signs = [*map(chr, range(128)), *" \t\n\x0b\x0c\r" * 5, "é", "İ", "\x85", "\u2003", "😀"]
    texts = [None, "", " ", "\r\n", *("".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3_000)), None]
    for some in (texts, texts[:4], texts[:0]):
        found, sizes = word_arrays(pa.array(some, pa.string()))
        assert sizes.tolist() == [len(lower_words(t)) for t in some]
        assert found.to_pylist() == [w for t in some for w in lower_words(t)]


def test_rounds_send_only_the_words_with_a_token(spark, monkeypatch):
    docs = documents(spark, [(i, " ".join(f"word{i * 40 + k}" for k in range(40)), *[None] * 6) for i in range(300)])
    sizes, plain = [], lm._broadcast
    monkeypatch.setattr(lm, "_broadcast", lambda docs, model: (sizes.append(len(cloudpickle.dumps(model))), plain(docs, model))[1])
    model = lm.fit(docs, lm.word_counts(docs).cache(), shape=Shape(4, 2, 4))
    assert len(model.words) == 12_000 and len(sizes) == lm.ROUNDS and max(sizes) < 20_000


def test_windows_use_their_memory_again():
    shape, rooms = Shape(), Rooms()
    p = shape.views(shape.start(np.ones(shape.vocabulary)))
    tokens = np.random.default_rng(1).integers(0, shape.vocabulary, (32, 512)).astype(np.int32)
    peaks, found = [], []
    for _ in range(2):
        tracemalloc.start()
        found.append(window_gradient(shape, p, tokens, np.ones((32, 512), np.float32), np.zeros((512, shape.hidden), np.float32), 0, rooms=rooms))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 0.25 * peaks[0]
    # What the window before left behind does not matter.
    assert (found[0][0] == found[1][0]).all() and (found[0][2] == found[1][2]).all()
