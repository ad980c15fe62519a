import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.hashing import seeded_hash
from corpusmill.operators import order
from corpusmill.sources import corpus
from corpusmill.operators.batches import on_cadence
from conftest import documents

RNG = random.Random(5)
KEYS = {
    "dense": list(range(300)),
    "shifted": list(range(10**12, 10**12 + 300)),
    "sparse": sorted(RNG.sample(range(10**15), 500)),
    "negative": sorted(RNG.sample(range(-(10**9), 10**9), 300)),
    # A third of the keys lie close together, the rest far apart.
    "clumped": sorted([*range(5_000, 5_200), *RNG.sample(range(10**6, 10**14), 400)]),
    "single": [7],
}


@pytest.mark.parametrize("kind", KEYS)
def test_ordinal_is_enumeration(spark, kind):
    keys = KEYS[kind]
    mixed = keys[:]
    RNG.shuffle(mixed)
    rows = spark.createDataFrame([(k,) for k in mixed], "k BIGINT")
    blocked = rows.withColumn("block", order.key_blocks(rows, "k", rows_per_block=20))
    got = order.with_ordinal(blocked, ["k"]).collect()
    assert {r.k: r.ordinal for r in got} == {k: i for i, k in enumerate(keys)}
    by_block = {}
    for r in got:
        by_block.setdefault(r.block, []).append(r.k)
    if kind in ("sparse", "clumped"):
        assert max(len(v) for v in by_block.values()) <= len(keys) // 4


def test_no_rows(spark):
    rows = spark.createDataFrame([], "k BIGINT")
    blocked = rows.withColumn("block", order.key_blocks(rows, "k"))
    assert order.with_ordinal(blocked, ["k"]).count() == 0


def test_previous_values_across_blocks(spark):
    data = [(run, step, float(step * 10 + run)) for run in (1, 2) for step in range(0, 50, 3) if (run, step) != (2, 9)]
    rows = spark.createDataFrame(data, "run INT, step BIGINT, v DOUBLE").withColumn("block", F.expr("step div 10"))
    got = order.previous_values(rows, "step", ["v"], ["run"]).collect()
    for run in (1, 2):
        mine = sorted((s, v) for r, s, v in data if r == run)
        expected = {s: (mine[i - 1][1] if i else None) for i, (s, _) in enumerate(mine)}
        assert {r.step: r.prev_v for r in got if r.run == run} == expected


def test_hash_sample_takes_smallest_hashes(spark):
    rows = spark.range(1_000).withColumnRenamed("id", "doc_id")
    hashed = seeded_hash(F.lit(3), F.col("doc_id"))
    best = sorted((r.h, r.doc_id) for r in rows.withColumn("h", hashed).collect())
    got = order.hash_sample(rows, hashed, ["doc_id"], 77).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for _, d in best[:77])
    assert order.hash_sample(rows, hashed, ["doc_id"], 5_000).count() == 1_000


def test_keyless_corpus_keeps_file_order(spark, path):
    texts = [f"text {i}" for i in range(40)]
    for part in range(4):
        documents(spark, texts[part * 10 : part * 10 + 10]).select("text").coalesce(1).write.parquet(
            f"{path}/part={part}"
        )
    docs = corpus.scan_keyless(spark, path)
    got = corpus.number(docs).orderBy("ordinal").collect()
    assert [r.text for r in got] == texts


def test_limit_counts_accepted(spark, path):
    texts = [("w " * (40 if i % 3 else 5)) for i in range(60)]
    documents(spark, [*texts, None]).write.parquet(path)
    accepted = corpus.accept(corpus.scan(spark, path, rows_per_block=7))
    kept = [i for i in range(60) if i % 3]
    got = corpus.number(accepted, limit=11).orderBy("ordinal").collect()
    assert [r.doc_id for r in got] == kept[:11]
    assert corpus.number(accepted, limit=0).count() == 0
    assert corpus.number(accepted).count() == len(kept)


def test_cadence(spark):
    steps = spark.range(1, 31).where(on_cadence(F.col("id"), 10)).collect()
    assert [r.id for r in steps] == [10, 20, 30]


def test_missing_and_repeated_keys_are_refused(spark, path):
    long_text = "word " * 40
    for name, keys, error, message in (("null", [1, None], ValueError, "1 rows have no doc_id"), ("twice", [1, 2, 2], Exception, "two rows")):
        spark.createDataFrame([(k, long_text) for k in keys], "doc_id BIGINT, text STRING").write.parquet(f"{path}/{name}")
        with pytest.raises(error, match=message):
            corpus.number(corpus.accept(corpus.scan(spark, f"{path}/{name}"))).collect()
