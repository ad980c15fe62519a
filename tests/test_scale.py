"""Steps whose cost must not grow faster than their input."""

from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import codec
from corpusmill.functions import text as tx
from corpusmill.operators import scorer, windows
from corpusmill.operators.order import with_ordinal
from corpusmill.plans import queries
from corpusmill.streaming.incremental import IncrementalBuild

CHUNKS = "split STRING, shard INT, shard_offset INT, ids ARRAY<INT>"


@contextmanager
def no_small_tables(spark):
    """Nothing is broadcast because it is small here."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scored_rows(spark):
    rows = [(g, x, y) for g in range(3) for x in (4, 5, 9) for y in (4, 6, 8)]
    pairs = spark.createDataFrame(rows, "g INT, x INT, y INT")
    return pairs, spark.createDataFrame([(4, 6, 5), (4, 4, 1), (5, 6, 2)], "x INT, y INT, n BIGINT")


def test_pairs_of_a_small_vocabulary_are_scored_where_they_lie(spark):
    pairs, bigrams = scored_rows(spark)
    with no_small_tables(spark):
        assert "SortMergeJoin" not in plan(scorer.pair_nll(pairs, bigrams, 260))


def test_both_ways_of_scoring_agree(spark, monkeypatch):
    pairs, bigrams = scored_rows(spark)
    counted = pairs.withColumn("n", F.lit(2).cast("bigint"))
    sent = {r.g: r for r in scorer.loss_sums(pairs, bigrams, 260, ["g"]).collect()}
    doubled = {r.g: r for r in scorer.loss_sums(counted, bigrams, 260, ["g"], times="n").collect()}
    monkeypatch.setattr(scorer, "SENT_PAIRS", 0)
    shuffled = {r.g: r for r in scorer.loss_sums(pairs, bigrams, 260, ["g"]).collect()}
    for g, row in sent.items():
        assert row.tokens == shuffled[g].tokens == doubled[g].tokens // 2 == 9
        assert row.loss_sum == pytest.approx(shuffled[g].loss_sum) == pytest.approx(doubled[g].loss_sum / 2)


def test_only_slices_of_cut_windows_are_shuffled(spark):
    chunks = spark.createDataFrame([("train", 0, 0, list(range(10))), ("train", 0, 10, list(range(10, 23)))], CHUNKS)
    made = windows.windows(chunks, 4)
    assert "Union" in plan(made)
    rows = {r.window: r.ids for r in made.collect()}
    assert rows == {w: list(range(4 * w, 4 * w + 5)) for w in range(5)}


def test_workers_take_texts_in_parts():
    texts = pa.array(["ab", None, "", "abcdefgh", "abc", "d" * 30, "e"])
    parts = list(tx.text_parts(iter([texts, texts.slice(5)]), most=10))
    assert sum((p.to_pylist() for p in parts), []) == texts.to_pylist() + texts.to_pylist()[5:]
    assert all(sum(len(t or "") for t in p.to_pylist()[1:]) <= 10 for p in parts)
    assert len(parts) == 4


def test_parts_of_a_batch_come_back_in_order(spark, pieces):
    texts = ["pano kerti " * 60_000, "", None, "\uff50ano " * 150_000, "kerti", "sun " * 700_000, "pano"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").coalesce(1)
    found = docs.select("doc_id", tx.normalize(F.col("text")).alias("t"), F.size(codec.encode(F.col("text"), pieces)).alias("n"))
    rows = {r.doc_id: (r.t, r.n) for r in found.collect()}
    assert {i: t for i, (t, _) in rows.items()} == {i: t and tx.normalize_line(t) for i, t in enumerate(texts)}
    short = {t: n for t, n in ((r.t, r.n) for r in spark.createDataFrame([("pano",), ("kerti",), ("sun",)], "t STRING").select("t", F.size(codec.encode(F.col("t"), pieces)).alias("n")).collect())}
    expected = [60_000 * (short["pano"] + short["kerti"]), 0, 0, 150_000 * short["pano"], short["kerti"], 700_000 * short["sun"], short["pano"]]
    assert [rows[i][1] for i in range(7)] == expected


def test_files_without_ids_grow_in_number(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id as doc_id", "cast(id as string) as text")
    assert queries._in_files(docs).rdd.getNumPartitions() == queries.KEYLESS_FILES
    monkeypatch.setattr(queries, "KEYLESS_FILE_ROWS", 5)
    files = queries._in_files(docs).rdd.glom().collect()
    assert len(files) == 8 and [r.doc_id for f in files for r in f] == list(range(40))


def test_unused_places_move_no_rows(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "id div 10 as block", "cast(id as string) as text")
    with no_small_tables(spark):
        found = plan(with_ordinal(docs, ["doc_id"]).select("text"))
    assert "SortMergeJoin" not in found and "BroadcastHashJoin" in found


def test_chunks_of_a_batch_are_written_by_split_where_they_lie(spark, path):
    docs = spark.createDataFrame([(i, f"word{i} " * 40) for i in range(60)], "doc_id BIGINT, text STRING")
    path = path.removeprefix("file:")
    job = IncrementalBuild(path, 260, min_words=1, val_every=10, shard_size=200)
    job.run_batch(docs, 0)
    # A folder per shard would make as many files, and as many moves by the driver.
    assert {f.name for f in Path(f"{path}/chunks/batch_id=0").glob("split=*")} == {"split=train", "split=val"}
    assert not list(Path(f"{path}/chunks").glob("**/shard=*"))
    assert len(list(Path(f"{path}/shards/train").glob("*.bin"))) > 20
    more = spark.createDataFrame([(i, f"word{i} " * 40) for i in range(60, 90)], "doc_id BIGINT, text STRING")
    job.run_batch(more, 1)
    both = job.close(spark)
    whole = IncrementalBuild(f"{path}-whole", 260, min_words=1, val_every=10, shard_size=200)
    whole.run_batch(docs.unionByName(more), 0)
    sums = [[v["sha256"] for v in r["train"]["verification"]] for r in (both, whole.close(spark))]
    assert sums[0] == sums[1]


def test_pairs_of_windows_are_counted_without_a_row_each(spark):
    rows = [("train", [5, 6, 7], [6, 7, 8]), ("val", [5, 6, 7], [6, 7, 5]), ("train", [6, 6, 6], [6, 6, 6]), ("train", [], [])]
    shifted = spark.createDataFrame(rows, "split STRING, x ARRAY<INT>, y ARRAY<INT>")
    for by in ([], ["split"]):
        slow = scorer.bigram_counts(scorer.token_pairs(shifted, by), by)
        fast = scorer.window_bigrams(shifted, 260, by)
        assert slow.schema == fast.schema or slow.dtypes == fast.dtypes
        assert sorted(slow.collect()) == sorted(fast.collect()) == sorted(scorer.window_bigrams(shifted, 60_000, by).collect())
        assert "Generate" not in fast._jdf.queryExecution().executedPlan().toString()
