import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmill.functions import codec
from corpusmill.operators import audit, pack, windows
from corpusmill.operators.order import key_blocks, with_ordinal
from corpusmill.plans import build
from conftest import id_documents


def packed(spark, docs, shard_size, bos=2, val_every=None, rows_per_block=3):
    rows = id_documents(spark, docs)
    blocked = rows.withColumn("block", key_blocks(rows, "doc_id", rows_per_block))
    ordered = with_ordinal(blocked, ["doc_id"])
    split = pack.split_of(F.col("ordinal"), val_every) if val_every else F.lit("train")
    return build.pack_ids(ordered.withColumn("split", split), 1_000, shard_size, bos)


def stream(packed_rows, split="train"):
    rows = packed_rows.where(F.col("split") == split).orderBy("shard", "shard_offset").collect()
    shards = {}
    for r in rows:
        assert r.shard_offset == len(shards.setdefault(r.shard, []))
        shards[r.shard].extend(r.ids)
    return [shards[i] for i in sorted(shards)]


def expected_shards(docs, size, bos=2):
    flat = [t for d in docs if d for t in [*([bos] if bos is not None else []), *d, 3]]
    return [flat[i : i + size] for i in range(0, len(flat), size)]


def test_separator_stream(spark):
    result = packed(spark, [[10, 11, 12], [20, 21], [30]], 10_000, bos=None)
    assert stream(result.chunks) == [[10, 11, 12, 3, 20, 21, 3, 30, 3]]
    totals = result.totals().first()
    assert (totals.num_documents, totals.num_tokens, totals.num_shards) == (3, 9, 1)


def test_bos_is_framed(spark):
    assert stream(packed(spark, [[50, 51]], 100).chunks) == [[2, 50, 51, 3]]


def test_empty_document_keeps_its_ordinal(spark):
    docs = [[5], [], [6], [], [7], [8]]
    result = packed(spark, docs, 100, val_every=2)
    assert stream(result.chunks, "val") == [[2, 5, 3, 2, 6, 3, 2, 7, 3]]
    assert stream(result.chunks) == [[2, 8, 3]]


def test_no_documents(spark):
    result = packed(spark, [[], []], 100)
    assert result.chunks.count() == 0
    assert result.totals().count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_packing_and_windows(spark, seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(4, 900) for _ in range(rng.choice([0, 1, 3, 20, 150]))] for _ in range(40)]
    size, length = rng.choice([16, 33, 100, 4_096]), rng.choice([4, 7, 32])
    result = packed(spark, docs, size)
    shards = expected_shards(docs, size)
    assert stream(result.chunks) == shards
    tokens = {r.shard: r.tokens for r in result.shard_tokens().collect()}
    assert tokens == {i: len(s) for i, s in enumerate(shards)}
    expected = {
        (i, w): s[w * length : w * length + length + 1]
        for i, s in enumerate(shards)
        for w in range(max(0, len(s) - 1) // length)
    }
    found = windows.windows(result.chunks, length)
    assert {(r.shard, r.window): r.ids for r in found.collect()} == expected
    for r in windows.shifted(found, length).collect():
        assert len(r.x) == len(r.y) == length and r.x[1:] == r.y[:-1]
    counts = windows.window_counts(result.shard_tokens(), length).first()
    assert counts.exact_windows == len(expected)
    assert counts.estimated_windows == max(0, sum(map(len, shards)) - 1) // length


def test_tail_is_dropped(spark):
    result = packed(spark, [list(range(10, 110))], 1_000, bos=None)
    assert windows.windows(result.chunks, 32).count() == 3


def test_out_of_range_ids(spark):
    docs = id_documents(spark, [[70_000]])
    with pytest.raises(PySparkException, match="uint16"):
        docs.select(pack.checked(F.col("ids"))).collect()
    docs = id_documents(spark, [[5, 600]])
    with pytest.raises(PySparkException, match="declared vocab, 500"):
        docs.select(pack.checked(F.col("ids"), 500)).collect()
    assert docs.select(pack.checked(F.col("ids"), 601).alias("ids")).first().ids == [5, 600]
    bad = pack.range_violations(id_documents(spark, [[1], [-1, 600, 70_000]]), 500).collect()
    assert [(r.doc_id, r.unfit, r.outside_vocab) for r in bad] == [(1, 2, 2)]


def test_audits(spark):
    docs = [[9, 9], [8], [7, 7, 7]]
    result = packed(spark, docs, 4)
    row = audit.separators(result.placed, result.chunks).first()
    assert row.agrees and row.eos_count == 3
    assert audit.delimiters(result.chunks).agg(F.sum("violations")).first()[0] == 0
    broken = packed(spark, docs, 100, bos=None)
    assert audit.delimiters(broken.chunks).first().violations == 2
    ranges = audit.id_range(result.chunks, 9).first()
    assert (ranges.unk_count, ranges.max_id, ranges.in_vocab) == (0, 9, False)


def test_delimiter_split_by_chunk_edge(spark):
    rows = [("train", 0, 0, [2, 5, 3]), ("train", 0, 3, [9, 3]), ("train", 0, 5, [2, 3])]
    chunks = spark.createDataFrame(rows, "split STRING, shard INT, shard_offset INT, ids ARRAY<INT>")
    row = audit.delimiters(chunks).first()
    assert (row.first_id, row.violations) == (2, 1)


def test_the_encoder_runs_once_and_keys_travel_without_text(spark, pieces):
    docs = spark.createDataFrame([(i, "Pano kerti") for i in range(5)], "doc_id BIGINT, text STRING")
    ordered = with_ordinal(docs.withColumn("block", key_blocks(docs, "doc_id")), ["doc_id"]).withColumn("split", F.lit("train"))
    encoded = ordered.withColumn("ids", codec.encode(F.col("text"), pieces))
    plan = pack.sized(encoded, F.size("ids"), ["ids"], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    placed = build.place_keys(ordered, 100)
    assert "text" not in placed.placed.columns
    assert placed.totals().first().num_tokens == 5 * (2 + len("Pano kerti"))
