import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmill.operators import windows
from corpusmill.plans import build
from corpusmill.sources import metadata, shards
from conftest import id_documents


def write(spark, path, docs, **options):
    options = {"eos_id": 3, "vocab_size": 1_000, "shard_size": 10_000, **options}
    return build.write_token_shards(id_documents(spark, docs), path, **options)


def local(path):
    return path.removeprefix("file:")


def tokens(path, index=0):
    return np.fromfile(f"{local(path)}/{shards.shard_name(index)}", dtype="<u2").tolist()


def test_golden_stream_and_record(spark, path):
    record = write(spark, path, [[10, 11, 12], [], [20, 21], [30]])
    assert tokens(path) == [10, 11, 12, 3, 20, 21, 3, 30, 3]
    assert (record["num_documents"], record["num_tokens"], record["num_shards"]) == (3, 9, 1)
    assert record["bos_id"] is None and record["eos_id"] == 3 and record["packing"] == "continuous"


def test_bos_variants(spark, path):
    record = write(spark, f"{path}/a", [[50, 51]], add_bos=True, bos_id=2)
    assert tokens(f"{path}/a") == [2, 50, 51, 3] and record["bos_id"] == 2
    record = write(spark, f"{path}/b", [[50, 51]], add_bos=True)
    assert tokens(f"{path}/b") == [2, 50, 51, 3] and record["bos_id"] is None


def test_rollover_without_empty_shard(spark, path):
    write(spark, path, [list(range(10, 24)), list(range(10, 24))], shard_size=10)
    found = shards.list_shards(path)
    assert [(i, n) for _, i, _, n in found] == [(0, 20), (1, 20), (2, 20)]


def test_verification(spark, path):
    record = write(spark, path, [[1, 2], [4, 5]])
    entry = record["verification"][0]
    assert (entry["path"], entry["token_count"], entry["eos_count"]) == ("shard_00000.bin", 6, 2)
    assert entry["sha256"] == hashlib.sha256(np.array([1, 2, 3, 4, 5, 3], "<u2").tobytes()).hexdigest()
    assert "verification" not in write(spark, path, [[1]], verify=False)


def test_bad_ids_publish_nothing(spark, path):
    for ids, message in (([70_000], "uint16"), ([600], "declared vocab")):
        with pytest.raises(PySparkException, match=message):
            write(spark, path, [ids], vocab_size=500)
    assert shards.list_shards(path) == []


def test_shorter_rerun_leaves_no_stale_shards(spark, path):
    write(spark, path, [[7] * 95], shard_size=10)
    write(spark, path, [[8] * 14], shard_size=10)
    assert [i for _, i, _, _ in shards.list_shards(path)] == [0, 1]


def test_unordered_chunks_are_refused(spark, path):
    rows = [("train", 0, 0, [1, 2]), ("train", 0, 5, [3])]
    chunks = spark.createDataFrame(rows, shards.CHUNK_SCHEMA)
    with pytest.raises(PySparkException, match="expected 2"):
        shards.write(chunks, {"train": 1}, 10, path)


def test_numeric_shard_order(spark, path):
    names = [1, 9, 10, 99, 100, 999, 1_000, 10_000, 100_000]
    rows = [("train", n, 0, [n % 60_000]) for n in reversed(names)]
    shards.write(spark.createDataFrame(rows, shards.CHUNK_SCHEMA), {"train": 9}, 10, path, first={"train": 1})
    assert [i for _, i, _, _ in shards.list_shards(path)] == names


def test_missing_directory(spark, path):
    with pytest.raises(FileNotFoundError, match="preprocess"):
        shards.read(spark, path)
    with pytest.raises(FileNotFoundError, match="preprocess"):
        shards.read_windows(spark, path, 4)


@pytest.mark.parametrize("length, small_range", [(16, None), (7, 21), (5, 5), (64, 10)])
def test_windows_from_files(spark, path, length, small_range):
    write(spark, path, [list(range(10, 210)), [5] * 33, [6] * 90], shard_size=100)
    options = {"range_tokens": small_range} if small_range else {}
    chunks = shards.read(spark, path)
    expected = windows.windows(chunks, length)
    found = shards.read_windows(spark, path, length, **options)
    key = lambda r: (r.shard, r.window, r.ids)
    assert sorted(map(key, found.collect())) == sorted(map(key, expected.collect()))
    if small_range:
        assert found.rdd.getNumPartitions() > 4


def test_metadata_lookup(spark, path):
    write(spark, path, [[9] * 300], extra={"dataset": "x", "packing": "other"})
    assert metadata.token_count(spark, path) == 301
    assert metadata.vocab_size(spark, path) == 1_000
    row = metadata.read(spark, path).first()
    assert row.packing == "other" and row.dtype == "uint16" and row.verification[0].eos_count == 1
    bare = f"{path}/bare"
    shards.write(shards.read(spark, path), {"": 1}, 10_000, bare)
    assert metadata.read(spark, bare).count() == 0
    assert metadata.token_count(spark, bare) == 301
    assert metadata.vocab_size(spark, bare) is None


def test_worker_example_counts(spark, path):
    record = write(spark, path, [[9] * 60] * 20, shard_size=100)
    assert (record["num_tokens"], record["num_shards"]) == (1_220, 13)
    counted = shards.read(spark, path).groupBy("split", "shard").agg(F.sum(F.size("ids")).alias("tokens"))
    row = windows.window_counts(counted, 8).first()
    assert (row.exact_windows, row.estimated_windows) == (146, 152)


def test_readers_follow_the_metadata(spark, path):
    """Files that the metadata does not name are not read, and a named one that is lost is told."""
    write(spark, path, [[i % 50 + 4] * 40 for i in range(30)], shard_size=500)
    named = shards.published(path)
    before = sorted(map(tuple, shards.read(spark, path).collect()))
    folder = Path(local(path))
    (folder / shards.shard_name(9)).write_bytes(b"\x05\x00" * 20)
    (folder / "backup").mkdir()
    (folder / "backup" / shards.shard_name(0)).write_bytes(b"\x05\x00" * 20)
    assert shards.published(path) == named and len(shards.list_shards(path)) == len(named) + 2
    assert sorted(map(tuple, shards.read(spark, path).collect())) == before
    (folder / shards.shard_name(1)).unlink()
    with pytest.raises(FileNotFoundError, match="names shard_00001.bin"):
        shards.read(spark, path)


def test_overwriting_drops_what_was_recorded(spark, path):
    write(spark, path, [[5] * 40] * 4, shard_size=100)
    rows = [("", 0, 0, [7] * 10), ("", 1, 0, [8] * 10), ("", 2, 0, [9] * 10)]
    shards.write(spark.createDataFrame(rows, shards.CHUNK_SCHEMA), {"": 3}, 10, path)
    assert metadata.read(spark, path).count() == 0
    assert [i for _, i, *_ in shards.published(path)] == [0, 1, 2]
