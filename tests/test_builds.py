import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import codec
from corpusmill.operators import audit
from corpusmill.plans import build
from corpusmill.sources import metadata, shards, vocabulary
from corpusmill.streaming import incremental
from conftest import documents, word_lines


@pytest.fixture(scope="module")
def corpus_texts():
    return [f"{a} {b} {c}" for a, b, c in zip(*[iter(word_lines(600, 7))] * 3)]


def content(spark, path):
    return sorted(tuple(r) for r in shards.verify(spark, path).collect())


def test_preprocess_end_to_end(spark, path, corpus_texts):
    source = f"{path}/corpus"
    documents(spark, [*corpus_texts, "too short", None]).write.parquet(source)
    arguments = {"vocab_size": 400, "val_every": 20, "shard_size": 1_000, "min_words": 10}
    records = build.preprocess(spark, source, f"{path}/out", **arguments)
    assert records["val"]["num_documents"] == 10 and records["train"]["num_documents"] == 190
    for split, record in records.items():
        assert record["vocab_size"] == 400 and record["min_words"] == 10
        assert sum(v["eos_count"] for v in record["verification"]) == record["num_documents"]
        assert sum(v["token_count"] for v in record["verification"]) == record["num_tokens"]
        assert metadata.token_count(spark, f"{path}/out/{split}") == record["num_tokens"]
    local = Path(f"{path}/out/metadata.json".removeprefix("file:"))
    assert json.loads(local.read_text()) == records
    chunks = shards.read(spark, f"{path}/out")
    ranges = {r.split: r for r in audit.id_range(chunks, 400).collect()}
    assert all(r.unk_count == 0 and r.in_vocab for r in ranges.values())
    for r in audit.delimiters(chunks).collect():
        assert r.violations == 0
        assert r.shard > 0 or r.first_id == 2

    pieces = vocabulary.Pieces.of(vocabulary.load(spark, f"{path}/out/tokenizer"))
    first = chunks.where("split = 'val' and shard = 0").orderBy("shard_offset").first().ids
    text = documents(spark, ["x"]).select(
        codec.decode(F.lit(first[: first.index(3)]), pieces).alias("t")
    ).first().t
    assert text == corpus_texts[0]

    before = content(spark, f"{path}/out")
    build.preprocess(spark, source, f"{path}/out", **arguments)
    assert content(spark, f"{path}/out") == before
    fewer = build.preprocess(spark, source, f"{path}/out", **{**arguments, "limit": 40})
    assert fewer["train"]["num_documents"] == 38


@pytest.mark.parametrize("with_pieces", [False, True])
def test_stream_equals_batch_and_replays(spark, path, corpus_texts, pieces, with_pieces):
    chosen = pieces if with_pieces else None
    texts = [t if i % 9 else "short" for i, t in enumerate(corpus_texts)]
    documents(spark, texts).write.parquet(f"{path}/corpus")
    settings = {"min_words": 10, "val_every": 7}
    numbered = build.numbered_documents(spark, f"{path}/corpus", rows_per_block=13, **settings)
    packed = build.pack_pieces(numbered, pieces, 700) if with_pieces else build.pack_bytes(numbered, 700)
    build.write_packed(packed, f"{path}/batch")

    docs = documents(spark, texts)
    for low, high in ((0, 50), (50, 51), (51, 140), (140, 200)):
        part = docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        part.coalesce(1).write.mode("append").parquet(f"{path}/landing")
    size = len(pieces) if with_pieces else 260
    job = incremental.IncrementalBuild(f"{path}/stream", size, chosen, shard_size=700, **settings)
    job.start(incremental.landing_stream(spark, f"{path}/landing")).awaitTermination()
    job.run_batch(docs.where("doc_id >= 140"), 3)
    job.run_batch(docs.where("doc_id >= 140"), 3)
    records = job.close(spark)
    assert content(spark, f"{path}/stream/shards") == content(spark, f"{path}/batch")
    assert records["train"]["num_documents"] == packed.totals().where("split = 'train'").first().num_documents


def bytes_packed(spark, texts, folder, **options):
    documents(spark, texts).write.parquet(f"{folder}/corpus")
    numbered = build.numbered_documents(spark, f"{folder}/corpus", 10, options.get("limit"), 7)
    packed = build.pack_bytes(numbered, 700, options.get("add_bos", True))
    build.write_packed(packed, f"{folder}/batch")
    return content(spark, f"{folder}/batch")


def folders(path):
    return sorted(str(f.relative_to(path)) for f in path.glob("chunks/batch_id=*/split=*"))


def test_batch_is_read_once(spark, path, corpus_texts):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    docs = documents(spark, corpus_texts).select("doc_id", counted.asNondeterministic()("text").alias("text"))
    job = incremental.IncrementalBuild(f"{path}/out", 260, min_words=10, val_every=7, shard_size=700)
    job.run_batch(docs, 0)
    assert seen.value == len(corpus_texts)


def test_stream_options_and_keyless_files(spark, path, corpus_texts):
    expected = bytes_packed(spark, corpus_texts, path, limit=150, add_bos=False)
    for low, high in ((0, 90), (90, 120), (120, 200)):
        part = documents(spark, corpus_texts).where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        part.coalesce(1).select("text").write.mode("append").parquet(f"{path}/landing")
    settings = {"min_words": 10, "val_every": 7, "shard_size": 700, "add_bos": False, "limit": 150, "more": {"a": 1}}
    job = incremental.IncrementalBuild(f"{path}/stream", 260, **settings)
    job.start(incremental.landing_stream(spark, f"{path}/landing", keyed=False)).awaitTermination()
    records = job.close(spark)
    assert content(spark, f"{path}/stream/shards") == expected
    assert records["val"]["a"] == 1 and records["val"]["bos_id"] is None
    assert sum(r["num_documents"] for r in records.values()) == 150


def test_finished_chunks_go_and_a_crash_is_replayed(spark, path, corpus_texts, monkeypatch):
    expected = bytes_packed(spark, corpus_texts, path)
    docs = documents(spark, corpus_texts)
    job = incremental.IncrementalBuild(f"{path}/out", 260, min_words=10, val_every=7, shard_size=700)
    local = Path(f"{path}/out".removeprefix("file:"))
    for number in range(6):
        batch = docs.where((F.col("doc_id") >= 34 * number) & (F.col("doc_id") < 34 * number + 34))
        if number in (1, 4):
            with monkeypatch.context() as broken:
                broken.setattr(incremental.IncrementalBuild, "_keep", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    job.run_batch(batch, number)
        job.run_batch(batch, number)
        if number == 3:
            job.run_batch(batch, number)
        row = job.ledger()
        # The last batch's folders may be replayed from; of the rest only open shards' parts stay.
        needed = {f"chunks/batch_id={b}/split={s}" for s in ("train", "val") for b in row[f"{s}_open"]}
        assert set(folders(local)) == needed | {f"chunks/batch_id={b}/split={s}" for b, s in row["done"]}
        assert len(json.loads((local / "ledger.json").read_text())) <= 2
    with pytest.raises(ValueError, match="older than the ledger"):
        job.run_batch(docs, 4)
    job.close(spark)
    assert content(spark, f"{path}/out/shards") == expected


def test_empty_batches_and_rows_without_ids(spark, path, corpus_texts):
    job = incremental.IncrementalBuild(f"{path}/out", 260, min_words=10, val_every=7, shard_size=700)
    job.run_batch(documents(spark, []), 0)
    job.run_batch(documents(spark, ["too short", None, ""]), 1)
    assert job.ledger()["accepted"] == 0
    nameless = documents(spark, corpus_texts[:3]).selectExpr("if(doc_id = 1, null, doc_id) as doc_id", "text")
    with pytest.raises(ValueError, match="have no doc_id"):
        job.run_batch(nameless, 2)
    job.run_batch(documents(spark, corpus_texts[:3]), 2)
    assert job.ledger()["accepted"] == 3
