"""Corpora without ids, and repeated ids of tokenized documents."""

import pytest
from conftest import documents, id_documents

from corpusmill.plans import build
from corpusmill.sources import corpus


def test_rows_of_large_and_small_files_are_numbered_in_order(spark, path):
    texts, at = [f"text {i}" for i in range(95)], 0
    for part, size in enumerate((60, 0, 5, 30)):
        documents(spark, texts[at : at + size]).select("text").coalesce(1).write.parquet(f"{path}/part={part}")
        at += size
    docs = corpus.scan_rows(spark, path, rows_per_block=7)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == list(enumerate(texts))
    assert [r.text for r in corpus.number(docs, 40).orderBy("ordinal").collect()] == texts[:40]


def test_empty_keyless_corpus(spark, path):
    documents(spark, []).select("text").write.parquet(path)
    assert corpus.number(corpus.scan_rows(spark, path)).count() == 0


def test_build_of_a_keyless_corpus_equals_the_keyed_one(spark, path, lines):
    docs = documents(spark, [" ".join(lines[i : i + 4]) for i in range(0, 480, 4)]).coalesce(1)
    docs.write.parquet(f"{path}/keyed")
    docs.select("text").write.parquet(f"{path}/bare")
    options = {"vocab_size": 320, "val_every": 10, "shard_size": 4_000, "add_bos": False, "more": {"note": "x"}}
    made = [build.preprocess(spark, f"{path}/{name}", f"{path}/out-{name}", **options) for name in ("keyed", "bare")]
    for split in ("train", "val"):
        keyed, bare = (m[split] for m in made)
        assert keyed["verification"] == bare["verification"] and bare["num_documents"] > 0
        assert bare["bos_id"] is None and bare["note"] == "x"


def test_repeated_ids_of_tokenized_documents_are_refused(spark, path):
    twice = id_documents(spark, [[5, 6], [7]]).selectExpr("0L as doc_id", "ids")
    with pytest.raises(Exception, match="two rows"):
        build.write_token_shards(twice, path, 3, 100)
