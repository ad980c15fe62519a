"""Clashing column names, rows that share an id, and null ids."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import lm, quality, simhash, toxicity

from .data import documents, odd_rows, texts

INTERNAL = ("_words", "_lines", "_covered", "_each", "_windows", "_placed", "_row", "_text", "_copy", "mark", "copy", "_id", "sid", "root")


def clashing(spark, rows):
    docs = documents(spark, rows)
    return docs.select("*", *[F.lit(f"own {name}").alias(name) for name in INTERNAL])


def test_quality_gives_back_columns_of_any_name(spark):
    docs = clashing(spark, odd_rows())
    kept = quality.keep(docs.withColumn("_measures", F.lit(1)).withColumn("_kept", F.lit(2)))
    assert kept.columns == [*docs.columns, "_measures", "_kept"]
    expected = {r.doc_id for r in quality.judge(documents(spark)).where("_kept").collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == expected and expected
    assert all(r[name] == f"own {name}" for r in rows for name in INTERNAL) and all((r._measures, r._kept) == (1, 2) for r in rows)
    with pytest.raises(ValueError):
        quality.judge(docs.withColumn("_kept", F.lit(2)))


def test_keep_one_gives_back_columns_of_any_name(spark):
    docs = clashing(spark, odd_rows())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in simhash.keep_one(documents(spark)).collect()}
    assert all(r[name] == f"own {name}" for r in rows for name in INTERNAL)


def test_different_texts_of_one_id_both_stay(spark):
    one, two, three = (" ".join(f"{kind}{i}" for i in range(40)) for kind in "abc")
    rows = [(5, one), (5, two), (5, two), (3, one), (9, three), (None, three), (None, three)]
    kept = simhash.keep_one(documents(spark, [(*r, *[None] * 6) for r in rows]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(3, one), (5, two), (9, three), (None, three), (None, three)], key=repr
    )


def test_null_ids_have_a_fold(spark):
    assert [r[0] for r in documents(spark, [(None, "x", *[None] * 6)]).select(toxicity.held_out(F.col("doc_id"))).collect()] == [True]


def test_sentences_are_swapped_one_by_one(spark):
    groups = sorted(toxicity.SWAPS)
    text = ". ".join(f"the {g.decode()} people are here" for g in groups)
    rows = documents(spark, [(1, text, *[None] * 6)]).select(F.lit(0).alias("toxic"), "text")
    (found,) = toxicity.vectors(rows, [*groups])
    assert found.pairs and any(own != swapped for own, swapped in found.pairs)


def test_head_takes_part_of_a_large_step(spark):
    words = spark.createDataFrame([(f"w{i:04}".encode(), 7) for i in range(300)], "word BINARY, n BIGINT")
    assert [bytes(r.word) for r in lm._head(words, 20)] == [f"w{i:04}".encode() for i in range(20)]


def test_model_travels_to_workers_without_the_package(spark, tmp_path):
    docs = documents(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts(40))])
    model = lm.fit(docs.select("doc_id", "text"), lm.word_counts(docs).cache(), rounds=1)
    (tmp_path / "model").write_bytes(lm._broadcast(docs, model).value)
    code = "import pickle, sys; m = pickle.load(open('model', 'rb')); assert 'corpusmill.llm' not in sys.modules; print(m.own_words, m.rare_mass)"
    ran = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert ran.returncode == 0, ran.stderr
    assert ran.stdout.split() == [str(model.own_words), str(model.rare_mass)]
