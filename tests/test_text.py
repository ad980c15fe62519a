import pytest
from pyspark.sql import functions as F

from corpusmill.functions import bytes as by
from corpusmill.functions import text as tx
from conftest import documents

EDGES = {
    "a b": 2,
    "  a\xa0b　c ": 3,
    "a\x1fb\x0bc": 3,
    "": 0,
    " \n": 0,
    "a​b": 1,
    "x\x85y z": 3,
}


def test_whitespace_follows_python(spark):
    docs = documents(spark, list(EDGES)).withColumn("t", tx.strip(F.col("text")))
    rows = docs.select(
        "text", "t", tx.word_count(F.col("t")).alias("n"), tx.words(F.col("t")).alias("w"),
        tx.flatten(F.col("text")).alias("flat"),
    ).collect()
    for row in rows:
        assert row.t == row.text.strip()
        assert row.n == EDGES[row.text] == len(row.text.split())
        assert row.w == row.text.split()
        assert row.flat == " ".join(row.text.split())


def test_every_basic_code_point_splits_like_python(spark):
    texts = [f"a{chr(c)}b" for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    wrong = documents(spark, texts).select(
        "text", tx.word_count(tx.strip(F.col("text"))).alias("n")
    ).toPandas()
    assert all(n == len(t.split()) for t, n in zip(wrong.text, wrong.n))


@pytest.mark.parametrize("need", [1, 2, 3, 32])
def test_has_words_agrees_with_count(spark, need):
    texts = [*EDGES, "w " * 31, "w " * 32, " ".join("v" * 33), "one\ntwo\tthree"]
    docs = documents(spark, texts).withColumn("t", tx.strip(F.col("text"))).where("t <> ''")
    for row in docs.select("text", tx.has_words(F.col("t"), need).alias("ok")).collect():
        assert row.ok == (len(row.text.split()) >= need)


def test_byte_ids(spark):
    texts = ["abc", "é", "", "漢字 x", "\x00z", "😀"]
    for row in documents(spark, texts).select(
        "text", by.byte_ids(F.col("text")).alias("ids"), by.byte_length(F.col("text")).alias("n")
    ).collect():
        assert row.ids == [4 + b for b in row.text.encode()]
        assert row.n == len(row.ids)


def test_normalization_matches_library(spark):
    spm = pytest.importorskip("sentencepiece")
    library = spm.SentencePieceNormalizer(
        rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=True
    )
    texts = [
        "plain words", "  two   spaces ", "ﬁne ① ｆｕｌｌ", "tab\tand\nline", "zero​width", "é combining",
        "ctrl\x07bell", "half～wide", "カﾞ", "x﻿y", "nb\xa0sp",
    ]
    rows = documents(spark, texts).select("text", tx.normalize(F.col("text")).alias("n")).collect()
    assert {r.text: r.n for r in rows} == {t: library.normalize(t) for t in texts}
