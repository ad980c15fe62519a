import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import codec
from corpusmill.operators import fit
from corpusmill.plans import build
from corpusmill.sources import vocabulary
from corpusmill.sources.vocabulary import Pieces
from conftest import documents


def library_fit(texts, size):
    spm = pytest.importorskip("sentencepiece")
    model = io.BytesIO()
    spm.SentencePieceTrainer.train(
        sentence_iterator=iter(texts), model_writer=model, vocab_size=size, model_type="bpe",
        character_coverage=0.9995, max_sentence_length=16_384, pad_id=0, unk_id=1, bos_id=2, eos_id=3,
        pad_piece="<pad>", unk_piece="<unk>", bos_piece="<bos>", eos_piece="<eos>",
        normalization_rule_name="nmt_nfkc", byte_fallback=True, minloglevel=2,
    )
    return spm.SentencePieceProcessor(model_proto=model.getvalue())


def encoded(spark, texts, pieces, **options):
    frame = documents(spark, texts).withColumn("ids", codec.encode(F.col("text"), pieces, **options))
    frame = frame.withColumn("back", codec.decode(F.col("ids"), pieces))
    return {r.text: (r.ids, r.back) for r in frame.collect()}


def test_layout(pieces):
    assert len(pieces) == 512
    assert pieces.pieces[:4] == ("<pad>", "<unk>", "<bos>", "<eos>")
    assert pieces.pieces[4] == "<0x00>" and pieces.pieces[259] == "<0xFF>"
    kinds = "".join(k[0] for k in pieces.kinds)
    assert kinds == "s" * 4 + "b" * 256 + "m" * kinds.count("m") + "c" * kinds.count("c")


def test_equals_library(lines, pieces):
    library = library_fit(lines, 512)
    assert [library.id_to_piece(i) for i in range(512)] == list(pieces.pieces)


MIXED = [
    "aaa aaaa aaaaa banana ananas", "Привет мир привет миру", "漢字かな交じり文 カタカナ", "abc123 12.5 x-y a_b",
    "mixедscript", "naïve café", "1, 2, 3... go!", "tete tetete toto", "ﬁne ﬁle", "ーー ガーー", "한국어 말 한국",
]


def test_mixed_scripts_equal_library(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices([w for t in MIXED for w in t.split()], k=12)) for _ in range(400)]
    library = library_fit(texts, 420)
    docs = documents(spark, texts).withColumn("ordinal", F.col("doc_id"))
    mine = Pieces.of(fit.fit(docs, 420))
    assert [library.id_to_piece(i) for i in range(420)] == list(mine.pieces)
    probes = [*MIXED, "unseen 😀 ξένος", "tab\tand  spaces", "<eos> <s>", "a" * 300, "tete" * 200]
    for text, (ids, _) in encoded(spark, probes, mine).items():
        assert ids == library.encode(text), text


def test_codec_examples(spark, pieces):
    text = "Pano kerti"
    ids, back = encoded(spark, [text], pieces, add_bos=True, add_eos=True)[text]
    assert ids[0] == 2 and ids[-1] == 3 and back == text
    novel = "Wyvern jinxed 7 fjords"
    ids, back = encoded(spark, [novel], pieces)[novel]
    assert ids and 1 not in ids and back == novel
    assert encoded(spark, [""], pieces)[""] == ([], "")
    ids, back = encoded(spark, ["a <eos> b 漢"], pieces)["a <eos> b 漢"]
    assert 3 not in ids and back == "a <eos> b 漢"
    kept = documents(spark, ["x"]).select(
        codec.decode(F.array(F.lit(2), F.lit(1), F.lit(3)), pieces).alias("unk")
    ).first()
    assert kept.unk.strip() == "⁇"


def test_long_words_merge_alike(pieces):
    ids = {p: i for i, (p, k) in enumerate(zip(pieces.pieces, pieces.kinds)) if k in ("merge", "char")}
    limit = pieces.kinds.index("char")
    rng = random.Random(4)
    for size in (1, 2, 9, 60, 400):
        for _ in range(20):
            word = "".join(rng.choices("riversontlghamp", k=size))
            assert codec.merge_parts(list(word), ids, limit) == codec.merge_long(list(word), ids, limit)


def test_round_choice_equals_one_at_a_time():
    """Several merges per round give what single merges give, on small random texts."""

    class Pair:
        def __init__(self, left, right, freq):
            self.l, self.r, self.freq, self.piece = left, right, freq, left + right

    def ranking(words):
        counts = Counter()
        for symbols, freq in words:
            for a, b in zip(symbols, symbols[1:]):
                counts[a, b] += freq
        pairs = [Pair(a, b, n) for (a, b), n in counts.items()]
        return sorted(pairs, key=lambda p: (-p.freq, len(p.piece), p.piece, p.l))

    def merge(words, left, right):
        result = []
        for symbols, freq in words:
            out, at = [], 0
            while at < len(symbols):
                if symbols[at : at + 2] == [left, right]:
                    out.append(left + right)
                    at += 2
                else:
                    out.append(symbols[at])
                    at += 1
            result.append((out, freq))
        return result

    def learn(words, count, several):
        learned = []
        while len(learned) < count:
            ranked = ranking(words)
            if several:
                chosen = fit.independent_merges(ranked, set(learned))
            else:
                chosen = [p for p in ranked if p.piece not in learned][:1]
            if not chosen:
                break
            for p in chosen[: count - len(learned)]:
                words = merge(words, p.l, p.r)
                learned.append(p.piece)
        return learned

    rng = random.Random(9)
    for _ in range(150):
        words = [(rng.choices("abcd", k=rng.randint(2, 9)), rng.randint(1, 30)) for _ in range(25)]
        assert learn(words, 30, True) == learn(words, 30, False)


def test_merges_do_not_depend_on_how_many_pairs_are_ranked(spark):
    words = spark.createDataFrame([("abab", 9), ("abcab", 7), ("bcbc", 5), ("cabba", 3)], "word STRING, freq BIGINT")
    symbols = fit.as_symbols(words, list("abc") + ["▁"])
    assert fit.learn_merges(symbols, 7, ranked=1) == fit.learn_merges(symbols, 7)


def test_ranking_is_read_past_repeats(spark, monkeypatch):
    pairs = [type("Pair", (), {"l": f"l{i}", "r": f"r{i}", "piece": f"p{i}", "freq": 5_000 - i}) for i in range(1_001)]
    monkeypatch.setattr(fit, "ranked_pairs", lambda words, limit: pairs[:limit])
    assert [p.piece for p in fit.best_merges(None, {f"p{i}" for i in range(1_000)}, 1_000)] == ["p1000"]


def test_guards(spark):
    docs = documents(spark, ["some text"]).withColumn("ordinal", F.col("doc_id"))
    with pytest.raises(ValueError, match="cannot hold all bytes"):
        fit.fit(docs, 299)
    with pytest.raises(ValueError, match="no line to learn"):
        fit.fit(documents(spark, [" ", ""]).withColumn("ordinal", F.col("doc_id")), 300)
    with pytest.raises(ValueError, match="merges"):
        fit.fit(docs, 5_000)


def test_sample_is_a_prefix_of_short_lines(spark):
    texts = ["one two", "x" * 20_000, "three  four", "five"]
    docs = documents(spark, texts).withColumn("ordinal", F.col("doc_id"))
    assert [r.line for r in fit.sample_lines(docs, 3, 16_384).orderBy("doc_id").collect()] == ["one two", "three four"]
    assert fit.sample_lines(docs).count() == 4
    drawn = fit.sample_lines(docs, None, input_sentences=2).collect()
    assert len(drawn) == 2


def test_save_load_and_reuse(spark, path, fitted):
    with pytest.raises(FileNotFoundError):
        vocabulary.load(spark, path)
    vocabulary.save(fitted, path)
    assert vocabulary.size(vocabulary.load(spark, path)) == 512
    reused = build.load_or_fit(documents(spark, ["never read"]), path, 512)
    assert Pieces.of(reused) == Pieces.of(fitted)
    with pytest.raises(ValueError, match="512 pieces, 400"):
        build.load_or_fit(documents(spark, ["never read"]), path, 400)
    wrong = fitted.withColumn("id", F.when(F.col("id") == 3, 2).when(F.col("id") == 2, 3).otherwise(F.col("id")))
    vocabulary.save(wrong, f"{path}-wrong")
    with pytest.raises(ValueError, match="special ids"):
        vocabulary.load(spark, f"{path}-wrong")


def test_lookup(spark, fitted):
    ids = spark.createDataFrame([(3,), (4,), (9_999,)], "id INT")
    assert {r.id: r.piece for r in vocabulary.lookup(ids, fitted).collect()} == {3: "<eos>", 4: "<0x00>", 9_999: None}
