"""Batch encoding by distinct word against merging every word by itself."""

import random

import pyarrow as pa
import pytest

from corpusmill.functions import codec
from corpusmill.functions.text import normalize_line

PIECES = ("<pad>", "<unk>", "<bos>", "<eos>", *map(str, range(256)), "▁a", "th", "the", "▁the", "in", "er", *"▁aehinrt.")
KINDS = ("special",) * 4 + ("byte",) * 256 + ("merge",) * 6 + ("char",) * 9


@pytest.mark.parametrize("memo", [40, 1 << 18])
def test_batches_equal_single_words(monkeypatch, memo):
    monkeypatch.setattr(codec, "MEMO_WORDS", memo)
    rng = random.Random(1)
    signs = ["a", "th", "e", " ", "  ", "\t", "\n", "\x0b", "\x1c", "é", "ﬁ", "\xa0", "　", "～", "İ", "中", "."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(2_000)] + [None, "", " "]
    encoder = codec.WordEncoder(PIECES, KINDS)
    found = [ids for at in range(0, len(texts), 50) for ids in encoder.lists(pa.array(texts[at : at + 50])).to_pylist()]
    for text, ids in zip(texts, found, strict=True):
        words = [w for w in normalize_line(text or "").split(" ") if w]
        assert ids == [i for w in words for i in codec.merge_word(codec.SPACE_MARK + w, encoder.ids, encoder.merge_limit)]
