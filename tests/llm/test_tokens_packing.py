import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import packing, tokens
from corpusmill.llm.bpe import Encoder, default_path

from .data import documents, odd_rows

LIBRARY = Tokenizer.from_file(default_path())


def library_ids(text, end):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_library_on_odd_strings():
    encoder = Encoder(default_path(), max_parts=50, max_words=50)
    rng = random.Random(4)
    signs = ["a", "B", "é", "É", "ß", "İ", "ǅ", "1", "½", "'", "'s", "'RE", "<|endoftext|>", "<|", "́", "​", "\xa0", " ", "\t", "\x0b", "\x1c", "中", "😀", "ﬁ", "_", ".", "ŉ", "×", "ª", "　"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(1_500)]
    for at in range(0, len(made), 7):
        some = made[at : at + 7]
        assert [list(memoryview(b).cast("I")) for b in encoder.encode(some)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("encoding", tokens.ENCODINGS)
def test_token_files_give_back_every_id(spark, path, encoding):
    docs = documents(spark)
    tokens.write(tokens.encode(docs, default_path(), end_id=1), path, encoding=encoding, page_rows=5)
    stored = tokens.read(spark, path)
    rows = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.digest(stored).collect()), key=lambda r: r[1])
    expected, at = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in odd_rows()), key=lambda r: r[0]):
        ids = library_ids(text, 1)
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows == expected
    files = [f for f in stored.inputFiles()]
    column = next(c for f in files if (m := pq.read_metadata(f.removeprefix("file://"))).num_row_groups for c in [m.row_group(0).column(4)])
    assert column.has_offset_index and column.has_column_index
    assert any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary")
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")


def test_token_files_of_nothing(spark, path):
    tokens.write(tokens.encode(documents(spark, []), default_path(), end_id=1), path)
    assert tokens.digest(tokens.read(spark, path)).count() == 0


def test_harmonic_classes_hold_their_pieces():
    rule = packing.Harmonic(4_096)
    for length in [*range(1, 600), *range(600, 9_000, 37), 4_095, 4_096, 4_097, 100_000]:
        cuts = rule.cuts(length)
        assert sum(n for n, _ in cuts) == length
        for n, at in cuts:
            assert 0 < n <= rule.slots[at]
            assert at + 1 == len(rule.slots) or n > rule.slots[at + 1]
    assert rule.cuts(0) == []


def test_packing_places_every_id_once(spark):
    placed = packing.pack(documents(spark), default_path(), end_id=2, capacity=64)
    rows = packing.digest(placed).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    got = defaultdict(int)
    for r in rows:
        got[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    copies = defaultdict(int)
    for doc_id, text, *_ in odd_rows():
        copies[(doc_id, tuple(library_ids(text, 2)))] += 1
    for (doc_id, ids), times in copies.items():
        mine = sorted(k for k in got if k[0] == doc_id)
        at = 0
        for _, start, length, crc, total in mine:
            assert start == at and total == len(ids) and got[(doc_id, start, length, crc, total)] == times
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert sum(r.length for r in rows) > 0.9 * 64 * len(sequences)
    whole = packing.sequences(placed, 64).collect()
    assert {len(r.ids) for r in whole} == {64} and sum(r.n_tokens for r in whole) == sum(r.length for r in rows)


def test_packing_nothing(spark):
    assert packing.pack(documents(spark, []), default_path(), end_id=2).count() == 0
    assert packing.pack(documents(spark, odd_rows()[12:13]), default_path()).count() == 0
