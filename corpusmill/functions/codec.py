"""Encoding and decoding of text columns with a fitted vocabulary."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusmill.constants import BOS_ID, EOS_ID, FIRST_BYTE_ID, PAD_ID, SPACE_MARK, UNK_ID
from corpusmill.functions.text import normalize_line, text_parts
from corpusmill.functions.wordtable import WordTable, distinct_words, ends_of, gather_lists
from corpusmill.sources.vocabulary import Pieces

MEMO_WORDS = 1 << 18
SHORT_WORD = 256

# Fixed value: how an unknown id reads after decoding.
UNKNOWN_TEXT = " ⁇ "


def merge_parts(parts: list[str], ids: dict[str, int], merge_limit: int) -> list[str]:
    """Join the earliest-learned adjacent pieces, leftmost first, until none is left."""
    ranks = [ids.get(a + b, merge_limit) for a, b in zip(parts, parts[1:])]
    while ranks:
        best = min(ranks)
        if best >= merge_limit:
            break
        at = ranks.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        if at > 0:
            ranks[at - 1] = ids.get(parts[at - 1] + parts[at], merge_limit)
        if at < len(ranks):
            ranks[at] = ids.get(parts[at] + parts[at + 1], merge_limit)
    return parts


def merge_long(parts: list[str], ids: dict[str, int], merge_limit: int) -> list[str]:
    """The same for very long words, with a heap instead of a scan per merge."""
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, str, str]] = []

    def offer(at: int) -> None:
        if 0 <= at and after[at] < len(parts):
            rank = ids.get(parts[at] + parts[after[at]], merge_limit)
            if rank < merge_limit:
                heapq.heappush(heap, (rank, at, parts[at], parts[after[at]]))

    for at in range(len(parts)):
        offer(at)
    while heap:
        _, at, left, right = heapq.heappop(heap)
        joined = after[at]
        if joined >= len(parts) or parts[at] != left or parts[joined] != right:
            continue
        parts[at], parts[joined] = left + right, ""
        after[at] = after[joined]
        if after[at] < len(parts):
            before[after[at]] = at
        offer(at)
        offer(before[at])
    return [p for p in parts if p]


def merge_word(word: str, ids: dict[str, int], merge_limit: int) -> list[int]:
    """Ids of one word; characters outside the vocabulary become their bytes."""
    merge = merge_parts if len(word) <= SHORT_WORD else merge_long
    result: list[int] = []
    for part in merge(list(word), ids, merge_limit):
        known = ids.get(part)
        if known is None:
            result.extend(FIRST_BYTE_ID + b for b in part.encode("utf-8"))
        else:
            result.append(known)
    return result


def _one_line_each(texts: pa.Array) -> pa.Array:
    """Normalized lines; printable ASCII is normal but for its spaces, which the split drops."""
    texts = pc.fill_null(texts, "")
    odd = pc.invert(pc.match_substring_regex(texts, "^[ -~]*$"))
    if not pc.any(odd).as_py():
        return texts
    normal = [normalize_line(t) for t in texts.filter(odd).to_pylist()]
    return pc.replace_with_mask(texts, odd, pa.array(normal, texts.type))


class WordEncoder:
    """Ids of text batches: each distinct word is merged once and gathered from one table."""

    def __init__(self, pieces: tuple[str, ...], kinds: tuple[str, ...]):
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k in ("merge", "char")}
        self.merge_limit = next((i for i, k in enumerate(kinds) if k == "char"), len(pieces))
        self.table = WordTable(pa.string(), np.dtype(np.int32))

    def _learn(self, words: pa.Array) -> None:
        ids = [merge_word(SPACE_MARK + w, self.ids, self.merge_limit) if w else [] for w in words.to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.table.add(words, ends_of(lengths), np.fromiter(chain.from_iterable(ids), np.int32))

    def lists(self, texts: pa.Array) -> pa.ListArray:
        split = pc.split_pattern(_one_line_each(texts.cast(pa.string())), " ")
        distinct, codes = distinct_words(split)
        at = self.table.find(distinct)
        new = np.flatnonzero(at < 0)
        if len(self.table) + len(new) > MEMO_WORDS:
            used = np.flatnonzero(at >= 0)
            self.table.keep(at[used])
            at[used] = np.arange(len(used))
        at[new] = len(self.table) + np.arange(len(new))
        self._learn(distinct.take(pa.array(new)))
        offsets, values = gather_lists(split, at, codes, self.table)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def encode(text: Column, vocab: Pieces, add_bos: bool = False, add_eos: bool = False) -> Column:
    """``ARRAY<INT>`` of token ids; '' gives no ids besides the requested markers.

    Text is normalized and cut at spaces, which no merge crosses. A batch is split and
    dictionary-encoded as a whole, so each distinct word is looked up once per batch and merged
    once per task.
    """
    pieces, kinds = vocab.pieces, vocab.kinds

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = WordEncoder(pieces, kinds)
        for texts in text_parts(batches):
            yield encoder.lists(texts)

    encoded = encode_batches(text)
    if not (add_bos or add_eos):
        return encoded
    lead = [F.array(F.lit(BOS_ID))] if add_bos else []
    tail = [F.array(F.lit(EOS_ID))] if add_eos else []
    return F.concat(*lead, encoded, *tail)


def _piece_bytes(piece: str, kind: str, at: int) -> bytes:
    if at == UNK_ID:
        return UNKNOWN_TEXT.encode("utf-8")
    if kind == "special":
        return b""
    if kind == "byte":
        return bytes([at - FIRST_BYTE_ID])
    return piece.replace(SPACE_MARK, " ").encode("utf-8")


def decode(ids: Column, vocab: Pieces, skip_special: bool = True) -> Column:
    """Text of token ids, natively: every piece is hex in one literal array."""
    rows = enumerate(zip(vocab.pieces, vocab.kinds))
    table = ",".join(_piece_bytes(p, k, i).hex() for i, (p, k) in rows)
    by_id = F.split(F.lit(table), ",")
    if skip_special:
        ids = F.filter(ids, lambda t: ~t.isin(PAD_ID, BOS_ID, EOS_ID))
    hexes = F.array_join(F.transform(ids, lambda t: F.element_at(by_id, t + 1)), "")
    return F.regexp_replace(F.make_valid_utf8(F.unhex(hexes).cast("string")), "^ ", "")
