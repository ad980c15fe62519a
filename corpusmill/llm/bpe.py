"""Token ids of whole texts by a public tokenizer, computed once per distinct word part.

The tokenizer of ``word_bpe_49k.json`` drops white space, lower-cases, and cuts a text into
letter runs, single digits, runs of other signs and a few contractions before it merges
anything. So the ids of a text are those of its words in a row, and the ids of a plain word
are those of its letter, digit and sign parts. Each worker keeps the ids of the words and parts
it has met, up to a bound, in two tables of one buffer each, and asks the library only for new
parts; a batch is split and looked up as a whole. Words with an apostrophe, an
angle bracket, a control character or a character beyond Latin letters are asked for whole.
A part needs only lower case, so the library's merge model is called on it directly.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusmill.functions.wordtable import WordTable, distinct_words, ends_of, gather_lists
from corpusmill.llm.words import worker_state

ID_TYPE = np.dtype("<u4")
MAX_PARTS = 400_000
MAX_WORDS = 400_000

# Latin letters that lower-case to one letter (ASCII, Latin-1, most of Latin Extended-A, as UTF-8).
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf]"
_PART = re.compile(rb"(?:[a-z]|" + _LATIN + rb")+|[0-9]|[^a-z0-9\x80-\xff]+")
_PLAIN = re.compile(rb"(?:[!-&(-;=?-~]|" + _LATIN + rb")+")


# The byte-level spelling: printable Latin-1 stands for itself, other bytes follow from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers; one per Python worker."""

    def __init__(self, path: str, max_parts: int = MAX_PARTS, max_words: int = MAX_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model.tokenize
        self.parts = WordTable(pa.binary(), ID_TYPE)
        self.words = WordTable(pa.string(), ID_TYPE)
        self.max_parts, self.max_words = max_parts, max_words

    @classmethod
    def of(cls, path: str) -> Encoder:
        return worker_state(("bpe", path), lambda: cls(path))

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: bytes) -> list[int]:
        """Ids of one plain part: beyond lower case it needs no normalizing, and it is one piece to the merges."""
        if part.isascii():
            spelled = part.decode("ascii")
        else:
            spelled = part.decode("utf-8").lower().encode("utf-8").decode("latin-1").translate(_SPELLED)
        return [t.id for t in self.merges(spelled)]

    def _known_parts(self, parts: list[bytes], whole: set[bytes]) -> np.ndarray:
        """Positions of the parts in the table, after the library was asked for new ones."""
        keys = pa.array(parts, pa.binary())
        at = self.parts.find(keys)
        new = np.flatnonzero(at < 0)
        if len(self.parts) + len(new) > self.max_parts:
            # Past the bound, what this batch uses stays.
            used = np.flatnonzero(at >= 0)
            self.parts.keep(at[used])
            at[used] = np.arange(len(used))
        if len(new):
            asked = [parts[i] for i in new]
            odd = iter(self._ask([p.decode("utf-8") for p in asked if p in whole]))
            ids = [next(odd) if p in whole else self._part(p) for p in asked]
            at[new] = len(self.parts) + np.arange(len(new))
            flat = np.fromiter(chain.from_iterable(ids), ID_TYPE)
            self.parts.add(keys.take(pa.array(new)), ends_of(np.fromiter(map(len, ids), np.int64, len(ids))), flat)
        return at

    def _learn(self, new: pa.Array) -> None:
        """Puts the ids of each new word into ``words``."""
        place: dict[bytes, int] = {}
        codes, ends, whole = array("i"), array("i", [0]), set()
        plain, cut, place_of = _PLAIN.fullmatch, _PART.findall, place.setdefault
        for word in new.cast(pa.binary()).to_pylist():
            if plain(word):
                codes.extend([place_of(part, len(place)) for part in cut(word)])
            elif word:
                # No plain part holds a sign that makes a word one to be asked for whole.
                whole.add(word)
                codes.append(place_of(word, len(place)))
            ends.append(len(codes))
        at = self._known_parts(list(place), whole)
        offsets, values = self.parts.gather(at[np.asarray(codes, np.int64)])
        self.words.add(new, offsets[np.asarray(ends)], values)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, null as empty, each followed by ``end_id``."""
        lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
        split = pc.ascii_split_whitespace(lowered)
        distinct, codes = distinct_words(split)
        at = self.words.find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.words) + len(new) > self.max_words:
                used = np.flatnonzero(at >= 0)
                self.words.keep(at[used])
                at[used] = np.arange(len(used))
            at[new] = len(self.words) + np.arange(len(new))
            self._learn(distinct.take(pa.array(new)))
        offsets, values = gather_lists(split, at, codes, self.words)
        if end_id is None:
            return offsets, values
        return offsets + np.arange(len(offsets)), np.insert(values, offsets[1:], end_id)

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[bytes]:
        """The ids of each text as bytes."""
        offsets, values = self.encode_column(pa.array(texts, pa.string()), end_id)
        return [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
