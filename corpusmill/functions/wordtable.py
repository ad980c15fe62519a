"""Token ids of distinct words, looked up for whole Arrow batches at once.

A batch is split into words and dictionary-encoded, so each distinct word is looked up once per
batch. The table keeps all ids in one buffer with offsets; the ids of a batch are gathered from
it by index arithmetic, without a Python step per occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ends_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of neighbouring lists of these lengths, a zero in front."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return ends


class WordTable:
    """Words with the ids of each; a word's position is where it was added."""

    def __init__(self, key_type: pa.DataType, id_type: np.dtype):
        self.keys = pa.array([], key_type)
        self.offsets = np.zeros(1, np.int64)
        self.values = np.zeros(0, id_type)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, words: pa.Array) -> np.ndarray:
        """The position of each word, -1 for those not in the table."""
        return pc.fill_null(pc.index_in(words, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, offsets: np.ndarray, values: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, words])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        self.values = np.concatenate([self.values, values.astype(self.values.dtype, copy=False)])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, values): the ids of the words at these positions, one after the other."""
        starts = self.offsets[at]
        lengths = self.offsets[at + 1] - starts
        ends = ends_of(lengths)
        # The step to the source is the same for all ids of one word.
        source = np.repeat((starts - ends[:-1]).astype(np.int32), lengths)
        source += np.arange(ends[-1], dtype=np.int32)
        return ends, self.values[source]

    def keep(self, at: np.ndarray) -> None:
        """Forget all words but those at these positions, which are numbered anew in this order."""
        self.keys = self.keys.take(pa.array(at))
        self.offsets, self.values = self.gather(at)


def gather_lists(split: pa.ListArray, positions: np.ndarray, codes: np.ndarray, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): the ids of each list of ``split``, whose words are ``positions[codes]`` of the table."""
    ends, values = table.gather(positions[codes])
    bounds = split.offsets.to_numpy().astype(np.int64)
    return ends[bounds - bounds[0]], values


def distinct_words(split: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, the code of every word) of an array of lists."""
    coded = split.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
