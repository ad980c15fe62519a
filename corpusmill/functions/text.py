"""Unicode whitespace handling as native column expressions."""

from __future__ import annotations

import ctypes
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The code points Python's str.strip and str.split treat as whitespace.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class. The inner range lets most letters skip the long list.
_WS_BODY = (
    r"\t-\r\x1c-\x20"
    r"[\x85-\u3000&&[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WS = f"[{_WS_BODY}]"
NON_WS = f"[^{_WS_BODY}]"

# Control characters the normalization rule deletes.
DELETED_CONTROLS = r"[\x00-\x08\x0b\x0e-\x1f\x7f\x8f\x9f]"
# Characters the rule turns into a space, beyond those NFKC already does.
SPACE_LIKE = "\t\n\x0c\r\u061c\u1680\u200b\u200c\u200e\u200f\u2028\u2029\u2581\ufeff\ufffd"
# Fixed value: the one character the rule leaves alone although NFKC would change it.
KEPT_AS_IS = "\uff5e"
# Workers take whole texts in parts of about this size.
BYTES_AT_ONCE = 2 << 20


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def has_words(text: Column, n: int) -> Column:
    """Whether stripped ``text`` has at least ``n`` words; stops reading at the n-th."""
    if n <= 1:
        return text != ""
    return text.rlike(f"^(?:{NON_WS}++{WS}++){{{n - 1}}}{NON_WS}")


def words(text: Column) -> Column:
    """The whitespace-separated words of stripped ``text``; no words for ''."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"{WS}+"))


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, f"{WS}+")))


def flatten(text: Column) -> Column:
    """One line: words joined by single spaces."""
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


_DELETED = re.compile(DELETED_CONTROLS)
_SPACED = re.compile(f"[{SPACE_LIKE}]")


def normalize_line(text: str) -> str:
    """Compatibility-normalize one string, drop controls and collapse spaces."""
    text = _SPACED.sub(" ", _DELETED.sub("", text))
    if not text.isascii():
        text = KEPT_AS_IS.join(unicodedata.normalize("NFKC", part) for part in text.split(KEPT_AS_IS))
    return " ".join(part for part in text.split(" ") if part)


def text_parts(batches: Iterator[pa.Array], most: int = BYTES_AT_ONCE) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes of text, one row at least; what they leave free goes back to the system."""
    for texts in batches:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield texts.slice(a, b - a)
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


@F.arrow_udf(StringType())
def _normalize_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in text_parts(batches):
        yield pa.array([None if t is None else normalize_line(t) for t in texts.to_pylist()], pa.string())


def normalize(text: Column) -> Column:
    """Unicode normalization of whole strings.

    Plain printable ASCII needs only its spaces collapsed, which stays native; such
    rows reach the Python worker as nulls.
    """
    plain = is_ascii(text) & ~text.rlike(r"[\x00-\x1f\x7f]")
    collapsed = F.btrim(F.regexp_replace(text, " {2,}", " "))
    return F.coalesce(_normalize_batches(F.when(~plain, text)), collapsed)
