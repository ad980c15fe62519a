"""Fitting a byte-pair vocabulary with Spark jobs.

The word histogram is the only large table. Pair counts are kept from round to round: a round
takes the best-ranked pairs to the driver, chooses several merges whose outcome equals merging
one pair at a time, and finds the stretches that hold a merged pair. Only those are counted,
before and after the merges, and the difference is added to the counts.

A stretch of text is a string with one character per symbol. A merged piece gets a character of
its own from the private planes, so a pair is a string of two characters and a merge a replace.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.constants import (
    CHARACTER_COVERAGE,
    FIRST_MERGE_ID,
    MAX_PIECE_CHARS,
    MIN_VOCAB_SIZE,
    SEED,
    SPACE_MARK,
    VOCAB_SIZE,
)
from corpusmill.functions import text as tx
from corpusmill.functions.hashing import seeded_hash
from corpusmill.operators.order import hash_sample
from corpusmill.session import materialize
from corpusmill.sources import vocabulary

# Control characters cannot occur in normalized text.
FOREIGN, NEXT, NEVER = "\x04", "\x05", "\x06\x06"
RANKED_PAIRS = 1_000
ROUNDS_PENDING, MERGES_PENDING, STEP = 4, 48, 8
STRETCHES_PER_TASK = 40_000
# The first character that can stand for a merged piece.
FIRST_SIGN = 0xF0000

# Unicode scripts that a piece must not mix. Han takes in the Japanese kana.
SCRIPTS = (
    "Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Gurmukhi",
    "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao",
    "Tibetan", "Myanmar", "Georgian", "Armenian", "Hangul", "Ethiopic", "Khmer", "Mongolian",
    "Cherokee", "Syriac", "Thaana", "Bopomofo", "Yi",
)


def sample_lines(
    docs: DataFrame,
    sample_documents: int | None = None,
    max_bytes: int | None = None,
    input_sentences: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Lines to fit on: all accepted documents, flattened.

    ``docs`` has doc_id, ordinal and text. Each limit is off unless it is given: the first
    ``sample_documents`` documents, lines of at most ``max_bytes``, and ``input_sentences``
    of those drawn by hash.
    """
    if sample_documents is not None:
        docs = docs.where(F.col("ordinal") < sample_documents)
    flat = docs.select("doc_id", tx.flatten(F.col("text")).alias("line"))
    lines = flat.where(F.col("line") != "")
    if max_bytes is not None:
        lines = lines.where(F.octet_length("line") <= max_bytes)
    if input_sentences is None:
        return lines
    return hash_sample(lines, seeded_hash(F.lit(seed), F.col("doc_id")), ["doc_id"], input_sentences)


def word_histogram(lines: DataFrame, line: str = "line") -> DataFrame:
    """Occurrences of every space-separated word."""
    each = lines.select(F.explode(F.split(line, " ")).alias("word")).where(F.col("word") != "")
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def normalize_words(histogram: DataFrame) -> DataFrame:
    """Normalize distinct words instead of every occurrence, then add up what fell together."""
    normal = histogram.select(tx.normalize(F.col("word")).alias("word"), "freq")
    return (
        normal.select(F.explode(F.split("word", " ")).alias("word"), "freq")
        .where(F.col("word") != "")
        .groupBy("word")
        .agg(F.sum("freq").alias("freq"))
    )


def char_histogram(words: DataFrame) -> DataFrame:
    """Occurrences of every character, the word mark included."""
    chars = words.select(F.explode(F.split(F.concat(F.lit(SPACE_MARK), "word"), "")).alias("char"), "freq")
    return chars.where(F.col("char") != "").groupBy("char").agg(F.sum("freq").alias("freq"))


def alphabet(chars: DataFrame, coverage: float = CHARACTER_COVERAGE) -> DataFrame:
    """The most frequent characters until they cover ``coverage`` of all occurrences.

    The running total covers at most one row per Unicode code point.
    """
    ranked = Window.orderBy(F.desc("freq"), "char")
    before = F.coalesce(F.sum("freq").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("freq").over(Window.partitionBy())
    placed = chars.select(
        "char", "freq", (F.row_number().over(ranked) - 1).alias("rank"),
        (before / total).cast("float").alias("_before"),
    )
    return placed.where(F.col("_before") < F.lit(coverage).cast("float")).drop("_before")


def _run_pattern() -> str:
    """Longest stretches one piece could span: a single script, the word mark in front."""
    classes = [rf"\p{{Is{s}}}" for s in SCRIPTS]
    kana = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
    common = r"[\p{IsCommon}&&[^ー]]"
    named = "".join(classes) + kana + r"\p{IsCommon}"
    bodies = [*(f"[{c}\\p{{IsInherited}}]+" for c in (*classes, kana, common)), f"[^{named}]+"]
    return f"{SPACE_MARK}?(?:{'|'.join(bodies)})|{SPACE_MARK}"


def as_symbols(words: DataFrame, letters: list[str]) -> DataFrame:
    """The stretches within which merging can happen, with one character per symbol.

    A piece never mixes scripts nor holds characters outside the alphabet, so words are cut
    there once. The stretches are fewer and shorter than the words.
    """
    # \x{...} names a code point, so no letter can act as regex syntax.
    inside = "".join(f"\\x{{{ord(c):X}}}" for c in letters)
    marked = F.concat(F.lit(SPACE_MARK), "word")
    native = F.explode(F.split(F.regexp_replace(marked, f"[^{inside}]+", FOREIGN), FOREIGN))
    native_words = words.select(native.alias("word"), "freq")
    runs = F.explode(F.regexp_extract_all("word", F.lit(_run_pattern()), F.lit(0)))
    counted = native_words.select(runs.alias("symbols"), "freq").where(F.char_length("symbols") > 1)
    return counted.groupBy("symbols").agg(F.sum("freq").alias("freq"))


def _pairs(text: Column) -> Column:
    """All neighbouring symbols of a stretch; none for a whole one."""
    starts = F.when(F.char_length(text) > 1, F.sequence(F.lit(1), F.char_length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(2)))


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, freq): neighbouring symbols with the summed frequency of the stretches they occur in."""
    return words.select(F.explode(_pairs(F.col("symbols"))).alias("pair"), "freq").groupBy("pair").agg(F.sum("freq").alias("freq"))


def symbol_pairs(words: DataFrame) -> DataFrame:
    """Adjacent symbols with the summed frequency of the words they occur in."""
    return pair_counts(words).select(
        F.substring("pair", 1, 1).alias("l"), F.substring("pair", 2, 1).alias("r"), "freq"
    )


class Signs:
    """The characters that stand for merged pieces, and the piece of each."""

    def __init__(self, taken: set[str] = frozenset()):
        self.taken, self.pieces = taken, []

    @classmethod
    def beside(cls, words: DataFrame) -> Signs:
        """Signs that no stretch holds as a letter; private characters of a corpus are few."""
        private = words.where(F.col("symbols").rlike(r"[\x{F0000}-\x{10FFFF}]"))
        chars = private.select(F.explode(F.split("symbols", "")).alias("char")).where(F.ascii("char") >= FIRST_SIGN)
        return cls({r.char for r in chars.distinct().collect()})

    def add(self, piece: str) -> str:
        while (sign := chr(FIRST_SIGN + len(self.pieces))) in self.taken:
            self.pieces.append(sign)
        self.pieces.append(piece)
        return sign

    def text(self, symbol: Column) -> Column:
        """The piece a symbol stands for."""
        if not self.pieces:
            return symbol
        # Constant folding turns the text into one literal array.
        named = F.get(F.split(F.lit(NEXT.join(self.pieces)), NEXT), F.ascii(symbol) - FIRST_SIGN)
        return F.when(F.ascii(symbol) >= FIRST_SIGN, named).otherwise(symbol)

    def named(self, counts: DataFrame) -> DataFrame:
        """``counts`` with the pieces of each pair."""
        left, right = (self.text(F.substring("pair", at, 1)) for at in (1, 2))
        return counts.select("pair", "freq", left.alias("l"), right.alias("r"), F.concat(left, right).alias("piece"))


def ranked_pairs(pairs: DataFrame, limit: int = RANKED_PAIRS) -> list:
    """The best pairs: most frequent, then shortest, then first in code-point order."""
    # Naming freq keeps the test above the aggregation, on distinct pairs.
    short = F.when(F.col("freq") > 0, F.char_length("piece") <= MAX_PIECE_CHARS)
    order = [F.desc("freq"), F.char_length("piece"), F.col("piece"), F.col("l")]
    return pairs.where(short).orderBy(*order).limit(limit).collect()


def independent_merges(ranked: list, learned: set[str], limit: int = RANKED_PAIRS) -> list:
    """The longest safe run of merges from the top of the ranking.

    Merging (a, b) only changes pairs that end in a or begin with b. A pair made by the
    merge is no more frequent than one of those was before. So the ranking stays true down
    to the first pair that touches an earlier one in this way; that pair's frequency bounds
    everything new, and merges above the bound are final. A pair whose text was learned
    before is never merged, yet it can bound others.
    """
    lefts, rights, chosen, new = set(), set(), [], set()
    bound = ranked[-1].freq if len(ranked) == limit else 0
    for pair in ranked:
        repeat = pair.piece in learned or pair.piece in new
        if not repeat and (pair.l == pair.r or pair.l in rights or pair.r in lefts):
            if not chosen:
                return [pair]
            bound = pair.freq
            break
        lefts.add(pair.l)
        rights.add(pair.r)
        if not repeat:
            chosen.append(pair)
            new.add(pair.piece)
    final = [pair for pair in chosen if pair.freq > bound]
    return final or chosen[:1]


class Merge(NamedTuple):
    """Both symbols of ``pair`` become ``sign``, which stands for ``piece``."""

    pair: str
    sign: str
    piece: str


def _literals(texts: list[str]) -> Column:
    """One literal array; constant folding builds it once, and the code is the same for any number."""
    return F.split(F.lit(NEXT.join(texts)), NEXT) if texts else F.array().cast("array<string>")


def _padded(items: list, filler: object) -> list:
    """Filled up to a multiple of ``STEP``, so that the generated code of many rounds is the same."""
    return [*items, *[filler] * (-len(items) % STEP)]


def apply_merges(text: Column, merges: list[Merge]) -> Column:
    """Join pairs left to right, in learned order."""
    for m in _padded(merges, Merge(NEVER, NEVER, NEVER)):
        text = F.replace(text, F.lit(m.pair), F.lit(m.sign))
    return text


def holds_any(text: Column, pairs: list[str]) -> Column:
    """Whether a stretch holds any of the pairs."""
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in _padded(pairs, NEVER)])


class PairState:
    """Stretches and pair counts as of ``base`` merges, and the merges learned since.

    A round counts only the stretches that hold a pair merged since, before and after, and adds
    the difference to the kept counts. The stretches themselves are only searched for those
    pairs, a scan of short strings without a shuffle. Both tables are written anew after a few
    rounds, the counts from the kept ones and the difference, never from all stretches.
    """

    def __init__(self, words: DataFrame, signs: Signs):
        self.merges: list[Merge] = []
        self.base = self.rounds = 0
        self.signs = signs
        self.words = words
        self.counts = materialize(pair_counts(words), "pair-counts")

    def changed(self) -> DataFrame:
        """(symbols, freq) as of ``base`` of the stretches that a pending merge changes."""
        new = {m.sign for m in self.merges[self.base :]}
        pairs = [m.pair for m in self.merges[self.base :] if not new.intersection(m.pair)]
        return self.words.where(holds_any(F.col("symbols"), pairs))

    def pairs(self) -> DataFrame:
        """(pair, freq) after all merges: the kept counts and what the pending merges changed."""
        pending = self.merges[self.base :]
        if not pending:
            return self.counts
        before, freq = F.col("symbols"), F.col("freq")
        gone = F.transform(_pairs(before), lambda p: F.struct(p.alias("pair"), (-freq).alias("freq")))
        come = F.transform(_pairs(F.col("after")), lambda p: F.struct(p.alias("pair"), freq.alias("freq")))
        moved = self.changed().withColumn("after", apply_merges(before, pending))
        delta = moved.select(F.inline(F.concat(gone, come)))
        total = self.counts.unionByName(delta).groupBy("pair").agg(F.sum("freq").alias("freq"))
        return total.where(F.col("freq") > 0)

    def best(self, learned: set[str], limit: int) -> list:
        return best_merges(self.signs.named(self.pairs()), learned, limit)

    def add(self, ranked: list) -> None:
        self.merges += [Merge(p.pair, self.signs.add(p.piece), p.piece) for p in ranked]
        self.rounds += 1
        if self.rounds >= ROUNDS_PENDING or len(self.merges) - self.base >= MERGES_PENDING:
            self._settle()

    def _settle(self) -> None:
        """Make the pending merges part of both tables."""
        self.counts = materialize(self.pairs(), "pair-counts")
        merged = apply_merges(F.col("symbols"), self.merges[self.base :])
        left = self.words.select(merged.alias("symbols"), "freq").where(F.char_length("symbols") > 1)
        self.words = materialize(left, "stretches")
        self.base, self.rounds = len(self.merges), 0


def passing_pieces(words: DataFrame, merges: list[Merge], signs: Signs, learned: set[str], count: int) -> list[str]:
    """Pieces of pairs that stood side by side at some time but were never merged.

    Once no pair is left, greedy merging goes on with pairs of frequency zero, shortest
    first. Here the merges are replayed one by one on every word to find them; that happens
    only for texts too small for the wanted vocabulary.
    """

    def replay(state: Column, m: Column) -> Column:
        text = F.replace(state["text"], m["pair"], m["sign"])
        seen = F.when(text == state["text"], state["seen"]).otherwise(F.array_union(state["seen"], _pairs(text)))
        return F.struct(text.alias("text"), seen.alias("seen"))

    start = F.struct(F.col("symbols").alias("text"), _pairs(F.col("symbols")).alias("seen"))
    steps = F.arrays_zip(_literals([m.pair for m in merges]).alias("pair"), _literals([m.sign for m in merges]).alias("sign"))
    seen = F.aggregate(steps, start, replay)["seen"] if merges else start["seen"]
    pairs = words.select(F.explode(seen).alias("pair")).distinct().withColumn("freq", F.lit(0))
    pieces = signs.named(pairs).select("piece").distinct()
    fitting = pieces.where(F.char_length("piece") <= MAX_PIECE_CHARS)
    best = fitting.orderBy(F.char_length("piece"), "piece").limit(len(learned) + count).collect()
    return [r.piece for r in best if r.piece not in learned][:count]


def best_merges(pairs: DataFrame, learned: set[str], limit: int) -> list:
    """The next safe merges; the ranking is read deeper while it shows nothing but repeats."""
    while True:
        ranked = ranked_pairs(pairs, limit)
        fresh = independent_merges(ranked, learned, limit) if ranked else []
        if fresh or len(ranked) < limit:
            return fresh
        limit *= 4


def _store(words: DataFrame) -> DataFrame:
    """Write the stretches in as many parts as their number deserves."""
    written = materialize(words, "stretches")
    parallel = words.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, written.count() // STRETCHES_PER_TASK)
    # Every round reads the parts. A large input keeps those it came in.
    return materialize(written.repartition(tasks), "stretches") if tasks <= parallel else written


def learn_merges(words: DataFrame, count: int, ranked: int = RANKED_PAIRS) -> list[str]:
    """``count`` merged pieces in the order greedy merging finds them."""
    learned: set[str] = set()
    start = _store(words)
    signs = Signs.beside(start)
    state = PairState(start, signs)
    while len(state.merges) < count:
        fresh = state.best(learned, ranked)[: count - len(state.merges)]
        if not fresh:
            break
        learned.update(p.piece for p in fresh)
        state.add(fresh)
    pieces = [m.piece for m in state.merges]
    if len(pieces) < count:
        pieces += passing_pieces(start, state.merges, signs, learned, count - len(pieces))
    if len(pieces) < count:
        raise ValueError(f"the text supports only {len(pieces)} merges, {count} are needed")
    return pieces


def fit(
    docs: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    coverage: float = CHARACTER_COVERAGE,
    sample_documents: int | None = None,
    max_bytes: int | None = None,
    input_sentences: int | None = None,
) -> DataFrame:
    """A vocabulary of exactly ``vocab_size`` pieces from numbered documents, by default all of them."""
    if vocab_size < MIN_VOCAB_SIZE:
        raise ValueError(f"{vocab_size} pieces cannot hold all bytes and some merges; ask for {MIN_VOCAB_SIZE} or more")
    words = materialize(normalize_words(word_histogram(sample_lines(docs, sample_documents, max_bytes, input_sentences))), "words")
    rows = alphabet(char_histogram(words), coverage).orderBy("rank").limit(vocab_size).collect()
    if not rows:
        raise ValueError("the corpus has no line to learn pieces from")
    letters = [r.char for r in rows]
    wanted = vocab_size - FIRST_MERGE_ID - len(letters)
    if wanted < 0:
        raise ValueError(f"vocab_size={vocab_size} cannot hold {len(letters)} characters")
    merges = learn_merges(as_symbols(words, letters), wanted)
    return vocabulary.layout(docs.sparkSession, merges, letters)
