"""Rule-based quality filter: a threshold table compiled into one Spark projection.

``measures`` turns a text into counts, ``RULES`` bounds ratios of those counts, and
``verdict`` folds the table into one boolean expression. Everything is a column function on
one row: no shuffle, no user function, and a text of any length stays in its row.

Defined results: a null text counts as empty. An empty or blank text has no words and fails
the base rule, hence is not kept. Ties and repeated rows are judged one by one. Other columns
of the input are carried through or ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

# The most frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for was on are with as it be by he at from an "
    "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au plus pas "
    "de la que el en y a los del se las por un para con no una su al lo es"
).split()


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie in [low, high]; an open end is None.

    ``slack`` is added to the numerator before the lower test, so that short texts pass it.
    """

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    slack: int = 0

    def passed(self, row: Column) -> Column:
        top, bottom = row.getField(self.numerator), row.getField(self.denominator)
        tests = []
        if self.low is not None:
            tests.append(top + self.slack >= F.lit(self.low) * bottom)
        if self.high is not None:
            tests.append(top <= F.lit(self.high) * bottom)
        passed = tests[0]
        for test in tests[1:]:
            passed = passed & test
        return passed


RULES = (
    Rule("mean word length", "word_chars", "n_words", 1.5, 25.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.25),
    Rule("stop words per word", "n_stop_words", "n_words", 0.05, None, slack=1),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
)
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column, so that a lambda that looks into it does not compute it again."""
    return df.withColumn(name, value)


def _window_hashes(df: DataFrame, window: int) -> DataFrame:
    """Adds ``_windows``: a 64-bit hash for each window of words, in order; null if too short."""
    df = _bound(df, "_each", F.transform("_words", lambda w: F.xxhash64(w)))
    count = F.size("_words") - F.lit(window - 1)

    def joined(first: Column, at: Column) -> Column:
        return F.xxhash64(first, *[F.get(F.col("_each"), at + k) for k in range(1, window)])

    starts = F.slice("_each", F.lit(1), F.greatest(count, F.lit(1)))
    return _bound(df, "_windows", F.when(count > 0, F.transform(starts, joined))).drop("_each")


def _covered_words(df: DataFrame, window: int) -> DataFrame:
    """Adds ``_covered``: words in windows whose hash occurs twice or more."""
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _bound(df, "_placed", F.when(twice, placed))

    def met(x: Column, i: Column) -> Column:
        own = x.getField("h")
        near = [F.get(F.col("_placed"), at).getField("h") for at in (i - 1, i + 1)]
        return own.eqNullSafe(near[0]) | own.eqNullSafe(near[1])

    starts = F.sort_array(F.transform(F.filter("_placed", met), lambda x: x.getField("i")))
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state: Column, at: Column) -> Column:
        fresh = F.least(F.lit(window), at + window - state.getField("end"))
        return F.struct((at + window).alias("end"), (state.getField("n") + fresh).alias("n"))

    covered = F.aggregate(starts, nothing, add, lambda state: state.getField("n"))
    return _bound(df, "_covered", F.coalesce(covered, F.lit(0))).drop("_placed", "_windows")


def measures(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with one more column ``_measures``, a struct of n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, n_stop_words (all long)."""
    if "_measures" in docs.columns:
        raise ValueError("the input already has a column _measures")
    # The input's columns travel in one struct, so none can clash with a working column.
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[f"`{text}`"].alias("_text"))
    shown = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(shown, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    split = _bound(_bound(packed, "_words", words(F.col("_text"))), "_lines", lines)
    covered = _covered_words(_window_hashes(split, window), window)
    # Spellings instead of a lower-case copy of each word.
    stop = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": F.char_length(shown) - F.char_length(F.regexp_replace(shown, SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("_covered"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stop))),
    }
    counted = F.struct(*[c.cast("bigint").alias(name) for name, c in counts.items()])
    # One generated row each: a filter on the counts is not moved below this, where it would
    # have to compute them again, once for each element that a lambda looks at.
    return covered.select("_row", F.explode(F.array(counted)).alias("_measures")).select("_row.*", "_measures")


def base_failed(row: Column) -> Column:
    """Too short, or too large a share of the words in repeated windows."""
    n = row.getField("n_words")
    return (n < MIN_WORDS) | (100 * row.getField("n_repeat_words") > MAX_REPEATED_PERCENT * n)


def verdict(row: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where the base rule and every rule of the table pass."""
    kept = ~base_failed(row)
    for rule in rules:
        kept = kept & rule.passed(row)
    return kept


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``_measures`` and ``_kept``."""
    if "_kept" in docs.columns:
        raise ValueError("the input already has a column _kept")
    measured = measures(docs, text)
    return measured.withColumn("_kept", verdict(F.col("_measures"), rules))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{text}`"].alias("text"))
    return judge(packed, "text", rules).where("_kept").select("row.*")
