"""Chat formatting into token-budgeted, turn-aligned windows with loss masks.

Prefix sums of turn tokens place each turn: the budget, less the system turn and the history
allowance, is the stride, and a turn belongs to the window its first token falls in. A turn
that runs over the end of its stride and would break the budget gets a window of its own.
Every window starts with the conversation's leading system turn, then repeats as many whole
earlier turns as the history allowance and the rest of the budget hold, then adds its own turns. Only assistant texts
among its own turns are under the loss mask, so each is a target once in all windows.

The template writes ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line
break. Control strings inside a text cannot be taken for marks: one backslash is put between
``<`` (with any backslashes) and ``|``, and taken out again on reading, which is a bijection. Roles
use percent escapes for ``%``, ``<`` and line breaks.

Everything is column functions and windows per conversation. Tokens are counted as runs of
letters or digits plus single other signs plus ``TURN_TOKENS`` for the marks, without a tokenizer.

Defined results: a null text or role is empty; turns with null or equal numbers are ordered by
number (nulls first), role and text, so repeated rows are repeated turns; rows with a null
conversation id form one conversation. A turn longer than the budget is never cut: it is alone
with the system turn, over budget. An empty table gives no windows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1_024
HISTORY = 256
TURN_TOKENS = 4
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place, escaped parts, token counts and prefix sums (``before``).

    A leading system turn has place 0 and no tokens of its own: each window pays for it.
    """
    shown = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = shown.withColumn("place", F.row_number().over(order) - 1)
    tokens = (F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("bigint")
    leads = (F.col("place") == 0) & (F.col("role") == "system")
    counted = placed.withColumn("leads", leads).withColumn("own_tokens", tokens)
    paid = F.when(F.col("leads"), 0).otherwise(F.col("own_tokens"))
    by_place = Window.partitionBy("conv_id").orderBy("place")
    whole = Window.partitionBy("conv_id")
    return (
        counted.withColumn("tokens", paid.cast("bigint"))
        .withColumn("before", F.sum("tokens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .withColumn("system_tokens", F.max(F.when(F.col("leads"), F.col("own_tokens")).otherwise(0)).over(whole))
        .withColumn("n_turns", F.count(F.lit(1)).over(whole))
        .withColumn("piece", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n")))
        .withColumn("skip", F.char_length(F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))))
        .withColumn("kept_chars", F.char_length(escape(F.col("text"))))
        .drop("text")
    )


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows: (conv_id, window, n_turns, text, n_repeated, loss, tokens).

    ``n_repeated`` turns at the start of the window are the system turn and history; ``loss``
    lists (start, length) in code points of ``text``.
    """
    placed = numbered(turns)
    stride = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(1))
    room = F.lit(budget) - F.col("system_tokens")
    by_window = Window.partitionBy("conv_id", "span")
    # Turns that begin in the allowance before this one; turn marks cost tokens, so sums are strict.
    back = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1)
    spans = (
        placed.withColumn("span", F.when(F.col("leads"), F.lit(0)).otherwise(F.floor(F.col("before") / stride)).cast("bigint"))
        .withColumn("fresh", F.sum("tokens").over(by_window))
        .withColumn("over", (F.col("before") + F.col("tokens") > (F.col("span") + 1) * stride) & (F.col("fresh") > room))
        .withColumn("over", F.col("over") & ~F.col("leads"))
        .withColumn("n_back", F.count(F.when(~F.col("leads"), 1)).over(back))
    )
    grouped = spans.groupBy("conv_id", "span", "over").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("system_tokens").alias("system_tokens"),
        F.sum("tokens").alias("fresh"),
        F.min(F.when(~F.col("leads"), F.struct("place", "before", "n_back"))).alias("first"),
        F.sort_array(F.collect_list(F.struct("place", "piece", "skip", "kept_chars", "role", "leads"))).alias("own"),
    )
    numbered_windows = grouped.withColumn("window", F.row_number().over(Window.partitionBy("conv_id").orderBy("span", "over")) - 1)
    # History: of the turns [first - n_back, first) those that fit what the window has left, met by equality on single places.
    left = F.least(F.lit(history), F.lit(budget) - F.col("system_tokens") - F.col("fresh"))
    wanted = F.when((left > 0) & (F.col("first.n_back") > 0), F.sequence(F.col("first.place") - F.col("first.n_back"), F.col("first.place") - 1))
    asked = numbered_windows.select(
        F.col("conv_id").alias("c"), "window", F.col("first.before").alias("at"), left.alias("left"), F.explode(wanted).alias("p")
    )
    earlier = placed.where(~F.col("leads")).select("conv_id", "place", "piece", "before")
    fits = F.col("at") - F.col("before") <= F.col("left")
    met = asked.join(earlier, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("place")) & fits)
    repeated = met.groupBy("c", "window").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("history"))
    system = placed.where("leads").select(F.col("conv_id").alias("s"), F.col("piece").alias("system"))
    joined = (
        numbered_windows.join(repeated.withColumnRenamed("window", "w"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")), "left")
        .join(system, F.col("conv_id").eqNullSafe(F.col("s")), "left")
        .withColumn("fresh_turns", F.filter("own", lambda t: ~t.getField("leads")))
    )
    none = F.array().cast("array<string>")
    old = F.coalesce(F.transform("history", lambda t: t.getField("piece")), none)
    head = F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(none), old)
    bound = joined.withColumn("head", head).withColumn("head_text", F.array_join("head", ""))
    first = F.struct(F.char_length("head_text").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def add(state: Column, turn: Column) -> Column:
        span = F.struct((state.getField("at") + turn.getField("skip")).alias("start"), turn.getField("kept_chars").alias("length"))
        extended = F.when(turn.getField("role") == "assistant", F.concat(state.getField("loss"), F.array(span))).otherwise(state.getField("loss"))
        return F.struct((state.getField("at") + F.char_length(turn.getField("piece"))).alias("at"), extended.alias("loss"))

    fresh_text = F.array_join(F.transform("fresh_turns", lambda t: t.getField("piece")), "")
    return bound.select(
        "conv_id",
        "window",
        "n_turns",
        F.concat("head_text", fresh_text).alias("text"),
        F.size("head").alias("n_repeated"),
        F.aggregate("fresh_turns", first, add, lambda s: s.getField("loss")).alias("loss"),
        (F.col("system_tokens") + F.col("fresh")).alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars) from the windows' texts and masks alone.

    ``turns`` are (role, text) in order; the system turn is taken from the first window.
    """
    pieces = F.slice(F.split("text", r"<\|im_start\|>"), 2, 1 << 30)
    taken = formatted.withColumn("pieces", pieces).withColumn(
        # Before the first window there is no history: what it repeats is the system turn.
        "fresh",
        F.when(F.col("window") == 0, F.col("pieces")).otherwise(F.slice("pieces", F.col("n_repeated") + 1, F.lit(1 << 30))),
    )

    def parsed(piece: Column) -> Column:
        at = F.instr(piece, F.lit("\n"))
        body = F.substring(piece, at + 1, F.char_length(piece) - at - len(END) - 1)
        return F.struct(unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    marked = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s.getField("start") + 1, s.getField("length"))))
    rows = taken.select(
        "conv_id", "window", F.transform("fresh", parsed).alias("turns"), F.array_join(marked, "").alias("marked"), F.char_length("text").cast("bigint").alias("chars")
    )
    in_order = F.sort_array(F.collect_list(F.struct("window", "turns", "marked")))
    whole = rows.groupBy("conv_id").agg(in_order.alias("all"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("all", lambda w: w.getField("turns")))
    return whole.select(
        "conv_id",
        F.size(turns).cast("bigint").alias("n_turns"),
        turns.alias("turns"),
        F.array_join(F.transform("all", lambda w: w.getField("marked")), "").alias("loss_text"),
        "formatted_chars",
    )


def digest(read: DataFrame) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
