"""Filtering and choosing among scored next tokens.

Input tables have prompt_id, token_id, logit. A prompt has at most one row per token id,
so every per-prompt window is bounded by the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.constants import BOS_ID
from corpusmill.functions.hashing import seeded_uniform

SUM_DIGITS = 12


def penalize_repeats(candidates: DataFrame, emitted: DataFrame, penalty: float) -> DataFrame:
    """Weaken tokens already generated for the prompt (prompt_id, token_id), each once."""
    if penalty == 1.0:
        return candidates
    once = emitted.select("prompt_id", "token_id").distinct().withColumn("_repeat", F.lit(True))
    weaker = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    joined = candidates.join(once, ["prompt_id", "token_id"], "left")
    return joined.withColumn("logit", F.when(F.col("_repeat"), weaker).otherwise(F.col("logit"))).drop("_repeat")


def temper(candidates: DataFrame, temperature: float) -> DataFrame:
    return candidates.withColumn("logit", F.col("logit") / F.lit(float(temperature)))


def top_k(candidates: DataFrame, k: int | None) -> DataFrame:
    """Keep scores not below the k-th best; ties at that score all stay."""
    if k is None or k <= 0:
        return candidates
    best_first = Window.partitionBy("prompt_id").orderBy(F.desc("logit"))
    return candidates.withColumn("_rank", F.rank().over(best_first)).where(F.col("_rank") <= k).drop("_rank")


def with_probability(candidates: DataFrame, name: str = "probability") -> DataFrame:
    """Softmax of the logits per prompt."""
    prompt = Window.partitionBy("prompt_id")
    weight = F.exp(F.col("logit") - F.max("logit").over(prompt))
    weighed = candidates.withColumn("_weight", weight)
    return weighed.withColumn(name, F.col("_weight") / F.sum("_weight").over(prompt)).drop("_weight")


def top_p(candidates: DataFrame, p: float | None) -> DataFrame:
    """Keep tokens while the probability of all better ones is below ``p``.

    Sums are rounded, so that one that reaches ``p`` exactly does not depend on the order of
    its additions.
    """
    if p is None or not 0.0 < p < 1.0:
        return candidates
    best_first = Window.partitionBy("prompt_id").orderBy(F.desc("logit"), "token_id")
    before = F.sum("_p").over(best_first.rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.round(F.coalesce(before, F.lit(0.0)), SUM_DIGITS)
    ranked = with_probability(candidates, "_p").withColumn("_before", earlier)
    return ranked.where(F.col("_before") < p).drop("_p", "_before")


def greedy(candidates: DataFrame) -> DataFrame:
    """The best-scored token per prompt; the smaller id wins a tie."""
    best = F.max_by("token_id", F.struct(F.col("logit"), -F.col("token_id")))
    return candidates.groupBy("prompt_id").agg(best.alias("token_id"))


def sample(candidates: DataFrame, seed: int) -> DataFrame:
    """One token per prompt, drawn from the softmax of its logits.

    Adding Gumbel noise and taking the maximum draws from the softmax without computing it,
    so this is a plain aggregate.
    """
    u = seeded_uniform(F.lit(seed), F.col("prompt_id"), F.col("token_id"))
    noisy = F.col("logit") - F.log(-F.log(u))
    best = F.max_by("token_id", F.struct(noisy, -F.col("token_id")))
    return candidates.groupBy("prompt_id").agg(best.alias("token_id"))


def choose(
    candidates: DataFrame,
    temperature: float = 0.8,
    k: int | None = 50,
    p: float | None = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Greedy without temperature, otherwise temper, filter and sample."""
    if temperature <= 0:
        return greedy(candidates)
    return sample(top_p(top_k(temper(candidates, temperature), k), p), seed)


def prepare_prompt(ids: Column, max_length: int, add_bos: bool = True) -> Column:
    """Start marker and ids; the last ``max_length - 1`` ids of a prompt that is too long."""
    full = F.concat(F.array(F.lit(BOS_ID)), ids) if add_bos else ids
    filled = F.when(F.size(full) == 0, F.array(F.lit(BOS_ID))).otherwise(full)
    room = max_length - 1
    if room <= 0:
        # An empty tail slice keeps everything, as negative zero does in Python.
        return filled
    return F.when(F.size(filled) >= max_length, F.slice(filled, -room, room)).otherwise(filled)
