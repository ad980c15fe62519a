"""Toxicity classifier with a counterfactual penalty.

A sparse logistic model over words and word beginnings is fitted on a bounded sample of
labelled documents. Besides the labels it sees counterfactual pairs: each sentence that names
a group is copied with the group's name swapped for another of the same kind, and differences
between the scores of both versions are penalised. A neutral mention of a group then moves no
score, whatever company that group's name keeps in the labelled rows.

The sample is the only bounded part (``MAX_ROWS`` documents by hash of the id, ``MAX_FEATURES``
features); scoring reads every whole text once, without a shuffle.

Defined results: null, empty and blank texts get the score of a text without known features.
Labels repeated for an id count once, as toxic if any says so; null labels are left out.
Without any usable label, or with labels of one kind, every score is the smoothed base rate.
Repeated rows get equal scores. Other columns, language and source among them, are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import decontam
from corpusmill.llm.tokens import slices
from corpusmill.llm.words import worker_state
from corpusmill.session import materialize

MAX_ROWS = 8_000
MAX_FEATURES = 4_096
MIN_DOCS = 3
PREFIXES = (5, 6, 7, 8)
FOLDS = 5
L1, SWAP_WEIGHT, STEPS = 1e-4, 1.0, 600
CACHED_WORDS = 400_000

# Group names by kind; a name is swapped for the next one of its kind.
IDENTITIES = (
    "women men girls boys",
    "woman man girl boy",
    "female male nonbinary",
    "black white asian latino hispanic arab indigenous",
    "muslim christian jewish hindu buddhist sikh atheist",
    "muslims christians jews hindus buddhists sikhs atheists",
    "gay lesbian straight bisexual transgender queer",
    "immigrant refugee foreigner native citizen",
    "immigrants refugees foreigners natives citizens",
    "deaf blind disabled autistic paralysed",
    "old young elderly teenage",
    "african european american mexican chinese indian russian turkish polish",
    "africans europeans americans mexicans indians russians turks poles",
    "frauen männer mädchen jungen",
    "femmes hommes filles garçons",
    "mujeres hombres chicas chicos",
)
SWAPS = {
    names[i].encode(): names[(i + 1) % len(names)].encode()
    for names in (kind.split() for kind in IDENTITIES)
    for i in range(len(names))
}


def split_words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case, whatever the script."""
    return decontam.split_words(text.lower()) if text else []


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings of a few lengths; these are marked by a star."""
    return [word, *[word[:n] + b"*" for n in PREFIXES if len(word) >= n]]


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from the fit; a null id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[bytes, float]

    def score(self, text: str | None) -> float:
        """Probability of the toxic label."""
        cache = worker_state(("toxic", hash(self.bias), len(self.weights)), dict)
        known, found = self.weights, set()
        for word in set(split_words(text)):
            hits = cache.get(word)
            if hits is None:
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                hits = cache[word] = tuple(f for f in features(word) if f in known)
            if hits:
                found.update(hits)
        margin = self.bias + sum(known[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int | None = FOLDS) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents outside the held-out fold."""
    usable = labels.where("doc_id is not null and toxic is not null")
    if folds is not None:
        usable = usable.where(~held_out(F.col("doc_id"), folds))
    each = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialize(joined.dropDuplicates(["doc_id"]).select("text", "toxic"), "labelled")


def select_features(rows: DataFrame, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> list[bytes]:
    """The features that tell most about the label, and all group names."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = (Counter(), Counter())
            for text, toxic in zip(*(batch.column(n).to_pylist() for n in ("text", "toxic")), strict=True):
                seen[bool(toxic)].update({f for w in set(split_words(text)) for f in features(w)})
            every = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(every, pa.binary()), *[pa.array([s[f] for f in every], pa.int64()) for s in seen]]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

    counts = rows.mapInArrow(count, "feature BINARY, clean BIGINT, toxic BIGINT")
    totals = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    rate = F.lit((size.t + 1.0) / (size.n + 2.0))
    n = F.col("clean") + F.col("toxic")
    # A signed chi-square term: how far the toxic count is from the expected one.
    told = F.abs(F.col("toxic") - n * rate) / F.sqrt(n * rate * (1 - rate) + 1)
    ranked = totals.where(n >= min_docs).orderBy(told.desc(), "feature").limit(max_features).select("feature")
    found = [bytes(r.feature) for r in ranked.collect()]
    return list(dict.fromkeys([*found, *SWAPS]))


def vectors(rows: DataFrame, chosen: list[bytes]) -> list:
    """Per sampled document: label and chosen features, those of its counterfactual as a whole (None
    if it names no group), and (own, swapped) ones of each sentence that names a group."""
    index = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value

        def present(words: set[bytes]) -> list[int]:
            return sorted({known[f] for w in words for f in features(w) if f in known})

        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            own, swapped, pairs = [], [], []
            for text in texts:
                sentences = [split_words(s) for s in (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split(".")]
                words = {w for s in sentences for w in s}
                own.append(present(words))
                swapped.append(present({SWAPS.get(w, w) for w in words}) if not words.isdisjoint(SWAPS) else None)
                # One pair for each sentence that names a group, swapped on its own.
                naming = {frozenset(s) for s in sentences if not SWAPS.keys().isdisjoint(s)}
                pairs.append([[present(s), present({SWAPS.get(w, w) for w in s})] for s in sorted(naming, key=sorted)])
            lists = pa.list_(pa.int32())
            columns = [batch.column("toxic").cast(pa.int32()), pa.array(own, lists), pa.array(swapped, lists), pa.array(pairs, pa.list_(pa.list_(lists)))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "own", "swapped", "pairs"])

    return rows.mapInArrow(run, "toxic INT, own ARRAY<INT>, swapped ARRAY<INT>, pairs ARRAY<ARRAY<ARRAY<INT>>>").collect()


class Sparse:
    """Rows of present features."""

    def __init__(self, lists: list[list[int]], width: int):
        self.rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.columns = np.array([c for x in lists for c in x], np.int64)
        self.height, self.width = len(lists), width

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.height)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, values[self.rows], self.width)


def fit_weights(own: Sparse, toxic: np.ndarray, pairs: tuple[Sparse, Sparse] | None, l1: float = L1, swap: float = SWAP_WEIGHT, steps: int = STEPS):
    """Accelerated proximal gradient on log loss + swap * mean squared score change + l1 * |w|."""
    n, m = own.height, pairs[0].height if pairs else 0
    weights, bias = np.zeros(own.width), float(np.log((toxic.sum() + 1) / (n - toxic.sum() + 1)))

    def curvature() -> float:
        v = np.ones(own.width) / np.sqrt(own.width)
        size = 1.0
        for _ in range(20):
            u = own.back(own.dot(v)) / (4 * n)
            if m:
                change = pairs[0].dot(v) - pairs[1].dot(v)
                u = u + 2 * swap * (pairs[0].back(change) - pairs[1].back(change)) / m
            size = float(np.linalg.norm(u)) or 1.0
            v = u / size
        return size

    step = 1 / (1.2 * curvature() + 0.25)
    ahead, ahead_bias, pace = weights.copy(), bias, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(own.dot(ahead) + ahead_bias, -30, 30))) - toxic
        slope = own.back(error) / n
        if m:
            change = pairs[0].dot(ahead) - pairs[1].dot(ahead)
            slope += 2 * swap * (pairs[0].back(change) - pairs[1].back(change)) / m
        moved = ahead - step * slope
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_bias = ahead_bias - step * float(error.mean())
        new_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / new_pace
        ahead, ahead_bias = new + push * (new - weights), new_bias + push * (new_bias - bias)
        weights, bias, pace = new, new_bias, new_pace
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int | None = FOLDS) -> Model:
    rows = sample(docs, labels, max_rows, folds)
    chosen = select_features(rows)
    found = vectors(rows, chosen)
    toxic = np.array([r.toxic for r in found], float)
    if not len(found) or toxic.min() == toxic.max():
        return Model(float(np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))), {})
    swapped = [pair for r in found for pair in r.pairs]
    pairs = tuple(Sparse([p[i] for p in swapped], len(chosen)) for i in range(2)) if swapped else None
    weights, bias = fit_weights(Sparse([r.own for r in found], len(chosen)), toxic, pairs)
    return Model(float(bias), {f: float(w) for f, w in zip(chosen, weights, strict=True) if w})


def scorer(model: Model):
    """A column function from text to score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return score


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below one half."""
    return docs.where(scorer(model)(F.col(text)) < 0.5)
