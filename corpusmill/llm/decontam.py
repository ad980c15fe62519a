"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the corpus into blocks of whole documents and stores each block's
postings: for every term the sorted positions of its occurrences in the block, in one row of
bounded size. A position counts words from the start of the block, with a gap of one between
documents, so no phrase runs across two documents. ``phrases`` then answers exact phrase
queries and ``proximity`` unordered ones: per block the lists are intersected after
subtracting each term's offset in the phrase, beginning with the term that is rarest in the
whole corpus, whose list is the shortest. Blocks are independent: nothing but the narrow
results is shuffled.

Terms can be limited to those the queries use (then other terms take no room), which is what
the registered query does. Queries are a stated set, handled in groups of at most
``QUERY_WORDS`` words; each group is sent to the workers, which bounds what is broadcast.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased.
Defined results: null and blank texts have no words and no hits; an item without words has no
window; an item of fewer than ten words is one window. Repeated documents and items count one
by one, and null ids are carried. Empty tables on either side give no hits. Other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import slices
from corpusmill.session import materialize

WINDOW = 10
BLOCK_WORDS = 1 << 20
QUERY_WORDS = 200_000

INDEX = (
    "block BIGINT, doc_ids ARRAY<BIGINT>, begins ARRAY<BIGINT>, terms ARRAY<BINARY>, "
    "counts ARRAY<BIGINT>, positions ARRAY<INT>"
)
HITS = "block BIGINT, slot BIGINT, item BIGINT, first BIGINT, last BIGINT"

# Everything that separates words becomes a blank; A-Z become a-z.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def _index_row(block: int, docs: list[tuple], words: list[list[bytes]], wanted: set[bytes] | None) -> pa.RecordBatch:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    ids: dict[bytes, int] = {}
    if wanted is None:
        number = defaultdict(lambda: len(number))
        codes = [np.fromiter((number[w] for w in doc), np.int32, len(doc)) for doc in words]
        ids = dict(number)
    else:
        ids = {w: i for i, w in enumerate(wanted)}
        get = ids.get
        codes = [np.fromiter((get(w, -1) for w in doc), np.int32, len(doc)) for doc in words]
    gap = np.array([-1], np.int32)
    flat = np.concatenate([x for code in codes for x in (code, gap)]) if codes else gap[:0]
    places = np.flatnonzero(flat >= 0)
    order = places[np.argsort(flat[places], kind="stable")]
    counts = np.bincount(flat[places], minlength=len(ids))
    present = np.flatnonzero(counts)
    names = list(ids)
    columns = [
        pa.array([block], pa.int64()),
        pa.array([docs], pa.list_(pa.int64())),
        pa.array([begins], pa.list_(pa.int64())),
        pa.array([[names[i] for i in present]], pa.list_(pa.binary())),
        pa.array([counts[present]], pa.list_(pa.int64())),
        pa.array([order.astype(np.int32)], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "begins", "terms", "counts", "positions"])


def build_index(
    docs: DataFrame, terms: set[bytes] | None = None, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per block of about ``block_words`` words, or one document if that is longer."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, base, held, ids, size = sent.value, TaskContext.get().partitionId() << 32, [], [], 0
        for batch in slices(batches):
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(body)
                if held and size + len(words) > block_words:
                    yield _index_row(base, ids, held, wanted)
                    base, held, ids, size = base + 1, [], [], 0
                held.append(words)
                ids.append(doc_id)
                size += len(words) + 1
        if held:
            yield _index_row(base, ids, held, wanted)

    rows = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(run, INDEX)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): occurrences of each indexed term in the whole corpus."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("n"))


class Postings:
    """The lists of one block."""

    def __init__(self, terms: list[bytes], counts: np.ndarray, positions: np.ndarray):
        ends = np.cumsum(counts)
        self.at = {t: (int(e - n), int(e)) for t, e, n in zip(terms, ends, counts, strict=True)}
        self.positions = positions

    def of(self, term: bytes) -> np.ndarray | None:
        span = self.at.get(term)
        return None if span is None else self.positions[span[0] : span[1]]

    def phrase(self, words: tuple[bytes, ...], order: list[int]) -> np.ndarray:
        """First positions of the phrase; ``order`` lists its offsets from rare to frequent."""
        found = None
        for offset in order:
            list_ = self.of(words[offset])
            if list_ is None:
                return self.positions[:0]
            if found is None:
                found = list_ - offset
            else:
                wanted = found + offset
                at = np.minimum(np.searchsorted(list_, wanted), len(list_) - 1)
                found = found[list_[at] == wanted]
            if not len(found):
                break
        return found

    def near(self, words: tuple[bytes, ...], order: list[int], within: int) -> np.ndarray:
        """Positions of the rarest word with every other word at most ``within`` words away."""
        found = self.of(words[order[0]])
        if found is None:
            return self.positions[:0]
        for offset in order[1:]:
            list_ = self.of(words[offset])
            if list_ is None:
                return self.positions[:0]
            after = np.searchsorted(list_, found - within)
            found = found[list_[np.minimum(after, len(list_) - 1)] <= found + within] if len(list_) else found[:0]
            # A list that ends before the wanted range clips to its last entry, which is then too small.
            after = np.searchsorted(list_, found - within)
            found = found[after < len(list_)]
        return found


def item_windows(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every run of ``window`` words; a shorter item is one window, an empty one none."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def query_groups(items: DataFrame, key: str = "item_id", text: str = "text", group_words: int = QUERY_WORDS):
    """The benchmark in groups of at most about ``group_words`` words, or one item if that is longer.

    Items are streamed to the driver by partition and only one group is held at a time.
    """
    group, size = [], 0
    rows = items.select(F.col(key).cast("bigint"), F.col(text).cast("string"))
    for item_id, body in rows.toLocalIterator():
        words = split_words(body)
        if group and size + len(words) > group_words:
            yield group
            group, size = [], 0
        group.append((item_id, words))
        size += len(words)
    if group:
        yield group


def _by_block(index: DataFrame, queries: dict[tuple[bytes, ...], list[int | None]], counts: dict[bytes, int], within: int | None) -> DataFrame:
    """Hits of each query (words -> items) in each block."""
    plan = defaultdict(list)
    for words, items in queries.items():
        order = sorted(range(len(words)), key=lambda i: counts.get(words[i], 0))
        if counts.get(words[order[0]], 0):
            plan[words[order[0]]].append((words, order, items))
    sent = index.sparkSession.sparkContext.broadcast(dict(plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            flat = {n: batch.column(n).values.to_numpy(zero_copy_only=False) for n in ("begins", "counts", "positions")}
            bounds = {n: batch.column(n).offsets.to_numpy() for n in flat}
            begins, lengths, places = (flat[n][bounds[n][0] : bounds[n][1]] for n in ("begins", "counts", "positions"))
            terms = batch.column("terms")[0].as_py()
            postings, block = Postings(terms, lengths, places), batch.column("block")[0].as_py()
            slot, item, first, last = [], [], [], []
            for term in terms:
                for words, order, items in sent.value.get(term, ()):
                    at = postings.phrase(words, order) if within is None else postings.near(words, order, within)
                    if not len(at):
                        continue
                    doc = np.searchsorted(begins, at, side="right") - 1
                    inside = at - begins[doc]
                    reach = len(words) - 1 if within is None else 0
                    for i in items:
                        slot.append(doc)
                        item.append(np.ma.masked_all(len(at), np.int64) if i is None else np.full(len(at), i, np.int64))
                        first.append(inside)
                        last.append(inside + reach)
            yield _hit_batch(block, slot, item, first, last)

    return index.mapInArrow(run, HITS)


def _hit_batch(block: int, slot: list, item: list, first: list, last: list) -> pa.RecordBatch:
    def joined(parts: list) -> np.ndarray:
        return np.ma.concatenate(parts) if parts else np.empty(0, np.int64)

    # The same stretch may be hit by many windows: neighbouring ones of an item become one.
    s, i, a, b = joined(slot), joined(item), joined(first), joined(last)
    known = ~np.ma.getmaskarray(i)
    values = np.ma.filled(i, 0)
    order = np.lexsort((a, values, known, s))
    s, values, known, a, b = (np.asarray(x)[order] for x in (s, values, known, a, b))
    if len(s):
        same = (s[1:] == s[:-1]) & (values[1:] == values[:-1]) & (known[1:] == known[:-1]) & (a[1:] <= b[:-1] + 1)
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        s, values, known, a, b = s[heads], values[heads], known[heads], a[heads], np.maximum.reduceat(b, heads)
    columns = [
        pa.array(np.full(len(s), block, np.int64)),
        pa.array(s.astype(np.int64)),
        pa.array(values.astype(np.int64), mask=~known),
        pa.array(a.astype(np.int64)),
        pa.array(b.astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "slot", "item", "first", "last"])


def search(index: DataFrame, queries: dict[tuple[bytes, ...], list], within: int | None = None) -> DataFrame:
    """(block, slot, item, first, last): where in which document a query matches.

    ``within`` None asks for the exact phrase; a number for every word of the query at most
    that many words from an occurrence of its rarest word, in any order.
    """
    terms = {w for words in queries for w in words}
    # One row per term of the query group, which is bounded.
    used = index.sparkSession.createDataFrame([(bytearray(t),) for t in terms] or [(bytearray(b""),)], "term BINARY")
    counts = {bytes(r["term"]): r["n"] for r in term_counts(index).join(F.broadcast(used), "term").collect()}
    return _by_block(index, queries, counts, within)


def documents_of(index: DataFrame) -> DataFrame:
    """(block, slot, doc_id, n_words) of every indexed document."""
    rows = index.select("block", "begins", F.posexplode("doc_ids").alias("slot", "doc_id"))
    length = F.get("begins", F.col("slot") + 1) - F.get("begins", F.col("slot")) - 1
    return rows.select("block", F.col("slot").cast("bigint").alias("slot"), "doc_id", length.alias("n_words"))


def locate(docs: DataFrame, items: DataFrame, window: int, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """The index of ``docs`` over the items' words, and the hits of the items' windows."""
    terms = {w for group in query_groups(items) for _, words in group for w in words}
    index = materialize(build_index(docs, terms, key, text), "index")
    hits = None
    for group in query_groups(items):
        queries: dict[tuple[bytes, ...], list] = defaultdict(list)
        for item_id, words in group:
            for phrase in dict.fromkeys(item_windows(words, window)):
                queries[phrase].append(item_id)
        found = search(index, queries)
        hits = found if hits is None else hits.unionByName(found)
    return index, hits


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted as strings), contaminated."""
    index, hits = locate(docs, items, window, key, text)
    every, none, zero = documents_of(index), F.array().cast("array<string>"), F.lit(0).cast("bigint")
    if hits is None:
        return every.select("doc_id", "n_words", zero.alias("n_hit"), none.alias("items"), F.lit(False).alias("contaminated"))
    per_doc = hits.groupBy("block", "slot").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"),
        F.sort_array(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("items"),
    )
    start = F.struct(F.lit(-1).cast("bigint").alias("end"), zero.alias("n"))

    def add(state, span):
        last, end = span.getField("last"), state.getField("end")
        fresh = F.greatest(zero, last - F.greatest(span.getField("first") - 1, end))
        return F.struct(F.greatest(last, end).alias("end"), (state.getField("n") + fresh).alias("n"))

    n_hit = F.aggregate("spans", start, add, lambda s: s.getField("n")).alias("n_hit")
    joined = every.join(per_doc.select("block", "slot", "items", n_hit), ["block", "slot"], "left")
    n_hit = F.coalesce("n_hit", zero)
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), (n_hit > 0).alias("contaminated"))


def keep(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns unchanged.

    Rows are matched by the key and a hash of the text, so rows that share a key are judged
    by their own texts; a null key or text is matched like a value.
    """
    mark = F.xxhash64(F.col(key).cast("bigint"), F.col(text))
    bad = contamination(docs.select(mark.alias("_mark"), F.col(text).alias("_text")), items, window, "_mark", "_text")
    marks = bad.where("contaminated").select(F.col("doc_id").alias("_mark")).distinct()
    return docs.join(marks, mark == marks["_mark"], "left_anti")


def digest(found: DataFrame) -> DataFrame:
    joined = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated"
    )
