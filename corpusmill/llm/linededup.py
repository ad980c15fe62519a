"""Repeated lines as keep bitmaps: which lines of each document stay.

A line's key is the line without white space (space, tab to carriage return) at its ends and
with A-Z lower-cased. A key of at least ``MIN_POINTS`` code points that is found in at least
``MIN_DOCUMENTS`` documents stays only in the largest ``doc_id`` that holds it.

Only 128-bit key hashes move, never text. They are range-partitioned with a secondary sort by
document, last first, and position, so each range is one stream in which the first document of
a hash keeps its lines. The most frequent hashes, found by a sketch of bounded size, do not
enter that stream: their (hash, document) pairs are counted with map-side combining, and the
verdicts, at most ``HOT_KEYS`` of them, are broadcast. The sketch only chooses the way; both
give the same verdict. The result is one run-length bitmap per document: the runs of kept
lines as (first, count). ``apply_maps`` cuts texts by it.

Defined cases. A null or empty text is one empty line. Rows that share an id are one document
when documents are counted; each row keeps its own bitmap, and equal rows have equal ones. A
null id counts as one document, smaller than all others. Empty tables give no rows. Only
``doc_id`` and ``text`` are read; ``apply_maps`` returns all columns of its input and puts the
bitmap into one new column that it names so that it clashes with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.words import WHITE_SPACE
from corpusmill.session import materialize

MIN_POINTS = 40
MIN_DOCUMENTS = 5
HOT_KEYS = 4_096
SKETCH_ITEMS = 65_536
HOT_ROWS = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """The lines of ``text``; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_mark(text: Column) -> Column:
    return F.xxhash64(text)


def occurrences(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, mark, pos, high, low) of every line with a long enough key; ``mark`` tells texts of one id apart."""
    each = docs.select("doc_id", _text_mark(F.col("text")).alias("mark"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    # Bytes are no fewer than code points, so the cheap test goes first.
    long_enough = each.where(F.octet_length("line") >= min_points)
    trimmed = long_enough.withColumn("line", F.btrim("line", F.lit(WHITE_SPACE))).where(F.char_length("line") >= min_points)
    key = F.translate("line", UPPER, LOWER)
    return trimmed.select("doc_id", "mark", "pos", F.xxhash64(key).alias("high"), F.xxhash64(F.lit(1), key).alias("low"))


def frequent_hashes(found: DataFrame) -> DataFrame:
    """The most frequent values of ``high``, at most ``HOT_KEYS``, by a sketch that merges map-side."""
    top = found.agg(F.expr(f"approx_top_k(high, {HOT_KEYS}, {SKETCH_ITEMS})").alias("top"))
    item = F.explode("top").alias("item")
    return top.select(item).where(F.col("item.count") >= HOT_ROWS).select(F.col("item.item").alias("high"))


def _dropped_ordinary(found: DataFrame, min_documents: int) -> DataFrame:
    ranges = found.repartitionByRange("high", "low")
    same = Window.partitionBy("high", "low")
    by_document = same.orderBy(F.desc_nulls_last("doc_id"), "pos")
    earlier = F.lag(F.struct("doc_id")).over(by_document)
    starts = ranges.withColumn("starts", (~earlier.eqNullSafe(F.struct("doc_id"))).cast("int"))
    placed = starts.withColumn("place", F.sum("starts").over(by_document.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.withColumn("holders", F.max("place").over(same)).where(
        (F.col("holders") >= min_documents) & (F.col("place") > 1)
    )


def _dropped_frequent(found: DataFrame, min_documents: int) -> DataFrame:
    holders = found.select("high", "low", "doc_id").distinct()
    verdicts = holders.groupBy("high", "low").agg(F.count(F.lit(1)).alias("holders"), F.max("doc_id").alias("last"))
    shared = verdicts.where(F.col("holders") >= min_documents)
    return found.join(F.broadcast(shared), ["high", "low"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))


def dropped_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, mark, dropped): the sorted positions of the lines that go, for documents that lose any."""
    found = materialize(occurrences(docs, min_points), "lines")
    hot = materialize(frequent_hashes(found), "frequent-lines")
    ordinary = _dropped_ordinary(found.join(F.broadcast(hot), "high", "left_anti"), min_documents)
    frequent = _dropped_frequent(found.join(F.broadcast(hot), "high", "left_semi"), min_documents)
    keys = ["doc_id", "mark", "pos"]
    gone = ordinary.select(keys).unionByName(frequent.select(keys))
    return gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Runs of kept lines between the sorted positions ``dropped``, without empty runs."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))
    gaps = F.transform(
        F.slice(edges, F.lit(1), F.size(edges) - 1),
        lambda at, i: F.struct((at + 1).alias("first"), (F.get(edges, i + 1) - at - 1).alias("count")),
    )
    return F.filter(gaps, lambda run: run["count"] > 0)


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["mark"] == right["mark"])


def keep_maps(docs: DataFrame, min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, mark, n_lines int, keep array<struct<first, count>>."""
    text = F.col("text")
    all_docs = docs.select("doc_id", _text_mark(text).alias("mark"), F.size(lines(text)).alias("n_lines")).distinct()
    gone = dropped_lines(docs, min_points, min_documents)
    joined = all_docs.join(gone, _same_document(all_docs, gone), "left")
    none = F.array().cast("array<int>")
    keep = _runs(F.coalesce(gone["dropped"], none), F.col("n_lines"))
    return joined.select(all_docs["doc_id"], all_docs["mark"], "n_lines", keep.alias("keep"))


def apply_maps(docs: DataFrame, maps: DataFrame, name: str = "kept") -> DataFrame:
    """``docs`` with the struct column ``name``: n_lines, n_dropped and the kept text."""
    if name in docs.columns:
        raise ValueError(f"the input already has a column {name}")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"], _text_mark(docs["text"]).alias("mark"))
    joined = row.join(maps, _same_document(row, maps))
    cut, text = lines(F.col("row.text")), F.coalesce(F.col("row.text"), F.lit(""))
    kept_lines = F.flatten(F.transform("keep", lambda run: F.slice(cut, run["first"] + 1, run["count"])))
    n_kept = F.aggregate("keep", F.lit(0), lambda total, run: total + run["count"])
    whole = F.when(n_kept == F.col("n_lines"), text).otherwise(F.array_join(kept_lines, "\n"))
    result = F.struct(F.col("n_lines").cast("bigint").alias("n_lines"), (F.col("n_lines") - n_kept).cast("bigint").alias("n_dropped"), whole.alias("text"))
    return joined.select("row", result.alias("kept")).select("row.*", F.col("kept").alias(name))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs``."""
    slim = docs.select("doc_id", "text")
    kept = apply_maps(slim, keep_maps(slim))
    return kept.select("doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.text", 256).alias("kept_sha256"))
