"""Registered queries: every operator run over the whole driver tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import BYTE_VOCAB_SIZE, EOS_ID
from corpusmill.functions import bytes as by
from corpusmill.functions import codec
from corpusmill.functions import text as tx
from corpusmill.functions.hashing import seeded_hash
from corpusmill.functions.schedule import warmup_cosine
from corpusmill.operators import audit, batches, candidates, fit, metrics, pack, scorer, windows
from corpusmill.operators.order import hash_sample, key_blocks
from corpusmill.plans import build
from corpusmill.session import fresh_path, materialize, work_dir
from corpusmill.sources import corpus, history, metadata, shards, vocabulary
from corpusmill.streaming import tail
from corpusmill.streaming.incremental import IncrementalBuild, landing_stream

SHARD = 100_000
LENGTH = 256
BATCH = 8
ACCUMULATION = 4
WORKERS = 2
VOCAB = 400
LIMIT = 500
KEYLESS_FILES, KEYLESS_FILE_ROWS, KEYLESS_BLOCK = 3, 20_000, 200
STREAM_LIMIT = 700
# Fixed value: the distance of a wide ASCII sign from the plain one.
WIDE_STEP = 0xFEE0
SAMPLE_LINES = 300
DELIVERY_FILES = 1_000_000
MAX_LINE_BYTES = 16_384
MAX_PROMPT = 256
# Four specials and the ASCII bytes: everything else is out of range.
ASCII_VOCAB = 132
LR = {"peak": 3e-4, "floor": 3e-5, "warmup": 20, "total": 200}
DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(sf: str) -> str:
    return f"{sf}/documents.parquet"


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.accept(corpus.scan(spark, _documents(sf)))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return build.numbered_documents(spark, _documents(sf))


def _packed(spark: SparkSession, sf: str) -> build.Packed:
    return build.pack_bytes(_numbered(spark, sf), SHARD)


def _keys(spark: SparkSession, sf: str) -> build.Placed:
    return build.place_keys(_numbered(spark, sf), SHARD)


def _written(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "dataset")
    metadata.write_manifest(build.write_packed(_packed(spark, sf), path), path)
    return path


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.windows(_packed(spark, sf).chunks, LENGTH)


def _shifted(spark: SparkSession, sf: str) -> DataFrame:
    return windows.shifted(_windows(spark, sf), LENGTH)


def _pieces(spark: SparkSession, sf: str) -> vocabulary.Pieces:
    """The vocabulary of this corpus, fitted once per application and then reused."""
    return vocabulary.Pieces.of(_vocab(spark, sf))


def _vocab_path(spark: SparkSession, sf: str) -> str:
    tag = hashlib.md5(f"{sf}-{spark.conf.get('spark.app.id')}".encode()).hexdigest()
    return f"{work_dir(spark)}/corpusmill-vocab-{tag}"


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return build.load_or_fit(_accepted(spark, sf), _vocab_path(spark, sf), VOCAB)


def _ids_md5(ids: Column) -> Column:
    return F.md5(F.array_join(ids, ",").cast("binary"))


def _text_md5(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


# ---------------------------------------------------------------- text and order


@query
def corpus_scan(spark, sf):
    docs = corpus.scan(spark, _documents(sf)).where(F.col("text").isNotNull())
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query
def corpus_filter(spark, sf):
    words = tx.word_count(F.col("text")).cast("bigint").alias("n_words")
    return _accepted(spark, sf).select("doc_id", words, by.byte_length(F.col("text")).alias("n_bytes"))


@query
def flatten_text(spark, sf):
    docs = corpus.scan(spark, _documents(sf)).where(F.col("text").isNotNull())
    return docs.select("doc_id", _text_md5(tx.flatten(F.col("text"))).alias("flat_md5"))


@query
def normalized_wide(spark, sf):
    """Compatibility normalization undoes wide letters and signs, and turns odd spaces into plain ones."""
    docs = corpus.scan(spark, _documents(sf)).where(F.col("text").isNotNull())
    plain = F.regexp_replace(tx.flatten(F.col("text")), r"[^ !-~]", "")
    narrow = "".join(chr(c) for c in range(ord("!"), ord("~") + 1))
    wide = "".join(chr(ord(c) + WIDE_STEP) for c in narrow)
    spaced = F.regexp_replace(F.translate(plain, narrow.replace("~", ""), wide[:-1]), " ", "\u3000\u200b")
    return docs.select("doc_id", _text_md5(tx.normalize(spaced)).alias("text_md5"))


def _in_files(docs: DataFrame) -> DataFrame:
    """Documents in the order of their ids over as many files as their number deserves, ``KEYLESS_FILES`` at least."""
    files = max(KEYLESS_FILES, -(-docs.count() // KEYLESS_FILE_ROWS))
    return docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")


@query
def doc_split(spark, sf):
    return _numbered(spark, sf).select("doc_id", "ordinal", "split")


@query
def keyless_split(spark, sf):
    """The corpus as files without ids: order and split come from file names and rows."""
    path = fresh_path(spark, "keyless")
    texts = spark.read.schema(corpus.DOCUMENT_SCHEMA).parquet(_documents(sf))
    _in_files(texts).select("text").write.parquet(path)
    accepted = corpus.accept(corpus.scan_rows(spark, path, KEYLESS_BLOCK))
    numbered = corpus.number(accepted).withColumn("split", pack.split_of(F.col("ordinal")))
    return numbered.select("ordinal", "split", _text_md5(F.col("text")).alias("text_md5"))


@query
def accepted_limit(spark, sf):
    return corpus.number(_accepted(spark, sf), limit=LIMIT).select("doc_id", "ordinal")


@query
def fit_sample_cap(spark, sf):
    lines = fit.sample_lines(_numbered(spark, sf), LIMIT, MAX_LINE_BYTES)
    return lines.select("doc_id", F.octet_length("line").cast("bigint").alias("n_bytes"))


@query
def fit_line_sample(spark, sf):
    lines = fit.sample_lines(_numbered(spark, sf))
    hashed = seeded_hash(F.lit(42), F.col("doc_id"))
    return hash_sample(lines, hashed, ["doc_id"], SAMPLE_LINES).select("doc_id")


@query
def word_histogram(spark, sf):
    return fit.word_histogram(fit.sample_lines(_numbered(spark, sf)))


def _words(spark, sf):
    return fit.normalize_words(word_histogram(spark, sf))


@query
def char_coverage(spark, sf):
    return fit.alphabet(fit.char_histogram(_words(spark, sf))).withColumn("rank", F.col("rank").cast("bigint"))


@query
def initial_pair_counts(spark, sf):
    words = _words(spark, sf)
    letters = [r.char for r in fit.alphabet(fit.char_histogram(words)).collect()]
    return fit.symbol_pairs(fit.as_symbols(words, letters))


# ---------------------------------------------------------------- encoding


@query
def byte_encode_stats(spark, sf):
    docs = _accepted(spark, sf).withColumn("ids", by.byte_ids(F.col("text")))
    return docs.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("id_sum"),
        F.array_max("ids").alias("max_id"),
        _ids_md5(F.col("ids")).alias("ids_md5"),
    )


@query
def bpe_vocab(spark, sf):
    return _vocab(spark, sf)


@query
def bpe_vocab_layout(spark, sf):
    return _vocab(spark, sf).groupBy("kind").agg(
        F.count(F.lit(1)).alias("pieces"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query
def reused_special_pieces(spark, sf):
    """A saved vocabulary is reused: a fit on no documents would fail. Its special ids were checked."""
    fitted = _vocab(spark, sf)
    nothing = _accepted(spark, sf).limit(0)
    again = build.load_or_fit(nothing, _vocab_path(spark, sf), VOCAB)
    return again.join(fitted.select("id", "piece"), ["id", "piece"]).where("kind = 'special'").select("id", "piece")


@query
def bpe_encode(spark, sf):
    pieces = _pieces(spark, sf)
    docs = _numbered(spark, sf).select("doc_id", codec.encode(F.col("text"), pieces).alias("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_ids"), _ids_md5(F.col("ids")).alias("ids_md5"))


@query
def bpe_roundtrip(spark, sf):
    pieces = _pieces(spark, sf)
    ids = codec.encode(F.col("text"), pieces, add_bos=True, add_eos=True)
    docs = _numbered(spark, sf).select("doc_id", ids.alias("ids"))
    return docs.select("doc_id", _text_md5(codec.decode(F.col("ids"), pieces)).alias("text_md5"))


@query
def bpe_piece_histogram(spark, sf):
    vocab = _vocab(spark, sf)
    ids = codec.encode(F.col("text"), vocabulary.Pieces.of(vocab))
    used = _numbered(spark, sf).select(F.explode(ids).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    return vocabulary.lookup(used, vocab)


@query
def bpe_shard_audit(spark, sf):
    packed = build.pack_pieces(_numbered(spark, sf), _pieces(spark, sf), SHARD)
    marks = audit.separators(packed.placed, packed.chunks)
    return marks.join(audit.id_range(packed.chunks, packed.vocab_size), "split").select(
        "split", "num_documents", "eos_count", "agrees", "unk_count", "in_vocab"
    )


# ---------------------------------------------------------------- packing and shards


@query
def framed_documents(spark, sf):
    docs = _numbered(spark, sf).withColumn("ids", pack.frame(by.byte_ids(F.col("text"))))
    return docs.select(
        "doc_id", "split",
        F.size("ids").cast("bigint").alias("n"),
        F.element_at("ids", 1).alias("first_id"),
        F.element_at("ids", -1).alias("last_id"),
    )


@query
def pack_offsets(spark, sf):
    return _keys(spark, sf).placed.select("doc_id", "split", "n", "offset")


@query
def shard_layout(spark, sf):
    return _packed(spark, sf).chunks.select(
        "doc_id", "split", "shard", "shard_offset", F.size("ids").alias("n_tokens")
    )


@query
def split_totals(spark, sf):
    return _keys(spark, sf).totals()


@query
def shard_sha256(spark, sf):
    return shards.verify(spark, _written(spark, sf))


@query
def shard_scan(spark, sf):
    chunks = shards.read(spark, _written(spark, sf))
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, t: a + t)
    place = F.transform("ids", lambda t, i: t.cast("bigint") * (F.col("shard_offset") + i + 1))
    weighted = F.aggregate(place, F.lit(0).cast("bigint"), lambda a, t: a + t)
    return chunks.groupBy("split", "shard").agg(
        F.sum(F.size("ids")).alias("tokens"),
        F.sum(total).alias("id_sum"),
        F.sum(weighted).alias("weighted_sum"),
    )


@query
def shard_metadata(spark, sf):
    path = _written(spark, sf)
    records = [metadata.read(spark, f"{path}/{s}").withColumn("split", F.lit(s)) for s in ("train", "val")]
    eos = F.aggregate("verification", F.lit(0).cast("bigint"), lambda a, v: a + v["eos_count"])
    return records[0].unionByName(records[1]).select(
        "split", "version", "dtype", "vocab_size", "eos_id", "bos_id", "num_documents", "num_tokens",
        "num_shards", "shard_size", "packing",
        F.size("verification").alias("verified"), eos.alias("eos_count"),
    )


@query
def dataset_manifest(spark, sf):
    return metadata.read_manifest(spark, _written(spark, sf)).select("split", "num_documents", "num_tokens")


@query
def manifest_times(spark, sf):
    """Whether each split's record was made just now, by an ISO time with its zone."""
    made = metadata.read_manifest(spark, _written(spark, sf)).select("split", "created_at")
    zoned = F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?\+00:00$")
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp("created_at"))
    return made.select("split", zoned.alias("zoned"), age.between(0, 86_400).alias("recent"))


@query
def token_count_fallback(spark, sf):
    path = fresh_path(spark, "bare")
    packed = _packed(spark, sf)
    shards.write(packed.chunks, {r.split: r.num_shards for r in packed.totals().collect()}, SHARD, path)
    counts = [(s, metadata.token_count(spark, f"{path}/{s}")) for s in ("train", "val")]
    return spark.createDataFrame(counts, "split STRING, num_tokens BIGINT")


@query
def pretokenized_shards(spark, sf):
    docs = corpus.scan(spark, _documents(sf)).where(F.col("text").isNotNull())
    ids = docs.select("doc_id", by.byte_ids(tx.strip(F.col("text"))).alias("ids"))
    path = fresh_path(spark, "pretokenized")
    build.write_token_shards(ids, path, EOS_ID, BYTE_VOCAB_SIZE, SHARD)
    return shards.verify(spark, path).drop("split", "path")


@query
def separator_audit(spark, sf):
    packed = _packed(spark, sf)
    return audit.separators(packed.placed, packed.chunks)


@query
def delimiter_audit(spark, sf):
    return audit.delimiters(_packed(spark, sf).chunks)


@query
def id_range_audit(spark, sf):
    return audit.id_range(_packed(spark, sf).chunks, BYTE_VOCAB_SIZE)


@query
def range_violations(spark, sf):
    docs = _accepted(spark, sf).select("doc_id", by.byte_ids(F.col("text")).alias("ids"))
    return pack.range_violations(docs, ASCII_VOCAB)


# ---------------------------------------------------------------- windows and batches


@query
def windows_xy(spark, sf):
    return _shifted(spark, sf).select(
        "split", "shard", "window", _ids_md5(F.col("x")).alias("x_md5"), _ids_md5(F.col("y")).alias("y_md5")
    )


@query
def windows_from_shards(spark, sf):
    stored = shards.read_windows(spark, _written(spark, sf), LENGTH)
    return stored.select("split", "shard", "window", _ids_md5(F.col("ids")).alias("ids_md5"))


@query
def window_counts(spark, sf):
    return windows.window_counts(_keys(spark, sf).shard_tokens(), LENGTH)


@query
def worker_partition(spark, sf):
    return batches.assign_workers(_keys(spark, sf).shard_tokens(), 3)


@query
def shuffled_plan(spark, sf):
    return batches.positions(_keys(spark, sf).shard_tokens(), WORKERS, 2, LENGTH)


def _steps(spark, sf, shuffle=False, epochs=1):
    tokens = _keys(spark, sf).shard_tokens()
    return batches.steps(batches.batches(tokens, BATCH, WORKERS, epochs, LENGTH, shuffle), ACCUMULATION)


@query
def batch_steps(spark, sf):
    return _steps(spark, sf)


def _one_and_a_half_passes(spark, sf):
    """Training steps beyond one pass, whatever the corpus."""
    last = _steps(spark, sf).where(F.col("split") == "train").agg(F.max("step").alias("last")).first().last
    return (last + 1) * 3 // 2


@query
def restarted_steps(spark, sf):
    max_steps = _one_and_a_half_passes(spark, sf)
    one = batches.batches(_keys(spark, sf).shard_tokens(), BATCH, WORKERS, 1, LENGTH, False)
    again = batches.restarted(one.where(F.col("split") == "train"), 2)
    return batches.steps(again, ACCUMULATION, max_steps).drop("split", "epoch")


@query
def endless_steps(spark, sf):
    max_steps = _one_and_a_half_passes(spark, sf)
    tokens = _keys(spark, sf).shard_tokens().where(F.col("split") == "train")
    epochs = batches.epochs_for(tokens, BATCH, WORKERS, LENGTH, ACCUMULATION, max_steps)
    endless = batches.batches(tokens, BATCH, WORKERS, epochs, LENGTH)
    return batches.steps(endless, ACCUMULATION, max_steps).drop("split")


@query
def lr_schedule(spark, sf):
    used = _steps(spark, sf, shuffle=True).where(F.col("split") == "train").groupBy("step").agg(
        (F.count(F.lit(1)) * LENGTH).alias("tokens")
    )
    lr = warmup_cosine(F.col("step"), **LR)
    full = F.lit(batches.tokens_per_step(BATCH, ACCUMULATION, LENGTH)).cast("bigint")
    return used.select("step", "tokens", full.alias("tokens_per_step"), F.round(lr, 12).alias("lr"))


@query
def step_cadence(spark, sf):
    done = _steps(spark, sf).where(F.col("split") == "train").select((F.col("step") + 1).alias("step")).distinct()
    flags = {"logs": 10, "evaluates": 50, "saves": 100}
    return done.select("step", *[batches.on_cadence(F.col("step"), n).alias(k) for k, n in flags.items()])


# ---------------------------------------------------------------- scoring and metrics


def _train_bigrams(shifted):
    """Counted once and written: the totals that a scorer derives from them are cheap then."""
    counts = scorer.window_bigrams(shifted.where(F.col("split") == "train"), BYTE_VOCAB_SIZE)
    return materialize(counts, "bigrams")


@query
def bigram_counts(spark, sf):
    return _train_bigrams(_shifted(spark, sf))


@query
def token_nll(spark, sf):
    """The pairs of both splits are counted in one pass; the scorer learns from those of training."""
    counted = materialize(scorer.window_bigrams(_shifted(spark, sf), BYTE_VOCAB_SIZE, ["split"]), "split-bigrams")
    learned = counted.where(F.col("split") == "train").drop("split")
    sums = scorer.loss_sums(counted, learned, BYTE_VOCAB_SIZE, ["split"], times="n")
    return sums.select(
        "split", "tokens",
        F.round(F.col("loss_sum") / F.col("tokens"), DIGITS).alias("loss"),
        F.round(F.lit(scorer.uniform_loss(BYTE_VOCAB_SIZE)), DIGITS).alias("uniform_loss"),
    )


def _batch_sums(spark, sf, split):
    """Windows are summed where they lie; only their sums meet the plan."""
    packed = _packed(spark, sf)
    shifted = windows.shifted(windows.windows(packed.chunks, LENGTH), LENGTH)
    planned = batches.batches(packed.shard_tokens(), BATCH, WORKERS, 1, LENGTH, shuffle=False)
    place = ["split", "shard", "window"]
    pairs = scorer.token_pairs(shifted.where(F.col("split") == split), place)
    sums = scorer.loss_sums(pairs, _train_bigrams(shifted), BYTE_VOCAB_SIZE, place)
    keyed = sums.join(planned.where(F.col("split") == split), place)
    return keyed.groupBy("batch_no").agg(F.sum("loss_sum").alias("loss_sum"), F.sum("tokens").alias("tokens"))


@query
def eval_perplexity(spark, sf):
    result = metrics.evaluate(_batch_sums(spark, sf, "val"))
    return result.select(
        F.round("loss", DIGITS).alias("loss"), F.round("perplexity", DIGITS).alias("perplexity"), "tokens"
    )


def _step_losses(spark, sf):
    sums = _batch_sums(spark, sf, "train")
    losses = sums.select(
        F.expr(f"batch_no div {ACCUMULATION}").alias("step"),
        (F.col("loss_sum") / F.col("tokens")).alias("batch_loss"),
    )
    return metrics.step_loss(losses)


@query
def step_loss(spark, sf):
    return _step_losses(spark, sf).withColumn("loss", F.round("loss", DIGITS))


@query
def loss_trend(spark, sf):
    trend = metrics.loss_trend(_step_losses(spark, sf))
    rounded = [F.round(c, DIGITS).alias(c) for c in ("first_loss", "last_loss")]
    return trend.select(*rounded, "decreased")


def _event_records(spark, sf):
    """The events table in the shape of training histories, one run per event type."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("step"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("loss"),
        F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("val_loss"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
    )


@query
def history_roundtrip(spark, sf):
    path = fresh_path(spark, "history")
    history.append(_event_records(spark, sf), path)
    return history.read(spark, path).groupBy("run").agg(
        F.count(F.lit(1)).alias("records"),
        F.count("loss").alias("train_records"),
        F.round(F.sum("val_loss"), DIGITS).alias("val_loss_sum"),
        F.max("step").alias("last_step"),
    )


@query
def throughput(spark, sf):
    logged = _event_records(spark, sf).where(batches.on_cadence(F.col("step"), 10))
    logged = logged.select("run", "step", F.col("timestamp").alias("seconds"))
    blocked = logged.withColumn("block", key_blocks(logged, "step"))
    per_step = batches.tokens_per_step(BATCH, ACCUMULATION, LENGTH)
    rated = metrics.throughput(blocked, per_step, ["run"])
    return rated.select("run", "step", F.round("tokens_per_sec", 3).alias("tokens_per_sec"))


@query
def live_history(spark, sf):
    path, out = fresh_path(spark, "history"), fresh_path(spark, "tail")
    records = _event_records(spark, sf)
    history.append(records.where(F.col("step") % 2 == 0), path)
    history.append(records.where(F.col("step") % 2 == 1), path)
    tail.follow(history.stream(spark, path), out).awaitTermination()
    return spark.read.parquet(f"{out}/latest")


@query
def stream_build(spark, sf):
    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "stream")
    docs = spark.read.schema(corpus.DOCUMENT_SCHEMA).parquet(_documents(sf))
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    cut = span.lo + (span.hi - span.lo) // 3
    job = IncrementalBuild(out, BYTE_VOCAB_SIZE, shard_size=SHARD)
    # Two deliveries, each one batch of as many files as its writers made.
    for part in (docs.where(F.col("doc_id") <= cut), docs.where(F.col("doc_id") > cut)):
        part.write.mode("append").parquet(landing)
        job.start(landing_stream(spark, landing, DELIVERY_FILES)).awaitTermination()
    job.close(spark)
    return shards.verify(spark, f"{out}/shards")


@query
def stream_keyless(spark, sf):
    """Deliveries of files without ids, without the opening marker and up to a number of documents."""
    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "stream")
    docs = spark.read.schema(corpus.DOCUMENT_SCHEMA).parquet(_documents(sf))
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    cut = span.lo + (span.hi - span.lo) // 3
    job = IncrementalBuild(out, BYTE_VOCAB_SIZE, shard_size=SHARD, add_bos=False, limit=STREAM_LIMIT)
    for part in (docs.where(F.col("doc_id") <= cut), docs.where(F.col("doc_id") > cut)):
        _in_files(part).select("text").write.mode("append").parquet(landing)
        job.start(landing_stream(spark, landing, DELIVERY_FILES, keyed=False)).awaitTermination()
    job.close(spark)
    return shards.verify(spark, f"{out}/shards")


# ---------------------------------------------------------------- candidates


def _context_candidates(spark, sf):
    """Every context token as a prompt, its followers as scored candidates."""
    bigrams = _train_bigrams(_shifted(spark, sf))
    return bigrams.select(
        F.col("x").alias("prompt_id"), F.col("y").alias("token_id"), F.log("n").alias("logit")
    )


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.select("prompt_id", "token_id", F.round("logit", DIGITS).alias("logit"))


@query
def topk_candidates(spark, sf):
    return _rounded(candidates.top_k(_context_candidates(spark, sf), 5))


@query
def tempered_probabilities(spark, sf):
    scored = candidates.with_probability(candidates.temper(_context_candidates(spark, sf), 0.8))
    return scored.select("prompt_id", "token_id", F.round("probability", DIGITS).alias("probability"))


@query
def nucleus_candidates(spark, sf):
    return _rounded(candidates.top_p(candidates.top_k(_context_candidates(spark, sf), 20), 0.9))


def _prompts(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where(F.col("text").isNotNull())
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("prompt_id"),
        candidates.prepare_prompt(by.byte_ids(F.col("text")), MAX_PROMPT).alias("ids"),
    )


@query
def prompt_prepare(spark, sf):
    return _prompts(spark, sf).select(
        "prompt_id", F.size("ids").alias("n_ids"), _ids_md5(F.col("ids")).alias("ids_md5")
    )


def _prompt_candidates(spark, sf):
    """Followers of each prompt's last token. The byte bigram table has at most 260² rows."""
    bigrams = F.broadcast(_train_bigrams(_shifted(spark, sf)))
    last = _prompts(spark, sf).select("prompt_id", F.element_at("ids", -1).alias("x"))
    scored = last.join(bigrams, "x")
    return scored.select("prompt_id", F.col("y").alias("token_id"), (F.log("n") - 3.0).alias("logit"))


def _penalized(spark, sf):
    """The turn stands in for what was generated so far."""
    emitted = _prompts(spark, sf).select("prompt_id", F.explode("ids").alias("token_id"))
    return candidates.penalize_repeats(_prompt_candidates(spark, sf), emitted, 1.3)


@query
def repetition_penalty(spark, sf):
    return _rounded(_penalized(spark, sf))


@query
def greedy_choice(spark, sf):
    return candidates.greedy(_penalized(spark, sf))


@query
def gumbel_sample(spark, sf):
    return candidates.choose(_prompt_candidates(spark, sf), temperature=0.8, k=50, p=0.95, seed=7)
