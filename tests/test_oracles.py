import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


# check_oracles.py covers all queries; these touch every module once.
CHECKED = (
    "corpus_filter", "initial_pair_counts", "byte_encode_stats", "shard_layout", "shard_scan", "pretokenized_shards",
    "range_violations", "windows_from_shards", "shuffled_plan", "lr_schedule", "step_loss", "throughput", "live_history",
    "nucleus_candidates", "gumbel_sample", "repetition_penalty", "eval_perplexity", "bpe_vocab", "bpe_encode",
    "restarted_steps", "endless_steps",
)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    same, note = compare(spark, SMALL, name)
    assert same, note
