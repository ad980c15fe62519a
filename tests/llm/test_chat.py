import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat

SIGNS = ["<|", "|>", "<\\|", "\\", "<", "|", "%", "%25", "%0A", "\n", "a b c", "é", "<|im_start|>", "<|im_end|>", "", "word " * 12, "\x00"]
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, window STRING, place INT"


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["system", "user", "assistant", "assistant", "to\nol%<", None])
            number = None if rng.random() < 0.05 else turn
            text = None if rng.random() < 0.05 else "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 7)))
            rows.append((None if conv == 7 else conv, number, role, text, "x", 1))
    rows += [rows[0], rows[0], (99, 0, "assistant", "long " * 3_000, None, None)]
    return rows


@pytest.mark.parametrize(("budget", "history"), [(60, 20), (120, 40), (10_000, 100)])
def test_windows_give_back_every_turn_once(spark, budget, history):
    rows = conversations()
    made = chat.windows(spark.createDataFrame(rows, SCHEMA), budget, history).cache()
    whole = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        whole[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert set(got) == set(whole)
    for conv, turns in whole.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[conv].turns] == [(role, text) for _, role, text in turns]
        assert got[conv].loss_text == "".join(text for _, role, text in turns if role == "assistant")
    # Only a window whose single turn of its own is too long may exceed the budget.
    for r in made.where(F.col("tokens") > budget).collect():
        assert r.text.count("<|im_start|>") - r.n_repeated <= 1 or r.tokens <= budget
    led = [r for r in made.where("window > 0").collect() if whole[r.conv_id][0][1] == "system"]
    assert budget > 1_000 or led and all(r.text.startswith("<|im_start|>system\n") for r in led)


def test_no_turns(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_history_is_the_longest_suffix_that_fits(spark):
    rng = random.Random(4)
    sizes = [rng.randint(10, 120) for _ in range(300)]
    rows = [(1, i, "user" if i % 2 else "assistant", " ".join(["w"] * (n - chat.TURN_TOKENS)), None, None) for i, n in enumerate(sizes)]
    made = sorted(chat.windows(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.window)
    at = 0
    for r in made:
        left, wanted = min(chat.HISTORY, chat.BUDGET - r.tokens), 0
        while wanted < at and sum(sizes[at - wanted - 1 : at]) <= left:
            wanted += 1
        assert r.n_repeated == wanted
        at += r.text.count("<|im_start|>") - r.n_repeated
    assert at == len(sizes)
