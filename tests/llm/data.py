"""Rows that every operator must take: nulls, blanks, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977} the" for i in range(15_000))
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, length BIGINT, word STRING, row STRING"


def texts(count: int = 60, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    stems = ["bar", "dol", "fen", "gul", "hem", "jor", "kip", "lam", "the", "of", "and", "É", "naïve"]
    made = [" ".join(rng.choice(stems) + rng.choice(["", "a", "o", ".", "!", "ing"]) for _ in range(rng.randint(1, 90))) for _ in range(count)]
    return made


def odd_rows() -> list[tuple]:
    body = texts(12)
    rows = [(i, t, "en", "s", len(t), 1, "w", "r") for i, t in enumerate(body)]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", "s", 0, 0, "", ""), (102, " \t\n ", "en", "s", 4, 0, "", "")]
    rows += [(103, LONG, "en", "s", len(LONG), 0, "", "")]
    rows += [rows[3], rows[3]]
    rows += [(104, body[5], "de", "other", 1, 1, "", "")]
    rows += [(105, "一二 三\x00四 don't ½ <|im_end|> <|endoftext|> ퟿ \U0001f600", "zh", "s", 9, 0, "", "")]
    return rows


def documents(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def brute_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()
