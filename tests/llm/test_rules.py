"""Quality rules, licences and decontamination against plain Python."""

import textwrap
from collections import Counter

import pytest

from corpusmill.llm import decontam, licences, quality

from .data import LONG, documents, odd_rows


def brute_counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdict(spark):
    rows = odd_rows()
    repeated = "one two three four five six\n" * 3 + "of the and in to\n of"
    rows += [(200, repeated, *[None] * 6), (201, "the # * $ cat | < > of and in to a b c d e f", *[None] * 6)]
    got = {(r.doc_id, r.text): r for r in quality.judge(documents(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        m = got[(doc_id, text)]._measures
        expected = brute_counts(text)
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == expected
        failed = expected[0] < 10 or 100 * expected[4] > 20 * expected[0]
        assert not (failed and got[(doc_id, text)]._kept)
    assert not got[(201, rows[-1][1])]._kept


def test_keep_leaves_columns_alone(spark):
    docs = documents(spark)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.judge(docs).where("_kept").count()
    assert quality.keep(documents(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Released under the MIT License.", "MIT"),
        ("x\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", "CC-BY-NC-4.0,Proprietary"),
        ("SPDX-License-Identifier: MIT\n", "MIT"),
        ("MIT", ""),
        ("All rights reserved. MIT", "Proprietary"),
        ("You may not use this file except in compliance with the License. You may obtain a copy of the License at", "Apache-2.0"),
        ("You may obtain a copy of the License at\nYou may not use this file except in compliance with the License.", ""),
        ("the mit license is nice", ""),
        (None, ""),
        ("", ""),
    ],
)
def test_licences(spark, text, found):
    assert [r.licences for r in licences.scan(documents(spark, [(1, text, *[None] * 6)])).collect()] == [found]


def test_licences_of_all_rows(spark):
    rows = odd_rows() + [(300, LONG + "\nReleased under the MIT License.", *[None] * 6)]
    got = licences.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if r.licences] == [300]


def brute_hits(words, items, window=10):
    hit, named = set(), set()
    for item, body in items:
        for phrase in decontam.item_windows(decontam.split_words(body), window):
            for at in range(len(words) - len(phrase) + 1):
                if tuple(words[at : at + len(phrase)]) == phrase:
                    hit.update(range(at, at + len(phrase)))
                    named.add("" if item is None else str(item))
    return len(hit), sorted(named)


@pytest.mark.parametrize("block_words", [50, 1 << 20])
def test_contamination(spark, monkeypatch, block_words):
    rows = odd_rows()
    long_item = " ".join(rows[0][1].split()[:25]) if len(rows[0][1].split()) >= 25 else rows[0][1]
    items = [(7, long_item), (8, long_item), (9, "the OF"), (10, ""), (None, rows[5][1]), (11, None), (12, "never seen words"), (13, "?!")]
    rows += [(400, f"before {long_item.upper()} after, {long_item}", *[None] * 6), (401, "the", *[None] * 6), (402, "of", *[None] * 6)]
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    if block_words == 50:
        monkeypatch.setattr(decontam, "QUERY_WORDS", 20)
        monkeypatch.setattr(decontam.query_groups, "__defaults__", ("item_id", "text", 20))
        monkeypatch.setattr(decontam.build_index, "__defaults__", (None, "doc_id", "text", block_words))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(documents(spark, rows), benchmark).collect())
    expected = []
    for doc_id, text, *_ in rows:
        words = decontam.split_words(text)
        n, named = brute_hits(words, items)
        expected.append((doc_id, len(words), n, named, n > 0))
    assert got == sorted(expected)
    kept = decontam.keep(documents(spark, rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(e[0] for e in expected if not e[4])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x beta"), (4, "alpha"), (5, "beta y alpha x x")], "doc_id BIGINT, text STRING")
    index = decontam.build_index(docs)
    hits = decontam.search(index, {(b"alpha", b"beta"): [1]}, within=3)
    found = hits.join(decontam.documents_of(index), ["block", "slot"])
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 5]


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontam.contamination(documents(spark), none).where("contaminated").count() == 0
    assert decontam.contamination(documents(spark, []), none).count() == 0


@pytest.mark.parametrize("sign", ["", " * ", "// ", "# "])
def test_wrapped_licences(spark, sign):
    bodies = {"ISC": licences.SENTENCES["isc-permission"], "MIT": licences.SENTENCES["mit-permission"] + ". " + licences.SENTENCES["mit-notice"]}
    bodies["MPL-2.0"] = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    rows = []
    for i, body in enumerate(bodies.values()):
        lines = textwrap.wrap(body, 70)
        rows.append((i, "\n".join(sign + line for line in ["Copyright 2020 A", "", *lines]), *[None] * 6))
    rows += [(9, "SPDX-License-Identifier: BSD-2-Clause\ncode", *[None] * 6)]
    got = {r.doc_id: r.licences for r in licences.scan(documents(spark, rows)).collect()}
    assert got == {**dict(enumerate(bodies)), 9: "BSD-2-Clause"}
