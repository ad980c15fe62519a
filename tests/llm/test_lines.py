"""Line bitmaps against plain Python."""

import hashlib
from collections import defaultdict

import pytest

from corpusmill.llm import linededup

from .data import documents, odd_rows

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans(linededup.UPPER, linededup.LOWER)


def key(line):
    return line.strip(SPACE).translate(UPPER)


def brute(rows):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= linededup.MIN_POINTS:
                holders[key(line)].add(doc_id)
    last = {k: max((d for d in ids if d is not None), default=None) for k, ids in holders.items() if len(ids) >= linededup.MIN_DOCUMENTS}
    result = []
    for doc_id, text in rows:
        each = (text or "").split("\n")
        kept = [line for line in each if key(line) not in last or last[key(line)] == doc_id]
        result.append((doc_id, len(each), len(each) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(result, key=repr)


def planted():
    shared = "A line that many documents share, long enough to count ünder"
    exact, short = "x" * 40, "y" * 39
    rows = [(i, f"own {i} " + "z" * i + f"\n\t{shared.upper() if i % 2 else shared}  \nmid\n{shared}\n{exact}\n{short}", *[None] * 6) for i in range(9)]
    rows += [(20 + i, f"{'four times only ' * 4}\n{i}", *[None] * 6) for i in range(4)]
    rows += [(8, f"other text, same id\n{shared}\n\n", *[None] * 6), (None, f"{shared}\nno id", *[None] * 6), (None, shared, *[None] * 6)]
    return rows + rows[:2]


def found(spark, rows):
    return sorted((tuple(r) for r in linededup.digest(documents(spark, rows)).collect()), key=repr)


@pytest.mark.parametrize("hot", [2_000, 1])
def test_digest_equals_brute_force_by_either_way(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT_ROWS", hot)
    rows = odd_rows() + planted()
    assert found(spark, rows) == brute([r[:2] for r in rows])


def test_one_line_in_every_document(spark):
    line = "the same footer line of every single document here"
    rows = [(i, f"{i}\n{line}", *[None] * 6) for i in range(3_000)]
    assert found(spark, rows) == brute([r[:2] for r in rows])


def test_maps_and_whole_columns(spark):
    docs = documents(spark, planted())
    maps = linededup.keep_maps(docs)
    for row in maps.collect():
        assert all(run["count"] > 0 for run in row.keep)
        assert [r["first"] for r in row.keep] == sorted(r["first"] for r in row.keep)
        assert sum(r["count"] for r in row.keep) <= row.n_lines
    applied = linededup.apply_maps(docs, maps)
    assert applied.columns == [*docs.columns, "kept"] and applied.count() == docs.count()
    with pytest.raises(ValueError):
        linededup.apply_maps(docs, maps, "word")


def test_empty_table(spark):
    assert found(spark, []) == []
