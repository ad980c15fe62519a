"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from corpusmill.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, edit STRING, cost INT, state STRING"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, lines) over all edits; ``rows`` are (role, text, fault)."""

    @lru_cache(None)
    def rest(at, last, inserts):
        ways = []
        if at == len(rows):
            if last in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[at]
            cost, audit, lines = rest(at + 1, last, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                options = [("K", 0, role)] + [("R", 2, name) for name in ("user", "assistant")]
                for edit, price, name in options:
                    if name[:1] and name[:1] in AFTER[last]:
                        cost, audit, lines = rest(at + 1, name[:1], 0)
                        ways.append((cost + price + cut, edit + audit, (f"{name}:{text}", *lines)))
        if inserts < 3:
            for name in ("user", "assistant"):
                if name[0] in AFTER[last]:
                    cost, audit, lines = rest(at, name[0], inserts + 1)
                    ways.append((cost + 2, "I" + audit, (f"{name}:", *lines)))
        return min(ways, default=(10**9, "", ()))

    return rest(0, "", 0)


def named_faults(rows):
    seen, result = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        result.append((role, text, fault))
    return tuple(result)


def damage(rows):
    result = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = (" " if v is None else v for v in (role, text))
        way = zlib.crc32(":".join(shown).encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else "".join(c for c in text if c not in ".!?") if way == 2 else text
        result += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return result


def brute(rows):
    after, result = damage(rows), set()
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = named_faults([(r[2], r[3]) for r in mine])
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(faults)
        counts = [sum(f[2] == name for f in faults) for name in ("blank", "duplicate", "truncated")]
        result.add((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return result


def made(count=150, seed=5):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "ubuntu", "Süß"]
    texts = ["Yes.", "No!", "cut off", "  trailing. \n", "", " \t", None, "the same.", "é?", "<|im_end|>"]
    for conv in range(count):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), rng.choice(roles), rng.choice(texts)))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def test_audit_equals_brute_force(spark):
    rows = made()
    assert {tuple(r) for r in repair.audit(table(spark, rows)).collect()} == brute(rows)


def test_all_rows_dropped_and_empty_table(spark):
    lost = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = repair.audit(table(spark, [(lost, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in found] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair.audit(table(spark, [])).collect() == []


def test_search_equals_brute_force_on_random_rows():
    rng = random.Random(3)
    names = {"u": "user", "a": "assistant", "s": "system", "x": "x"}
    for _ in range(3_000):
        initials = rng.choice(["uasx", "ua", "us", "x"])
        rows = tuple((names[rng.choice(initials)], "t", rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 8)))
        search, final = repair.Search(), []
        codes = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        for role, text, fault in rows:
            final += search.step(role[:1], codes[fault], None)
        final += search.finish()
        assert "".join(edits for edits, _ in final) == cheapest(rows)[1]


@pytest.mark.parametrize("roles,most", [("ua", 4), ("uuaa", 4), ("uax", 30)])
def test_survivors_coalesce(roles, most):
    search, deepest, final = repair.Search(), 0, 0
    for at in range(20_000):
        final += len(search.step(roles[at % len(roles)], 0, at))
        deepest = max(deepest, search.waiting)
    assert deepest <= most and final > 19_900


def test_long_conversation_streams_to_edits(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(12_000)]
    edits = repair.repair(table(spark, rows)).collect()
    assert [e.edit for e in edits] == ["K"] * 12_000
    assert [e.text for e in edits] == [r[3] for r in rows]
