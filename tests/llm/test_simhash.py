import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import simhash

from .data import brute_words, documents, odd_rows


def brute_print(text):
    words = brute_words(text)
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def test_fingerprints_and_components_of_odd_rows(spark):
    rows = odd_rows()
    prints = [brute_print(r[1]) for r in rows]
    group = brute_components(prints)
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    expected = sorted((r[0], p, least[g]) for r, p, g in zip(rows, prints, group, strict=True))
    got = sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents(spark)).collect())
    assert got == expected


def test_links_of_clustered_fingerprints_in_small_tiles(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = []
    for centre in centres:
        for _ in range(40):
            value = int(centre)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                value ^= 1 << int(bit)
            prints.append(value)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "doc_id BIGINT, fingerprint BIGINT")
    for tile in (5, 2_048):
        links = simhash.links(frame, tile=tile)
        found = links.collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in found)
        roots = {r.node: r.root for r in simhash.components(links).collect()}
        mine = [roots.get(s, s) for s in signed]
        theirs = brute_components(prints)
        assert len(set(zip(mine, theirs, strict=True))) == len(set(mine)) == len(set(theirs))


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 64, 5_000, dtype=np.uint64) for _ in range(2))
    points = [np.concatenate([simhash.embedded(x, h) for h in range(2)], axis=1) for x in (a, b)]
    exact = np.abs(points[0] - points[1]).sum(axis=1)
    assert (simhash.manhattan(a, b) == exact).all() and (exact <= np.bitwise_count(a ^ b)).all()


def test_keep_one_keeps_columns_and_one_row_of_each(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    ids = sorted(r.doc_id for r in kept.collect())
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and ids == sorted(set(classes.values()))


def test_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_keep_one_links_all_pairs_of_similarity_four_fifths(spark):
    rng = np.random.default_rng(8)
    base = [[f"w{v}" for v in rng.integers(0, 400, rng.integers(3, 200))] for _ in range(40)]
    texts = []
    for words in base:
        texts.append(words)
        for edits in rng.integers(1, 9, 4):
            copy = list(words)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = f"x{rng.integers(0, 1_000)}"
            texts.append(copy)
    passage = [f"p{i}" for i in range(60)]
    texts += [passage + [f"q{i}-{k}" for k in range(30)] for i in range(30)] + [passage + [f"z{i}"] for i in range(30)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = {find(i) for i in range(len(texts))}
    docs = documents(spark, [(i, " ".join(t), *[None] * 6) for i, t in enumerate(texts)])
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == expected and len(expected) < len(texts) - 60


def near_copies(count):
    """Texts of 150 words that differ from one text in about eight words each: similarities around 0.6 to 0.9."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(count):
        words = list(base)
        for at in rng.choice(np.arange(20, 150), rng.integers(2, 7), replace=False):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    return texts


def test_keep_one_asks_the_grid_join_first(spark, monkeypatch):
    asked, join = [], simhash.links

    def links(prints, *more):
        asked.append(join(prints, *more))
        return asked[-1]

    monkeypatch.setattr(simhash, "links", links)
    texts = [f"a{i} " * 3 + " ".join(f"b{i % 7}-{k}" for k in range(60)) for i in range(30)]
    kept = simhash.keep_one(documents(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)]))
    assert kept.count() == 7 and len(asked) == 1 and asked[0].columns == ["a", "b"]


def test_keep_one_lists_no_pairs_of_a_large_group(spark, monkeypatch):
    sizes, write = {}, simhash.materialize

    def materialize(df, label, **options):
        written = write(df, label, **options)
        sizes[label] = max(sizes.get(label, 0), written.count())
        return written

    monkeypatch.setattr(simhash, "materialize", materialize)
    monkeypatch.setattr(simhash, "SET_TILE", 64, raising=False)
    texts = near_copies(300)
    kept = simhash.keep_one(documents(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    group = list(range(300))
    for a in range(300):
        for b in range(a):
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert {r.doc_id for r in kept.collect()} == set(group)
    # A row per set and shingle comes before; links of a group are a few for each set, not its square.
    links = {k: n for k, n in sizes.items() if k in ("candidates", "agreed", "similar-links", "compared-candidates")}
    assert max(links.values()) <= 20 * 300


def links_of_groups(rng):
    """Shuffled links of a path, of trees and of pairs, and the least node of each node's group."""
    nodes = rng.choice(1 << 40, 900, replace=False).astype(np.int64) - (1 << 39)
    pairs = [(i, i - 1) for i in range(1, 300)] + [(i, int(rng.integers(300, i))) for i in range(301, 600)] + [(i, i + 1) for i in range(600, 900, 2)]
    edges = nodes[np.array(pairs)[rng.permutation(len(pairs))]]
    groups = [nodes[:300], nodes[300:600], *nodes[600:].reshape(-1, 2)]
    return edges, {int(n): int(g.min()) for g in groups for n in g if n != g.min()}


@pytest.mark.parametrize("held", [7, 1 << 20])
def test_stars_of_links_held_in_parts_keep_their_closure(held, monkeypatch):
    edges, expected = links_of_groups(np.random.default_rng(6))
    monkeypatch.setattr(simhash, "HELD_LINKS", held)
    while True:
        parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], ["u", "v"]) for part in np.array_split(edges, 50)]
        found = np.concatenate([np.stack([c.to_numpy() for c in b.columns], axis=1) for b in simhash._shorter(iter(parts))])
        if held > len(edges) or len(found) == len(edges) and (found == edges).all():
            break
        edges = found
    assert (found[:, 0] > found[:, 1]).all()
    if held > len(edges):
        assert {int(u): int(v) for u, v in found} == expected and len(found) == len(expected)
    assert {int(u): int(v) for u, v in simhash.stars(found)} == expected


@pytest.mark.parametrize("held", [1 << 20, 100])
def test_components_are_found_in_plans_of_one_join(spark, monkeypatch, held):
    plans, write = [], simhash.materialize

    def materialize(df, label, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label, **options)

    monkeypatch.setattr(simhash, "materialize", materialize)
    monkeypatch.setattr(simhash, "HELD_LINKS", held, raising=False)
    edges, expected = links_of_groups(np.random.default_rng(7))
    frame = spark.createDataFrame([*map(tuple, edges.tolist()), (5, 5)], "a BIGINT, b BIGINT").repartition(7)
    assert sorted((r.node, r.root) for r in simhash.components(frame).collect()) == sorted(expected.items())
    # Few links become stars in the first task that holds them; each step of a later round is a plan of its own.
    assert max(p.count("Join ") for p in plans) <= 1 and (len(plans) == 2 or held == 100)


def test_the_sets_asked_for_are_told_by_a_table_of_bounded_size(spark, monkeypatch):
    sent, broadcast = [], F.broadcast

    def counted(df):
        sent.append(df.count())
        return broadcast(df)

    monkeypatch.setattr(simhash.F, "broadcast", counted)
    monkeypatch.setattr(simhash, "ASKED_BITS", 3, raising=False)
    texts = [f"{k} " + " ".join(f"g{g}-{i}" for i in range(60)) for g in range(40) for k in ("one", "two")] + [" ".join(f"alone{g}-{i}" for i in range(60)) for g in range(20)]
    kept = simhash.keep_one(documents(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)]))
    assert {r.doc_id for r in kept.collect()} == {*range(0, 80, 2), *range(80, 100)}
    assert 0 < max(sent) <= 8
