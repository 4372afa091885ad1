"""Texts of large buckets meet under few rare shingles, and miss no near text of another component."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from lodestone.llm import near_copies as nc

FAMILY = [f"word{i}" for i in range(150)]


def edited(rng, count, most):
    """*count* texts with 1 to *most* replaced words of FAMILY each."""
    for _ in range(count):
        words = list(FAMILY)
        for k in rng.choice(len(words), int(rng.integers(1, most + 1)), replace=False):
            words[k] = f"new{rng.integers(10**6)}"
        yield " ".join(words)


def near(a, b):
    return len(a & b) >= nc.LEAST * len(a | b)


def test_a_family_gives_few_rows_per_text(spark, monkeypatch):
    """Each text of the family was joined to up to 192 keys of large buckets before."""
    staged = {}
    stage = nc.stage
    monkeypatch.setattr(nc, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    docs = spark.createDataFrame(list(enumerate(edited(np.random.default_rng(3), 600, 30))), "doc_id long, text string").repartition(4)
    part = {r.doc_id: r.component for r in nc.groups(docs).collect()}
    assert 1 < len(set(part.values())) < 600
    rows = {name: table.count() for name, table in staged.items() if name != "near-candidates"}
    assert max(rows.values()) <= 8 * 600, rows


def test_groups_of_a_family_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    texts = ["", " ", *edited(rng, 150, 14)]
    # Fingerprints that all are alike: every pair is a candidate.
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    twins = nc.fingerprints(docs, "doc_id", "text").drop(*(f"fp{k}" for k in range(nc.PRINTS)))
    prints = twins.selectExpr("*", *(f"7L as fp{k}" for k in range(nc.PRINTS))).localCheckpoint()
    number = {r.twin: r.doc_id for r in prints.collect()}
    label = list(range(len(texts)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    brute = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if near(sets[a], sets[b]):
            old, new = brute[a], brute[b]
            brute = [new if x == old else x for x in brute]
    for r in nc.near_pairs(docs, prints, "text").collect():
        a, b = number[r.a], number[r.b]
        assert near(sets[a], sets[b])
        label[root(a)] = root(b)
    same = lambda labels: {(a, b) for a, b in combinations(range(len(texts)), 2) if labels[a] == labels[b]}
    assert (0, 1) in same(brute) and 1 < len(set(brute)) < len(texts)
    assert same([root(n) for n in range(len(texts))]) == same(brute)


def test_near_sets_meet(spark):
    """Sets of all sizes, those included that share exactly 0.8."""
    rng = np.random.default_rng(5)
    sets = [set(), set()]
    for size in range(1, 60):
        base = set(range(1000, 1000 + size))
        sets.append(base)
        for lost in {size // 10, size // 9, size // 5, size // 4}:
            kept = set(rng.choice(sorted(base), size - lost, replace=False).tolist())
            sets += [kept, kept | set(rng.integers(10**6, 10**9, size // 20).tolist())]
    rows = [(n, int(rng.integers(0, 3)), sorted(s)) for n, s in enumerate(sets)]
    rows[0], rows[1] = (0, 0, []), (1, 1, [])
    marked = spark.createDataFrame(rows, "twin long, component long, shingles array<long>").repartition(3)
    keys: dict[int, set] = {n: set() for n in range(len(sets))}
    for r in nc.rare_shingles(marked).collect():
        keys[r.twin].add(r.key)
    pairs = [(a, b) for a, b in combinations(range(len(sets)), 2) if rows[a][1] != rows[b][1] and near(sets[a], sets[b])]
    exact = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) == 4 * len(sets[a] | sets[b])]
    assert (0, 1) in pairs and len(pairs) > 300 and len(exact) > 20
    assert all(keys[a] & keys[b] for a, b in pairs)
    assert sum(map(len, keys.values())) < sum(map(len, sets)) / 4


def test_members_near_another_have_a_pair_or_stand_alone(monkeypatch):
    monkeypatch.setattr(nc, "BLOCK", 64)
    rng = np.random.default_rng(1)
    for count in (30, 64, 150):
        fps = rng.integers(0, 1 << 14, count)
        rows = pa.table({"key": np.full(count, 9), "twin": np.arange(count) + 100, "fp": fps})
        found = [r for batch in nc._pairs(rows.to_batches()) for r in zip(*batch.to_pydict().values())]
        covered = {n for r in found for n in r if n is not None}
        pairs = [(a, b) for a, b in combinations(range(count), 2) if int(fps[a] ^ fps[b]).bit_count() <= nc.DISTANCE]
        assert (None, None) in found
        assert {100 + n for pair in pairs for n in pair} <= covered
        assert all(int(fps[a - 100] ^ fps[b - 100]).bit_count() <= nc.DISTANCE for a, b in found if b is not None)
