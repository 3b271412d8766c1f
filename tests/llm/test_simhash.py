"""SimHash near-duplicates against all-pairs brute force."""

import random

import numpy as np
import pytest
import xxhash

from latecomer.llm import simhash as S
from latecomer.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=2):
    """Smallest id of the component of every (id, fingerprint)."""
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, x in prints:
        for b, y in prints:
            if a < b and (x ^ y).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i, _ in prints}


def _near(rng, base, flips):
    for b in rng.sample(range(64), flips):
        base ^= 1 << b
    return base


def _frame(spark, values):
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    return spark.createDataFrame(signed, "fp bigint")


@pytest.mark.parametrize("crowded", [0, 1, 50, S.CROWDED])
def test_links_connect_what_brute_force_connects(spark, crowded):
    rng = random.Random(7)
    values = {0, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        values |= {_near(rng, base, rng.randint(0, 4)) for _ in range(12)}
    hub = rng.getrandbits(64)
    values |= {hub ^ (1 << 63) ^ i for i in range(40)}             # shares whole groups of bits
    values = sorted(values)
    found = S.links(_frame(spark, values), crowded=crowded)
    pairs = [(r.a % 2**64, r.b % 2**64) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {v: find(v) for v in values} == brute_components([(v, v) for v in values])
    if not crowded:
        assert {frozenset(p) for p in pairs} == {
            frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    costs = [np.cumsum(rng.random((30, 4)), axis=1) for _ in range(3)]
    for c in costs:
        c[:, 0] = 0
    chosen = S.allocate(costs)
    assert (chosen.sum(axis=1) == 2 - 3 + 1).all()
    for row in range(30):
        best = min(sum(costs[g][row, u] for g, u in enumerate((a, b, 3 - a - b)))
                   for a in range(4) for b in range(4 - a))
        assert abs(sum(costs[g][row, chosen[row, g] + 1] for g in range(3)) - best) < 1e-9


def test_groups_hold_correlated_bits():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (500, 64))
    for k in range(10):
        bits[:, 6 * k] = bits[:, 0]
    groups = S.group_bits(500, bits.T @ bits)
    assert sorted(b for g in groups for b in g) == list(range(64))
    home = next(g for g in groups if 0 in g)
    assert {6 * k for k in range(10)} <= set(home)


def test_edge_cases_and_repeats(spark, frame, folder):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, long), (7, long), (7, long),
            (None, long), (8, "É b c d"), (9, "é b c d"), (10, "alpha beta gamma delta")]
    docs = frame(rows)
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fp % 2**64 == brute_fingerprint(next(t for i, t in rows if i == r.id))
    by = {(r.id): r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[6] == by[7] == by[None] == 6
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in by.values()})
    empty = docs.limit(0)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_query_matches_brute_force(spark, frame, folder):
    rng = random.Random(3)
    base = [f"word{rng.randint(0, 300)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base) if i % 3 else [f"own{i}x{k}" for k in range(50)]
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    root = folder(documents=frame(rows))
    got = S.op1_simhash_near_dedup(spark, root).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{fp:016x}", want[i]) for i, fp in prints}


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 99) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 99 for i in [99, *range(101, 160)]}}
