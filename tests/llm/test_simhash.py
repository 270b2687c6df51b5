import random
import re

import numpy as np
import pytest
import xxhash

from hitmill.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(data, distance=2):
    nodes = [(i, fingerprint(t)) for i, t in data]
    parent = {i: i for i, _ in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(nodes):
        for j, y in nodes[:a]:
            if (x ^ y).bit_count() <= distance:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {(i, f"{x:016x}", root(i)) for i, x in nodes}


def texts(seed):
    rng = random.Random(seed)
    data = []
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([2, 3, 8, 40, 200, 400]))]
        for _ in range(12):
            data.append(" ".join(f"e{rng.random()}" if rng.random() < rng.choice([0, 0, 0.003, 0.01]) else x for x in base))
    return data + ["", " \n\t", None, "ONE two", "one\x0btwo", "É É é È", "tie tie tie tie tie", "x" * 70 + " long ones " * 40, "a " * 70_000]


@pytest.mark.parametrize("crowd,groups", [(128, None), (1, None), (1, 2), (128, 2), (128, 4)])
def test_equals_brute_force(rows, monkeypatch, crowd, groups):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, distance: whole(nodes, distance, groups))
    data = [(i * 7 % 1013 - 3, t) for i, t in enumerate(texts(3))]
    assert {tuple(r) for r in simhash.near_copies(rows(data).repartition(5)).collect()} == brute(data)


def test_other_distances(rows):
    data = [(i, t) for i, t in enumerate(texts(8)[:100])]
    for distance in (0, 1, 3):
        assert {tuple(r) for r in simhash.near_copies(rows(data), distance=distance).collect()} == brute(data, distance)


def test_nulls_repeats_and_other_columns(rows):
    one, other = "a b c d e f g", "else where now then"
    data = [(7, one, 1), (7, one, 1), (3, one, 2), (None, one, 3), (None, "never seen before", 4), (5, None, 5), (4, " ", 6), (9, one, 7), (9, other, 8), (20, other, 9)]
    out = simhash.near_copies(rows(data, "doc_id long, text string, component_id int"))
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in out.collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (4, 4), (5, 4), (7, 3), (7, 3), (9, 3), (9, 3), (20, 3)]
    assert simhash.near_copies(rows([])).count() == 0


def test_radii_lose_no_partner_and_cost_least():
    rng = np.random.default_rng(1)
    for groups, distance in ((2, 2), (3, 2), (4, 2), (3, 4)):
        costs = [np.cumsum(rng.integers(0, 50, (40, distance + 2)), axis=1).astype(float) for _ in range(groups)]
        for c in costs:
            c[:, 0] = 0
        picks = np.stack(simhash.allot(costs, distance), axis=1)
        assert (picks.sum(axis=1) == distance + 1).all() and (picks >= 0).all()
        from itertools import product

        for i in range(40):
            least = min(sum(costs[g][i, u] for g, u in enumerate(us)) for us in product(range(distance + 2), repeat=groups) if sum(us) == distance + 1)
            assert sum(costs[g][i, u] for g, u in enumerate(picks[i])) == least


def test_correlated_bits_share_a_group(rows):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for a, b in ((3, 60), (10, 33), (7, 8)):
        fps = fps & ~np.uint64(1 << b) | ((fps >> np.uint64(a)) & np.uint64(1)) << np.uint64(b)
    groups = simhash.group_bits(rows([(int(np.int64(x)), i) for i, x in enumerate(fps.view(np.int64))], "fp long, node long"), 3)
    assert sorted(sum(groups, [])) == list(range(64)) and sorted(map(len, groups)) == [21, 21, 22]
    assert all(any({a, b} <= set(g) for g in groups) for a, b in ((3, 60), (10, 33), (7, 8)))
