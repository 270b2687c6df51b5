import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hitmill.llm import periods


def brute_runs(words, repeats=4):
    """All (start, length, smallest period), by trying every period on every stretch."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= repeats * q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def cases(seed):
    rng = random.Random(seed)
    out = [[], ["x"], list("aaaa"), list("aaaaa"), list("aaaaaa"), list("abababab"), ["z"] * 700, fibonacci(900), [f"{bin(i).count('1') % 2}" for i in range(1024)] * 5]
    for _ in range(60):
        alphabet = rng.choice([1, 2, 2, 3, 1000])
        word = lambda: str(rng.randrange(alphabet))
        text = []
        for _ in range(rng.randrange(1, 6)):
            unit = [word() for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40, 64, 100]))]
            if rng.random() < 0.4:
                unit = unit[: rng.randrange(1, 5)] * rng.randrange(1, 40) + unit
            text += [word() for _ in range(rng.randrange(20))]
            times = rng.choice([1, 2, 3, 4, 4, 5, 9])
            text += (unit * (times + 1))[: len(unit) * times + rng.randrange(len(unit) + 1)]
        out.append(text)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    texts = cases(seed)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    names = {}
    values = np.array([hash_of(names, x) for t in texts for x in t], np.uint64)
    found = periods.find_runs(values, first)
    for i, t in enumerate(texts):
        mine = [(int(a - first[i]), int(b - a), int(p)) for a, b, p in found if first[i] <= a < first[i + 1]]
        assert mine == brute_runs(t), (seed, i)


def hash_of(names, x):
    return names.setdefault(x, int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little"))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [r for r in brute_runs(words) if r[1] >= 6]
    from fractions import Fraction

    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    return (doc_id, n, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_query_equals_brute_force(rows):
    rng = random.Random(4)
    data = [(i * 3 - 30, " ".join(t)) for i, t in enumerate(cases(99))]
    data += [(i, rng.choice(["", " \n"]).join(f"w{rng.randrange(9)} " for _ in range(rng.randrange(300)))) for i in range(1000, 1120)]
    data += [(None, "a b " * 9), (None, None), (5, None), (5, None), (6, ""), (7, " \t\n"), (8, "é É " * 7), (9, "same " * 60_000)]
    got = sorted((tuple(r) for r in periods.periodic_runs(rows([(i, t, 1) for i, t in data], "doc_id long, text string, start int").repartition(4), repeat=True).collect()), key=str)
    want = sorted((expected(i, t) for i, t in data if len(t or "") < 100_000), key=str)
    long = [r for r in got if r[1] == 60_000]
    assert [r for r in got if r[1] != 60_000] == want
    assert [r[2:7] for r in long] == [(1, 0, 60_000, 1, 60_000_000)]
    assert any(r[2] for r in want) and periods.periodic_runs(rows([])).count() == 0
