import re

import numpy as np
import pyarrow as pa
import pytest

from hitmill.llm import words as w

TEXTS = ["", "one", " one  two\tthree ", "a b c d a b c d", "é ü\n漢字 x", None, "\n\n", "x" * 5000 + " y"]


def block(texts):
    return w.texts(pa.array(texts, pa.string()))


def test_words_are_those_of_the_pattern():
    found = w.words(block(TEXTS))
    data = block(TEXTS).data.tobytes()
    words = [data[a:b].decode() for a, b in zip(found.starts, found.ends)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert words == [x for t in want for x in t]
    assert found.counts.tolist() == [len(t) for t in want]


def test_equal_words_hash_alike_and_others_do_not():
    texts = block(["ab cd ab", "ab", "ba a\x00 a"])
    found = w.words(texts)
    h = w.word_hashes(texts, found).tolist()
    assert h[0] == h[2] == h[3] and len(set(h)) == 5


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingles_equal_sequences(size):
    texts = block(TEXTS)
    found = w.words(texts)
    values, of, _ = w.shingles(w.word_hashes(texts, found), found.first, size, whole=True)
    values, first = w.distinct(values, of, len(texts))
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        assert first[i + 1] - first[i] == len(want)


def test_only_ascii_letters_become_lower_case():
    assert w.texts(pa.array(["AZÉaz"])).lowered().data.tobytes().decode() == "azÉaz"


def test_slices_hold_every_row_once_and_stay_small():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 30, 3, 3, 3, 0)], "i": list(range(7))})
    parts = list(w.slices([batch], "text", limit=8))
    assert [i for rows, _ in parts for i in rows.column("i").to_pylist()] == list(range(7))
    assert all(len(t.data) <= 8 or len(t) == 1 for _, t in parts)
    assert [len(t.data) for _, t in parts if len(t) == 1 and len(t.data) > 8] == [30]


def test_sliced_and_null_columns():
    column = pa.array(["aa", None, "bb cc", "d"]).slice(1, 2)
    assert w.words(w.texts(column)).counts.tolist() == [0, 2]
    assert len(w.texts(pa.array([], pa.string()))) == 0
    assert np.array_equal(w.texts(pa.array([None, None], pa.string())).offsets, [0, 0, 0])
