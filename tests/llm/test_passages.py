import random

import pytest

from hitmill.llm import paragraphs


def kept_texts(data, found):
    """The stretches of words of every document that no removed passage covers."""
    gone = {}
    for r in found:
        if r.kind == "passage" and r.removed:
            gone.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    for i, text in data:
        stretch = []
        for at, word in enumerate(text.split()):
            if at in gone.get(i, ()):
                yield " ".join(stretch)
                stretch = []
            else:
                stretch.append(word)
        yield " ".join(stretch)


@pytest.mark.parametrize("every", [False, True])
def test_every_passage_keeps_a_copy(rows, every):
    rng = random.Random(12)
    text = lambda n: ["".join(rng.choices("abcdefgh", k=rng.randint(4, 8))) for _ in range(n)]
    parts = [text(60) for _ in range(14)]
    common = text(50)
    held = [[0], [0, 1], [0, 1], [1]]  # the first two neighbours, and each of them alone
    held += [[k, k + 1] for k in range(2, 8) for _ in range(2)]  # a chain of neighbours
    data = [(i, " ".join(text(30) + [x for k in ks for x in parts[k]] + text(30))) for i, ks in enumerate(held)]
    # A frequent passage between others.
    for i in range(100, 112):
        a, b = parts[9 + i % 2], parts[11 + i % 3]
        data.append((i, " ".join(text(20) + a + common + b + text(20))))
    found = paragraphs.repeats(rows(data).repartition(3), every=every).collect()
    left = list(kept_texts(data, found))
    for part in [*parts[:9], *parts[9:14], common]:
        for at in range(0, len(part) - 8):
            gram = " ".join(part[at : at + 8])
            if any(gram in t for _, t in data):
                assert any(gram in t for t in left), at
    # Copies still go: a part that many hold keeps few of its places.
    middle = " ".join(common[15:35])
    assert sum(middle in t for _, t in data) == 12 and sum(middle in t for t in left) == 1
    for group in {(r.kind, r.component_id) for r in found}:
        members = [r for r in found if (r.kind, r.component_id) == group]
        assert [(r.doc_id, r.first_word) for r in members if not r.removed] == [min((r.doc_id, r.first_word) for r in members)]
