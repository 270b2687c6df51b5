import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitmill.llm import decontaminate, ngram_join, paragraphs
from hitmill.llm import words as w
from hitmill.llm.components import components


def grams(text, size):
    words = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if x]
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute_components(data, size, p, q):
    sets = [(i, grams(t, size)) for i, t in data]
    parent = {i: i for i, _ in data}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and q * len(s & u) >= p * len(s | u):
                a_, b_ = sorted((root(i), root(j)))
                parent[b_] = a_
    return {(i, len(s), root(i)) for i, s in sets}


def edited(words, share, rng):
    return [f"e{rng.random()}" if rng.random() < share else x for x in words]


@pytest.mark.parametrize("size,similarity", [(3, (90, 100)), (5, (4, 5))])
def test_ngram_join_equals_brute_force(rows, size, similarity, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 3000)
    rng = random.Random(size)
    data = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 12, 30, 90, 200]))]
        data += [" ".join(edited(base, rng.choice([0, 0, 0.005, 0.02, 0.04, 0.2]), rng)) for _ in range(25)]
    data += ["", " \n", "one", "one", "one two", "ONE Two", "a b c", "tie tie tie tie tie"]
    data = [(i * 3 % 1009, t) for i, t in enumerate(data)]
    monkeypatch.setattr(ngram_join, "RUN", 5)
    monkeypatch.setattr(ngram_join, "SKETCH_ROWS", 100)
    for by_parts in (False, True):
        out = ngram_join.ngram_join(rows(data).repartition(4), size, similarity, by_parts=by_parts)
        got = {tuple(r) for r in out.collect()}
        assert got == brute_components(data, size, *similarity)


def test_sketches_lose_no_link():
    rng = np.random.default_rng(11)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for p, q in ((4, 5), (90, 100)):
        sets = []
        for _ in range(150):
            n = int(rng.choice([1, 5, 40, 240, 260, 500, 520, 3000]))
            base = draw(n)
            sets += [np.unique(base)] + [np.unique(np.concatenate([base[int(rng.integers(0, n // 5 + 1)) :], draw(int(rng.integers(0, n // 5 + 1)))])) for _ in range(2)]
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        sketch = ngram_join.sketches(np.concatenate(sets), first)
        sketch[4] = None
        i, j = np.triu_indices(len(sets), 1)
        may = ngram_join.may_link(i, j, np.diff(first), sketch, (p, q))
        kept = set(zip(i[may].tolist(), j[may].tolist()))
        linked = 0
        for k in range(0, len(sets), 3):
            for x in range(k, k + 3):
                for y in range(x + 1, k + 3):
                    common = len(np.intersect1d(sets[x], sets[y]))
                    if q * common >= p * (len(sets[x]) + len(sets[y]) - common):
                        linked += 1
                        assert (x, y) in kept
        # Nearly all unlike pairs of some size go.
        large = {k for k in range(len(sets)) if len(sets[k]) > 100}
        assert linked > 50 and sum(x // 3 != y // 3 and 4 not in (x, y) and {x, y} <= large for x, y in kept) == 0


def test_unions_of_blocks_lose_no_link():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    met = 0
    for _ in range(60):
        base, shared = draw(80), draw(20)
        other = np.concatenate([draw(60), shared]) if rng.random() < 0.5 else base
        blocks = [[np.unique(np.concatenate([b[: len(b) - 6], draw(int(rng.integers(0, 12))), shared])) for _ in range(5)] for b in (base, other)]
        alike = any(5 * (k := len(np.intersect1d(x, y))) >= 4 * (len(x) + len(y) - k) for x in blocks[0] for y in blocks[1])
        packed = [ngram_join._union(lambda _, b=b: (np.concatenate(b), None))(pa.table({"family": [1] * 5, "part": [1] * 5, "held": [1] * 5})).column("counts")[0] for b in blocks]
        least = sum(min(map(len, b)) for b in blocks)
        rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([2]), pa.array([packed[0].as_py()]), pa.array([packed[1].as_py()]), pa.array([least])], names=["family", "x", "y", "of_x", "of_y", "least"])
        kept = sum(batch.num_rows for batch in ngram_join._may_meet((4, 5))([rows]))
        assert kept or not alike
        # Blocks with a passage in common only stay apart.
        assert kept == (other is base)
        met += kept
    assert 10 < met < 50


@pytest.mark.parametrize("by_parts", [False, True])
def test_large_groups_that_share_a_passage(rows, monkeypatch, by_parts):
    """Near copies that fill many blocks, a group like them, and texts just below the similarity."""
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 2000)
    rng = random.Random(6)
    passage, data = [f"p{i}" for i in range(40)], []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(90)]
        for share in [0.01] * 50 + [0.04] * 10:
            data.append((len(data), " ".join(edited(base, share, rng) + passage)))
    out = ngram_join.ngram_join(rows(data).repartition(3), 5, (4, 5), by_parts=by_parts)
    assert {tuple(r) for r in out.collect()} == brute_components(data, 5, 4, 5)


def test_ngram_join_with_nulls_repeats_and_other_columns(rows):
    same = "a b c d e f g"
    data = [(7, same, 1), (7, same, 1), (3, same, 2), (None, same, 3), (None, "else where now", 4), (5, None, 5), (2, "x y z", 6), (2, "p q r", 7), (9, "p q r", 8)]
    out = ngram_join.ngram_join(rows(data, "doc_id long, text string, component_id int"), 3, (9, 10))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in out.collect())
    assert got == [(-1, 1, None), (-1, 5, 3), (2, 1, 2), (2, 1, 2), (3, 5, 3), (5, 0, 5), (7, 5, 3), (7, 5, 3), (9, 1, 2)]


def test_similar_sets_always_share_a_signature():
    rng = np.random.default_rng(2)
    for similarity in ((90, 100), (4, 5)):
        frequency = rng.integers(0, 9, ngram_join.SLOTS).astype(np.uint8).tobytes()
        parts = ngram_join.Parts(*similarity)
        p, q = similarity
        for _ in range(300):
            n = int(rng.integers(1, 400))
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            cut = int(rng.integers(0, n // 8 + 2))
            other = np.concatenate([base[cut:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 2))).astype(np.uint64)])
            a, b = np.unique(base), np.unique(other)
            shared = len(np.intersect1d(a, b))
            values, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            for signatures, begins in (ngram_join.prefixes(values, first, similarity, frequency), parts.signatures(values, first)):
                if len(b) and q * shared >= p * (len(a) + len(b) - shared):
                    assert np.intersect1d(signatures[begins[0] : begins[1]], signatures[begins[1] : begins[2]]).size


def test_group_bounds_lose_no_component():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 2**62, 60).astype(np.uint64)
        sets += [np.unique(np.where(rng.random(60) < rng.choice([0, 0.02, 0.1]), rng.integers(0, 2**62, 60).astype(np.uint64), base)) for _ in range(40)]
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 8 * (len(sets[i]) + len(sets[j]) - k)}

    def classes(links):
        label = list(range(len(sets)))
        for a, b in sorted(links):
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    got = ngram_join.compare(np.arange(len(sets)), np.concatenate(sets), first, 0, (4, 5))
    assert classes(got) == classes(want)
    half = len(sets) // 2
    across = ngram_join.compare(np.arange(len(sets)), np.concatenate(sets), first, half, (4, 5))
    own = {(i, j) for i, j in want if (i < half) == (j < half)}
    assert classes({*across, *own}) == classes(want)


def test_batches_of_long_texts_are_bounded(llm):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = llm.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 18_000_000 and max(found) < 6_000_000


def test_components_of_chains_stars_and_loops(llm):
    edges = [(i, i + 1) for i in range(50, 90)] + [(3, x) for x in range(200, 260)] + [(7, 7), (8, 9), (9, 8), (8, 9), (None, 1), (2, None)]
    got = {r.node: r.component for r in components(llm.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 50 for i in range(51, 91)}, **{x: 3 for x in range(200, 260)}, 9: 8}
    assert components(llm.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def passage_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (51, 55, 60, 80, 120)]
    data, planted = [], {}
    for i in range(60):
        words = text(rng.randint(60, 300))
        if i < 20:
            k = i % 5
            at = rng.randrange(len(words))
            words[at:at] = shared[k]
            planted.setdefault(k, []).append(i)
        for at in range(30, len(words), rng.randint(40, 90)):
            if i % 2:
                words[at] += "\n"
        data.append((i, " ".join(words)))
    return data, planted


@pytest.mark.parametrize("every", [False, True])
def test_passages_are_found_wherever_they_stand(rows, every):
    data, planted = passage_texts()
    found = paragraphs.repeats(rows(data).repartition(3), every=every).collect()
    assert {r.doc_id for r in found} == {i for ids in planted.values() for i in ids}
    for ids in planted.values():
        groups = [{r.component_id for r in found if r.doc_id == i} for i in ids]
        assert set.intersection(*groups)
    for group in {(r.kind, r.component_id) for r in found}:
        members = [r for r in found if (r.kind, r.component_id) == group]
        kept = [r for r in members if not r.removed]
        assert len(kept) == 1 and (kept[0].doc_id, kept[0].first_word) == min((r.doc_id, r.first_word) for r in members)


def test_near_paragraphs_equal_brute_force(rows):
    rng = random.Random(4)
    data = []
    for family in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([25, 60, 150]))]
        for _ in range(12):
            lines = [" ".join(edited(base, rng.choice([0, 0.01, 0.02, 0.1]), rng)), " ".join(f"x{rng.random()}" for _ in range(30))]
            data.append((len(data), "\n".join(lines)))
    data += [(900, None), (901, ""), (None, data[0][1])]
    lines = [(i, t.split("\n")[0]) for i, t in data if t and i is not None]
    classes = {}
    for i, _, c in brute_components(lines, 5, 4, 5):
        classes.setdefault(c, set()).add(i)
    want = {frozenset(v) for v in classes.values() if len(v) > 1}
    got = {}
    for r in paragraphs.repeats(rows(data)).where("kind = 'paragraph'").collect():
        got.setdefault(r.component_id, set()).add(r.doc_id)
    assert {frozenset(v) for v in got.values()} == want


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.9):
        n = paragraphs.bands(similarity, 2, 0.999)
        assert 1 - (1 - similarity**2) ** n >= 0.999 > 1 - (1 - similarity**2) ** (n - 1)


def test_cuts_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 60).astype(np.uint64)
    around = [np.concatenate([rng.integers(0, 2**63, k).astype(np.uint64), passage, rng.integers(0, 2**63, 40).astype(np.uint64)]) for k in (0, 7, 33)]
    inner = []
    for k, hashes in zip((0, 7, 33), around):
        at = paragraphs.cuts(hashes, np.array([0, len(hashes)])) - k
        inner.append([x for x in at.tolist() if paragraphs.REACH < x < 60 - paragraphs.REACH])
    assert inner[0] == inner[1] == inner[2] and len(inner[0]) >= 2


def test_equal_stretches_share_a_seed():
    rng = np.random.default_rng(1)
    for _ in range(300):
        passage = rng.integers(0, 2**63, 20).astype(np.uint64)
        sides = [np.concatenate([rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64), passage, rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]) for _ in range(2)]
        values, of, _ = paragraphs.seeds(np.concatenate(sides), np.array([0, len(sides[0]), len(sides[0]) + len(sides[1])]), 20)
        assert np.intersect1d(values[of == 0], values[of == 1]).size
    assert not paragraphs.seeds(passage[:19], np.array([0, 19]), 20)[0].size


@pytest.mark.parametrize("size", [19, 20, 21, 25, 30, 40, 60])
def test_recall_and_ends_of_passages(rows, size):
    """Passages inside longer lines of other documents: all from 20 words on, to their ends, and none below."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    data, want = [], set()
    for i in range(60):
        passage = [word() for _ in range(size)]
        for copy in range(2):
            before, after = [word() for _ in range(rng.randint(0, 60))], [word() for _ in range(rng.randint(0, 60))]
            data.append((2 * i + copy, " ".join(before + passage + after)))
            want.add((2 * i + copy, len(before), size, copy == 1))
    found = paragraphs.repeats(rows(data).repartition(4), every=True).where("kind = 'passage'").collect()
    got = {(r.doc_id, r.first_word, r.n_words, r.removed) for r in found}
    assert got == (want if size >= 20 else set())


ITEMS = [
    (1, "What is the tallest mountain of the northern range beyond the river? It is called Grindel Peak by all."),
    (2, "Solve for the unknown quantity when seven apples cost eleven coins and two pears cost five coins. Nine coins."),
    (3, "the the the the the the of of of"),
    (4, "too short"),
    (5, None),
    (1, "What is the tallest mountain of the northern range beyond the river? It is called Grindel Peak by all."),
    (8, " ".join(f"long{i} item{i}" for i in range(150)) + ". last words"),
]


def test_leaks_are_found_and_others_left_alone(rows):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice("the of and river coins mountain is by all cost word stone light".split()) for _ in range(n))
    one, two, long = ITEMS[0][1], ITEMS[1][1], ITEMS[6][1]
    data = [
        (10, f"{filler(300)} {one} {filler(50)}"),
        (11, f"{filler(31)} {two.upper()} {filler(77)}"),
        (12, f"{filler(90)}\n{one.replace(',', '').replace('?', ' ?')}{filler(10)} {two}"),
        (13, filler(2000)),
        (14, None),
        (15, ""),
        (16, f"{filler(500)} {long}"),
        (17, two.replace("apples", "plums")),
        (18, " ".join(reversed(one.split()))),
        (None, one),
        (10, f"{filler(300)} {one} {filler(50)}"),
    ]
    out = decontaminate.leaks(rows(data), rows(ITEMS, "item_id long, text string"))
    assert out.columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
    got = sorted((r.doc_id or -1, r.item_id) for r in out.collect())
    assert got == [(-1, 1), (-1, 1), *[(10, 1)] * 4, (11, 2), (12, 1), (12, 1), (12, 2), (16, 8), (17, 2)]


def halves(text):
    """Three-word sequences of the question, and those with a word of the answer."""
    words, asked = text.split(), len(decontaminate._halves(text)[0].split())
    every = [(tuple(words[i : i + 3]), i + 3 <= asked) for i in range(len(words) - 2)]
    return {g for g, own in every if own}, {g for g, own in every if not own}


def test_short_items_and_scripts_without_spaces(rows):
    items = [
        (1, "日本で一番高い山は何ですか？富士山です。"),
        (2, "what is osmosis?"),
        (3, "Yes."),
        (4, "two words"),
        (5, "ภูเขาที่สูงที่สุดในประเทศไทยคืออะไร ดอยอินทนนท์"),
        (6, "…"),
        (7, "Name the long river that crosses the northern plain below the hills? Vorin."),
        (2, "what is osmosis?"),
    ]
    data = [
        (10, "前の文。日本で一番高い山は何ですか?富士山です。後の文。"),
        (11, "日本で一番高い建物は何ですか?東京の塔です。日本の山は高い。"),
        (12, "they asked: What is\nOSMOSIS, and why"),
        (13, "what osmosis is"),
        (14, "he said yes to two words of mine"),
        (15, "first\n- yes!\nlast"),
        (16, "two words"),
        (17, "xx ภูเขาที่สูงที่สุดในประเทศไทยคืออะไร ดอยอินทนนท์ yy"),
        (18, "Name the long river that crosses the northern plain below the hills? Nobody told."),
        (19, "so: name the long river that crosses the northern plain below the hills. vorin!"),
        (20, None),
    ]
    out = decontaminate.leaks(rows(data), rows(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(10, 1), (12, 2), (12, 2), (15, 3), (16, 4), (17, 5), (19, 7)]
    assert {r.doc_id: r.first_word for r in out}[12] == 2


def test_search_equals_scores_of_all_pairs(rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_WORDS", 400)
    rng = random.Random(8)
    vocabulary = [f"v{int(rng.paretovariate(0.6))}" for _ in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 31, 32, 33, 60])))) for i in range(60)]
    data = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 2:
            item = rng.choice(items)[1].split()
            words[len(words) // 2 : len(words) // 2] = [x if rng.random() > 0.15 else "zz" for x in item]
        data.append((i, " ".join(words)))
    got = {(r.doc_id, r.item_id): (round(r.score, 9), r.first_word) for r in decontaminate.leaks(rows(data), rows(items, "item_id long, text string"), overlap=0.3).collect()}

    df, n, mean = {}, len(items), sum(len(t.split()) for _, t in items) / len(items)
    for _, t in items:
        for x in set(t.split()):
            df[x] = df.get(x, 0) + 1
    want = {}
    for i, t in items:
        words = t.split()
        weight = {x: np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * (f := words.count(x)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean)) for x in set(words)}
        stride = max(32, 1 << (len(words) - 1).bit_length())
        question, answer = halves(t)
        for j, text in data:
            every = text.split()
            for begin in range(0, len(every), stride):
                part = every[begin : begin + 2 * stride]
                score = round(sum(v for x, v in weight.items() if x in set(part)) / sum(weight.values()), 9)
                held = grams(" ".join(part), 3)
                if score >= 0.6 and len(question & held) >= 0.3 * len(question) and len(answer & held) >= 0.3 * len(answer):
                    if (j, i) not in want or score > want[j, i][0]:
                        want[j, i] = (score, begin)
    assert got == want and len(want) > 20


def test_no_items_no_leaks(rows):
    assert decontaminate.leaks(rows([(1, "a b c d e f")]), rows([], "item_id long, text string")).count() == 0


def test_halves():
    assert decontaminate._halves("Who? Me. ") == ("Who?", " Me.")
    assert decontaminate._halves("One sentence.") == ("One sentence.", "")
    assert decontaminate._halves("") == ("", "")


def test_hashes_of_words_do_not_depend_on_the_slice():
    import pyarrow as pa

    one = w.texts(pa.array(["x alpha beta"]))
    two = w.texts(pa.array(["padding words before", "alpha beta"]))
    a, b = (w.word_hashes(t, w.words(t)).tolist() for t in (one, two))
    assert a[1:] == b[3:]
