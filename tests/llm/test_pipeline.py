import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(rows, data):
    return rows([(i, t, "en", source, None if t is None else len(t)) for i, t, source in data], SCHEMA)


def test_copies_of_a_third_of_a_source_keep_their_lines(llm, rows):
    same = "the first line of it\n\nthe second line of it"
    data = [(i, same, "a") for i in range(100)]
    data += [(i, f"menu\nown line {i} of page\nmore of {i}", "a") for i in range(100, 300)]
    # Two copies in a source of a dozen documents, a text of nothing but boilerplate, and empty ones.
    data += [(i, "twice here\nand here", "b") for i in (300, 301)] + [(i, f"line {i}", "b") for i in range(302, 312)]
    data += [(400, "menu", "a"), (401, "menu\n\nmenu ", "a"), (402, "", "a"), (403, None, "a"), (404, same, None)]
    got = {r.doc_id: r for r in corpus_pipeline.drop_lines(llm, table(rows, data), "").collect()}
    assert len(got) == len(data)
    for i, text, _ in data:
        want = text.removeprefix("menu\n") if 100 <= i < 300 else text
        assert got[i].text == want and got[i].n_chars == (None if want is None else len(want)), i


def test_one_copy_of_a_large_copy_group_is_left(llm, rows):
    same = "one two three four five six seven\neight nine ten eleven twelve thirteen"
    data = [(i, same, "a") for i in range(50)] + [(i, f"w{i} x{i} y{i} z{i} u{i} v{i}\nmenu", "a") for i in range(50, 150)]
    clean = corpus_pipeline.drop_lines(llm, table(rows, data), "")
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(llm, clean, "").collect()}
    assert left == {0: same, **{i: f"w{i} x{i} y{i} z{i} u{i} v{i}" for i in range(50, 150)}}


ODD = [
    (None, "a text without an id that is long enough to have some shingles in it", None),
    (None, None, None),
    (7, None, "a"),
    (7, "", "a"),
    (8, " \n\t\n", None),
    (9, "one", "a"),
    (9, "one", "a"),
    (10, "word " * 40_000, "b"),
    (11, "the same text of two rows that repeat one id and all else of it", "b"),
    (11, "the same text of two rows that repeat one id and all else of it", "b"),
    (11, "another text of the same id with other words than those before it", "b"),
    (12, "the same text of two rows that repeat one id and all else of it", "b"),
]


def odd(rows):
    """Rows with nulls, repeats and a long text, and columns whose names the stages use themselves."""
    from pyspark.sql import functions as F

    clashing = ("hash", "score", "node", "component_id", "text_hash", "n", "gone_id", "several")
    return table(rows, ODD).withColumns({name: F.lit(1) for name in clashing})


def texts(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect())


def test_toxicity_keeps_odd_rows(llm, rows, sf_dir):
    assert texts(corpus_pipeline.drop_toxic(llm, odd(rows), sf_dir)) == sorted((-1 if i is None else i, t or "") for i, t, _ in ODD)


def test_near_copies_of_odd_rows(llm, rows):
    got = texts(corpus_pipeline.drop_near_copies(llm, odd(rows), ""))
    # Rows without an id stay, equal rows of an id are one, and 12 copies a text of 11.
    assert got == sorted([(-1, ODD[0][1]), (-1, ""), (7, ""), (7, ""), (8, " \n\t\n"), (9, "one"), (10, ODD[7][1]), (11, ODD[8][1]), (11, ODD[10][1])])


def test_leaks_of_odd_rows(llm, rows, tmp_path):
    items = [(1, ODD[0][1]), (2, None), (3, ""), (4, "nothing that stands in any text here at all")]
    rows(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = texts(corpus_pipeline.drop_leaks(llm, odd(rows), str(tmp_path)))
    assert got == sorted((-1 if i is None else i, t or "") for i, t, _ in ODD[1:])


def test_ids_of_odd_rows(llm, rows):
    out = corpus_pipeline.encode(llm, odd(rows), "").collect()
    import hashlib

    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in out) == sorted((i or -1, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD)


def test_pipeline_equals_its_stages_on_all_rows(llm, sf_dir):
    """Each stage by itself over what the one before kept, against rules computed apart."""
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_lines(llm, corpus_pipeline.drop_toxic(llm, docs, sf_dir), sf_dir)
    source = [(r.doc_id, r.text) for r in kept.collect()]
    grams = {}
    for i, text in source:
        words = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if x]
        grams[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    parent = {i: i for i in grams}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(grams)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if grams[i] and grams[j] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(llm, kept, sf_dir).collect())
    assert got == [i for i in ids if root(i) == i]
