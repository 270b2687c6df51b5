import collections
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from hitmill.llm import licenses, lines, quality, token_counts, toxicity

RANKS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + i for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for i in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed)


def test_quality_counts_and_bands(rows):
    rng = random.Random(1)
    vocabulary = "the of and a in is to was for with as on by at from about between because house river water people little under".split()
    good = lambda: " ".join(rng.choice(vocabulary) + rng.choice(["", "s"]) for _ in range(120))
    data = [(i, good(), "en") for i in range(150)]
    odd = [
        (200, " ".join("".join(rng.choices("ǖɱʒʭ", k=4)) for _ in range(120)), "en"),
        (201, " ".join(str(rng.random()) for _ in range(120)), None),
        (202, "same words again " * 60, "en"),
        (203, None, "en"),
        (204, "", None),
        (None, "a b\na b\n\n \n\na b# <é>\tc", "xx"),
        (206, good(), "zz"),
        (207, good() + "\n" * 3000, "zz"),
        (207, "\n\n \t" + good(), None),
        (208, "x" * 50_000, "en"),
    ]
    out = quality.quality(rows(data + odd, "doc_id long, text string, lang string"), RANKS, PIECES).collect()
    got = collections.Counter((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in out)
    assert got == collections.Counter((i, *base(t)) for i, t, _ in data + odd)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in [*range(150), 206, 207])
    assert not any(kept[i] for i in (200, 202, 203, 204, None, 208))
    assert {r.doc_id: r.band for r in out}[201] == "script:none"
    measures = {tuple(round(r[m], 9) for m in quality.MEASURES) for r in quality.quality(rows([(1, "one two\nthree " + "\n" * 500, "en"), (2, "one two\nthree", "en")], "doc_id long, text string, lang string"), RANKS, PIECES).collect()}
    assert len(measures) == 1


def test_quality_of_rare_languages(rows):
    """Ten documents of a language in a script of its own are judged by their own kind, at any size of the rest."""
    rng = random.Random(4)
    latin = "the of and a in is to was for with as on by at from about between because house river water people little under".split()
    greek = "και το της των με για από που στην είναι ένα σπίτι ποτάμι νερό άνθρωποι μικρό".split()
    text = lambda vocabulary, n=120: " ".join(rng.choice(vocabulary) + rng.choice(["", "s"]) for _ in range(n))
    noise = lambda: " ".join("".join(rng.choices("ǖɱʒʭ", k=4)) for _ in range(120))
    rare = [(i, text(greek), "el") for i in range(10)]
    for many in (30, 300):
        data = [(1000 + i, text(latin), "en") for i in range(many)] + rare + [(500, noise(), "en"), (501, noise(), "el"), (502, noise(), "qq")]
        out = quality.quality(rows(data, "doc_id long, text string, lang string"), RANKS, PIECES).collect()
        kept = {r.doc_id: r.kept for r in out}
        assert all(kept[i] for i, *_ in data if i not in (500, 501, 502)), many
        assert not kept[500] and not kept[501] and not kept[502], many
    alone = quality.quality(rows(rare[:1], "doc_id long, text string, lang string"), RANKS, PIECES).first()
    assert alone.kept and quality.quality(rows([], "doc_id long, text string, lang string"), RANKS, PIECES).count() == 0


def brute_kept(out):
    """The verdicts again, from the measures: weighted quartiles of the three kinds of texts."""
    passed = [r for r in out if not r.base_failed]
    size = lambda r: sum(r.n_tokens >= b for b in quality.SIZE_BOUNDS)

    def weights(rows, m):
        found = collections.Counter()
        for r in rows:
            # Halves go up, as in SQL.
            found[np.floor(r[m] / quality.STEPS[m] + 0.5) * quality.STEPS[m]] += 1
        return found

    def mix(own, wider):
        out, total = collections.Counter(own), sum(wider.values())
        for v, x in wider.items():
            out[v] += x * quality.PRIOR_DOCUMENTS / total
        return out

    def quartile(found, share):
        values = sorted(found)
        counts = [int(np.ceil(found[v] * quality._PARTS - 1e-6)) for v in values]
        place = share * (sum(counts) - 1)
        ends = np.cumsum(counts)
        low, high = (values[int(np.searchsorted(ends, p, "right"))] for p in (np.floor(place), np.ceil(place)))
        return low + (high - low) * (place - np.floor(place))

    kept = []
    for r in out:
        good = not r.base_failed
        for m in quality.MEASURES if good else ():
            rows = [x for x in passed if m != "entropy" or size(x) == size(r)]
            by_script = mix(weights([x for x in rows if x.script == r.script], m), weights(rows, m))
            found = mix(weights([x for x in rows if (x.script, x.band) == (r.script, r.band)], m), by_script)
            one, three = quartile(found, 0.25), quartile(found, 0.75)
            reach = max(quality.REACH * (three - one), 5 * quality.STEPS[m])
            good = good and one - reach - 1e-9 <= r[m] <= three + reach + 1e-9
        kept.append(good)
    return kept


def test_quality_verdicts_equal_brute_force(rows):
    rng = random.Random(9)
    vocabularies = {"en": "the of and house river water people", "el": "και το της των σπίτι ποτάμι", "ru": "и в не на дом река вода"}
    data = []
    for i in range(150):
        lang = rng.choice(["en", "en", "en", "el", "ru", None])
        words = vocabularies[lang or "en"].split()
        strange = [f"{rng.random()}", "ǖɱʒʭ", "zzqqxx"] if rng.random() < 0.1 else words
        data.append((i, " ".join(rng.choice(words if rng.random() < 0.5 else strange) + rng.choice(["", "s", "a", "on"]) for _ in range(rng.choice([60, 120, 700]))), lang))
    out = quality.quality(rows(data, "doc_id long, text string, lang string").repartition(3), RANKS, PIECES).collect()
    want = brute_kept(out)
    assert [r.kept for r in out] == want and 100 < sum(want) < 150


def test_entropy_and_script():
    ids, first = np.array([1, 1, 2, 2, 5, 5, 5]), np.array([0, 4, 4, 7])
    assert quality.entropies(ids, first).tolist() == [1.0, 0.0, 0.0]
    assert [quality.script(t.encode()) for t in ("abc и", "ими a", "漢字", "12 3", "")] == ["Latin", "Cyrillic", "Han", "none", "none"]


def test_lines_above_the_ratio_go(rows):
    data = [(i, "a", f"menu\n text {i}\nmenu \n\nend {i % 3}\r") for i in range(30)]
    # Sites of any size: a header on both pages, on all of nine, and lines of a single page.
    data += [(i, "b", f"menu\nother {i}") for i in (41, 42)]
    data += [(i, "nine", f"header\nown {i}") for i in range(60, 69)]
    data += [(70, "one", "menu\nalone")]
    data += [(50, None, "menu"), (51, "a", None), (52, "a", "menu"), (53, "a", "")]
    df = rows(data, "doc_id long, site string, text string").withColumn("boilerplate", F.lit(1)).withColumn("line", F.lit("x"))
    out = lines.drop_boilerplate(df, F.col("site"), "text", ratio=0.5)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == " text 0\n\nend 0\r" and got[41] == "other 41" and got[50] == "menu" and got[51] is None and got[52] == "" and got[53] == ""
    assert all(got[i] == f"own {i}" for i in range(60, 69)) and got[70] == "menu\nalone"
    third = {r.doc_id: r.text for r in lines.drop_boilerplate(df, F.col("site"), "text", ratio=0.28).collect()}
    assert third[0] == " text 0\n"
    assert lines.drop_boilerplate(df.limit(0), F.col("site"), "text").count() == 0


def test_hosts_and_html_lines(rows):
    urls = ["http://A.example.com:80/x", "https://u:p@b.org./", "//c.net?q", "mailto:x@y.z", "", None, "no url"]
    got = rows([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", lines.host(F.col("u")).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == ["a.example.com", "b.org", "c.net", None, None, None, None]
    html = "<p>one <b>two</b><br/>three<!-- <p> --><script>x\n</script><div a='1'>four</div>"
    assert rows([(1, html)], "i int, t string").select(lines.html_lines(F.col("t"))).first()[0] == "\none two\nthree\nfour\n"


def brute_scan(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    words = cut(text)
    places = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    met, score = set(), 0.0
    for part in re.split(r"\n[ \t\r]*\n", text):
        own = cut(part)
        for label, template, must in licenses.TEMPLATES:
            wanted, size = set(licenses.template_words(template)), -(-3 * len(cut(template.lower())) // 2)
            for i in range(len(own)):
                held = set(own[i : i + size]) & wanted
                if own[i] in wanted and 5 * len(held) >= 4 * len(wanted) and set(must.split()) <= held:
                    met.add(label)
                    score = max(score, len(held) / len(wanted))
    labels = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | met)), 1.0 if places else score)


def test_license_scan_equals_brute_force(rows):
    rng = random.Random(2)
    notices = [t for _, t, _ in licenses.TEMPLATES] + list(licenses.PHRASES.values())
    data = [(0, None), (0, ""), (None, "Under THE mit-license"), (3, "under the mit license under the mit license"), (4, "cc by\nnc"), (5, "émit under the miT licensé"), (6, "... cc_by--nc ")]
    data += [(7, "Kelvin K MIT LICENSE Released under THE"), (3, "under the mit license under the mit license"), (8, "x " * 30_000 + "apache license, VERSION 2")]
    for i in range(10, 200):
        words = rng.choice(notices).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["of", "the", "zzz", "license"])
        if rng.random() < 0.3:
            rng.shuffle(words)
        around = [rng.choice(["the", "of", "this", "work", "copy", "any", "in", "\n", "filler", "version", "2", "0"]) for _ in range(rng.randint(0, 40))]
        at = rng.randint(0, len(around))
        data.append((i, " ".join(around[:at] + words + around[at:])))
    out = licenses.scan(rows(data).withColumn("hash", F.lit(1)).withColumn("label", F.lit(2)).repartition(3))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute_scan(t)) for i, t in data), key=repr)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


WRAPPED = {
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions",
    "mpl-2": " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed",
    "lgpl": "// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software\n// Foundation; either",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a\r\ncopy of this software and associated",
}


def test_notices_over_several_lines(rows):
    film = "the film was released in may under a new title and the driving license scene was cut"
    generic = "the code was released under the license of its owner"
    cut = "Redistribution and use in source and binary\n\nforms, with or without modification, are permitted"
    data = [(label, text) for label, text in WRAPPED.items()] + [("", film), ("", generic), ("", cut), ("", "x " * 400 + generic + " y" * 300)]
    out = licenses.scan(rows([(i, t) for i, (_, t) in enumerate(data)])).collect()
    assert {r.doc_id: r.labels for r in out} == {i: label for i, (label, _) in enumerate(data)}


def test_templates_from_a_table(rows, llm):
    table = llm.createDataFrame([("own", "This notice stands at the top of every file", "notice"), ("empty", "", None), ("free", "take it and go", None)], "label string, text string, must string")
    out = licenses.scan(rows([(1, "this notice stands at\nthe top of each file"), (2, "stands at the top of every file this"), (3, "take and go, it"), (4, None)]), templates=table).collect()
    assert {r.doc_id: r.labels for r in out} == {1: "own", 2: "", 3: "free", 4: ""}


def test_no_texts_no_licenses(rows):
    assert licenses.scan(rows([])).count() == 0


def toxic_texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghi", k=rng.randint(3, 7)))
    bad = ["vileword", "uglyname", "nastycall", "wretch"]
    data, labels = [], []
    for i in range(600):
        words, toxic = [word() for _ in range(rng.randint(20, 150))], i % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(bad) if i % 2 else "qrst" + word()
        data.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return data, labels


def test_toxicity_finds_held_out_texts(rows):
    data, labels = toxic_texts()
    taught = [(i, y) for i, y in labels if i % 3]
    more = [(None, data[0][1]), (900, None), (901, ""), (0, data[0][1])]
    scored = toxicity.toxicity(rows(data + more), rows([*taught, (None, 1), (5, None), (1, 0), (1, 0)], "doc_id long, toxic int"), keep=("text",)).collect()
    assert len(scored) == len(data) + 4 and all(0 <= r.score <= 1 for r in scored)
    truth = dict(labels)
    held = [(r.score >= toxicity.THRESHOLD, truth[r.doc_id] == 1) for r in scored if r.doc_id in truth and r.doc_id % 3 == 0]
    found = sum(a and b for a, b in held)
    assert found >= 0.9 * sum(b for _, b in held) and found >= 0.9 * sum(a for a, _ in held)
    by_id = collections.defaultdict(set)
    for r in scored:
        by_id[r.doc_id].add(round(r.score, 9))
    assert by_id[900] == by_id[901] and by_id[None] == by_id[0] and max(by_id[900]) < toxicity.THRESHOLD


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(77, 1)]])
def test_toxicity_without_toxic_examples(rows, labels):
    scored = toxicity.toxicity(rows([(1, "a b c"), (2, None)]), rows(labels, "doc_id long, toxic int")).collect()
    assert sorted((r.doc_id, r.score) for r in scored) == [(1, 0.0), (2, 0.0)]


def test_the_held_out_fold(rows):
    import zlib

    got = {r.doc_id: r.h for r in rows([(i, "") for i in range(40)] + [(None, "")]).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)}, None: False}


CHANGES = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long"


@pytest.mark.parametrize("merge_at", [16, 2, 3])
def test_totals_follow_all_changes_and_repeated_batches_do_nothing(llm, tmp_path, monkeypatch, merge_at):
    monkeypatch.setattr(token_counts, "MERGE_AT", merge_at)
    rng = random.Random(3)
    totals, state = token_counts.TokenTotals(llm, str(tmp_path / "totals")), {}
    assert totals.totals().count() == 0 and totals.batches() == []
    sent = []
    for number in range(4):
        changes = []
        for _ in range(60):
            key = (rng.randrange(40), rng.choice("AB"))
            op = rng.choice(["insert", "revise", "delete"])
            changes.append((*key, op, rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice([None, rng.randrange(9)])))
        changes += [(None, "A", "insert", "s", "en", 5), (1, None, "insert", "s", "en", 5), (1, "A", "rename", "s", "en", 5), changes[0]]
        by_key = collections.defaultdict(list)
        for doc, tokenizer, op, source, lang, n in changes:
            if doc is not None and tokenizer and op != "rename":
                by_key[doc, tokenizer].append((op == "delete", n or 0, source or "", lang or "", source, lang))
        for key, found in by_key.items():
            gone, n, _, _, source, lang = max(found, key=lambda x: x[:4])
            state.pop(key, None) if gone else state.update({key: (source, lang, n)})
        frame = llm.createDataFrame(changes, CHANGES)
        assert totals.commit(f"batch-{number}", frame)
        sent.append(frame)
        assert not totals.commit(f"batch-{rng.randrange(number + 1)}", rng.choice(sent))
        want = collections.defaultdict(lambda: [0, 0])
        for (_, tokenizer), (source, lang, n) in state.items():
            want[source, lang, tokenizer][0] += 1
            want[source, lang, tokenizer][1] += n
        assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in totals.totals().collect()} == dict(want)
    assert {(r.doc_id, r.tokenizer): (r.source, r.lang, r.n_tokens) for r in totals.ledger().collect()} == state
    assert totals.commit("empty", llm.createDataFrame([], CHANGES)) and totals.batches()[-1] == "empty"
    with pytest.raises(ValueError):
        totals.commit("a/b", sent[0])
    assert totals.batches() == [*(f"batch-{i}" for i in range(4)), "empty"]
    before = sorted(map(tuple, totals.totals().collect()), key=str)
    totals.merge()
    totals.vacuum()
    assert len(totals._folders()) == 1 and len(list((tmp_path / "totals").iterdir())) == 1
    assert totals.batches() == [*(f"batch-{i}" for i in range(4)), "empty"] and not totals.commit("batch-1", sent[0])
    assert sorted(map(tuple, totals.totals().collect()), key=str) == before


def test_an_unfinished_batch_is_not_seen(llm, tmp_path):
    path = str(tmp_path / "totals")
    totals = token_counts.TokenTotals(llm, path)
    rows = llm.createDataFrame([(1, "A", "insert", "s", "en", 5)], CHANGES)
    rows.write.parquet(f"{path}/_writing-one/changes")
    assert totals.totals().count() == 0
    assert totals.commit("one", rows)
    assert [tuple(r) for r in totals.totals().collect()] == [("s", "en", "A", 1, 5)]


def test_a_batch_reads_what_lies_between_its_documents(llm, tmp_path):
    totals = token_counts.TokenTotals(llm, str(tmp_path / "totals"))
    for i in range(20):
        assert totals.commit(f"b{i}", llm.createDataFrame([(10 * i + j, "A", "insert", "s", "en", 1) for j in range(10)], CHANGES))
    assert len(totals._folders()) < token_counts.MERGE_AT and len(totals.batches()) == 20
    assert [tuple(r) for r in totals.totals().collect()] == [("s", "en", "A", 200, 200)]
    plan = totals._read("changes", token_counts._ENTRIES).where("doc_id BETWEEN 5 AND 9")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "Union" not in plan


def test_counts_of_several_vocabularies(rows):
    out = token_counts.count_tokens(rows([(1, "x y"), (2, None), (None, "")]), {"a": RANKS, "b": P.path("byte_bpe_50k.tiktoken")}, ("doc_id",))
    assert sorted((r.doc_id or 0, r.a, r.b) for r in out.collect()) == [(0, 0, 0), (1, 2, 2), (2, 0, 0)]
