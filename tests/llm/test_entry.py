"""The registered queries on the test tables: against SQL, or against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import oracle
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from hitmill.llm import queries as llm_queries

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, source, lang FROM documents ORDER BY doc_id").fetchall()


def result(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries.QUERIES) == list(range(1, 14))
    assert set(llm_queries.QUERIES) | {"pipeline"} <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(llm_queries.SQL))
def test_matches_sql(spark, con, sf_dir, name):
    assert oracle.spark_table(QUERIES[name](spark, sf_dir)) == oracle.duck_table(con, SQL[name])


def encoding(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op2(spark, sf_dir, docs):
    library = encoding("byte_bpe_multi_50k.tiktoken")
    want = set()
    for i, text, *_ in docs:
        ids = library.encode_ordinary(text or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result(spark, sf_dir, "op2_bpe")}
    assert got == want


def test_op4(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library, want, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), set(), 0
    for i, text, *_ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, sf_dir, "op4_token_files")} == want


def test_op5(spark, sf_dir, docs):
    library = {n: encoding(f"{n}.tiktoken") for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    want, seen = {}, set()
    for _, text, source, lang in docs:
        if text in seen:
            continue
        seen.add(text)
        for name, tokens in library.items():
            sums = want.setdefault((source, lang, name), [0, 0])
            sums[0] += 1
            sums[1] += len(tokens.encode_ordinary(text or "")) + (name == "byte_bpe_multi_50k")
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in result(spark, sf_dir, "op5_token_counts")} == want


def test_op7_finds_every_copied_item(spark, sf_dir, con, docs):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = {(i, j) for i, t, *_ in docs for j, u in items if " ".join(u.lower().split()) in " ".join((t or "").lower().split())}
    got = {(r["doc_id"], r["item_id"]) for r in result(spark, sf_dir, "op7_decontaminate")}
    assert want <= got and len(got - want) <= 0.05 * len(want)


def test_pipeline(spark, sf_dir, docs):
    library = encoding("byte_bpe_multi_50k.tiktoken")
    got = result(spark, sf_dir, "pipeline")
    texts = {i: t for i, t, *_ in docs}
    assert 0.5 * len(docs) < len(got) < len(docs)
    assert len({r["doc_id"] for r in got}) == len(got)
    for r in got:
        text = library.decode(np.frombuffer(r["ids"], "<u4").tolist())
        assert hashlib.sha256(text.encode()).hexdigest() == r["decoded_sha256"] and len(text) == r["n_chars"]
        # What is left are lines of the document, in order.
        left = iter((texts[r["doc_id"]] or "").split("\n"))
        assert text == "" or all(line in left for line in text.split("\n"))
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "byte-level bpe" and len(corpus_pipeline.STAGES) == 5


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).columns == columns


def test_op11(spark, sf_dir, docs):
    from test_simhash import brute

    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in result(spark, sf_dir, "op11_simhash")}
    assert got == brute([(i, t) for i, t, *_ in docs])


def test_op12(spark, sf_dir, docs):
    from test_periods import expected

    got = {r["doc_id"]: tuple(r.values()) for r in result(spark, sf_dir, "op12_periodic_runs")}
    assert set(got) == {i for i, *_ in docs}
    for i, text, *_ in docs:
        if len((text or "").split()) < 1500:
            assert got[i] == expected(i, text)


def test_op13(spark, sf_dir, con):
    from test_whitening import check

    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    check(QUERIES["op13_whitening"](spark, sf_dir).collect(), rows)
