import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from hitmill.llm import bpe, token_files

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def library(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(3)
    signs = list("aabcdest'' \n\t  .,!12'lmrv") + ["é", "ß", " ", " ", "漢", "😀", "½", "\x1c", "\x85", "​", "'s", "'re", " 'll"]
    some = ["".join(random.choices(signs, k=random.randint(0, 60))) for _ in range(1500)]
    return [*some, "", None, "a" * 3000, "=" * 501, "ab" * 700, " " * 99 + "x", "don't", "'s", " 's", "''s", "<|endoftext|>", "hello  world\n\n next"]


@pytest.mark.parametrize("name", FILES)
def test_encodes_as_the_library_and_decodes_back(name):
    every, encoding, vocabulary = texts(), library(name), bpe.Vocabulary.from_ranks(P.path(name))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(every, pa.string()), "i": list(range(len(every)))})
    seen = 0
    for block in bpe.blocks([batch], "text", limit=20_000):
        for rows, ids, first in block.texts(*block.encode(vocabulary)):
            for k, i in enumerate(rows.column("i").to_pylist()):
                text, own = every[i] or "", ids[first[k] : first[k + 1]]
                assert own.tolist() == encoding.encode_ordinary(text)
                assert vocabulary.decode(own).tobytes() == text.encode()
                seen += 1
    assert seen == len(every)


def test_merges_in_listed_order():
    strings = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    vocabulary = bpe.Vocabulary(strings, merges=[(98, 99, 257), (97, 98, 256), (97, 257, 258)])
    ids, first = vocabulary.replay(np.frombuffer(b"abcabab", np.uint8), np.array([0, 7]))
    assert ids.tolist() == [258, 256, 256] and first.tolist() == [0, 3]


def test_operator_keeps_rows_and_nulls(rows):
    path = P.path(FILES[0])
    df = rows([(1, "x y", "a"), (1, "x y", "a"), (None, None, None), (3, "", "b")], "doc_id long, text string, ids string")
    out = bpe.encode(df, path)
    assert sorted((r.doc_id or -1, r.n_tokens, len(r.ids)) for r in out.collect()) == [(-1, 0, 0), (1, 2, 8), (1, 2, 8), (3, 0, 0)]
    back = bpe.decode(out, path)
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in back.collect()) == [(-1, b""), (1, b"x y"), (1, b"x y"), (3, b"")]
    assert bpe.encode(df.limit(0), path).count() == 0


def test_numbers_of_one_to_four_bytes():
    random.seed(1)
    numbers = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] + [random.getrandbits(random.randint(1, 32)) for _ in range(1001)], np.uint32)
    for part in (numbers, numbers[:1], numbers[:5], numbers[:0]):
        control, data = token_files.pack(part)
        assert len(control) == -(-len(part) // 4)
        assert np.array_equal(token_files.unpack(control, data, len(part)), part)


def test_most_frequent_ids_rank_first():
    by_rank, ranks = token_files.rank_ids(np.array([9, 7, 9, 3, 9, 7, 5]))
    assert by_rank.tolist() == [9, 7, 3, 5] and ranks.tolist() == [0, 1, 0, 2, 0, 1, 3]


def test_token_files_read_back_as_the_library_encodes(llm, rows, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    every = texts()
    data = [(i, t) for i, t in enumerate(every)][::-1] + [(5, "again"), (None, "no id"), (5, "again")]
    path = str(tmp_path / "files")
    tokenizer = P.path("byte_bpe_50k.json")
    token_files.write_token_files(rows(data).repartition(5), path, tokenizer)
    got = [tuple(r) for r in token_files.read_token_files(llm, path, token_files.crc32s, "crc long").collect()]
    library = Tokenizer.from_file(tokenizer)
    library.encode_special_tokens = True
    want, start = {}, 0
    encoded = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in data]
    for i, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0] or 0)):
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {i: sorted((n, c) for d, _, n, c in got if d == i) for i in want} == {i: sorted(v) for i, v in want.items()}
    for i, begin, n, _ in sorted(got, key=lambda x: x[1]):
        assert begin == start
        start += n
    assert [i for i, *_ in sorted(got, key=lambda x: x[1])] == sorted((i for i, _ in data), key=lambda x: (x is not None, x or 0))


def test_empty_token_files(llm, rows, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(rows([]), path, P.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(llm, path, token_files.crc32s, "crc long").count() == 0
