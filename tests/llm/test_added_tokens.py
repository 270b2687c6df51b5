import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__ as entry

END = "<|endoftext|>"


def test_op4_gives_added_tokens_their_ids(rows, llm, tmp_path):
    texts = [f"a{END}b", END, f"{END}{END}", f"some words  {END}  more words\n", f" {END} don{END}'t", "<|endoftext", "|>", f"é漢 {END[:-1]} {END[1:]}", None, "", f"<|end{END}oftext|>", "plain text, nothing else", f"x \n{END}\n\n y"]
    rows(list(enumerate(texts))).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    library, want, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = entry.queries()["op4_token_files"](llm, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want
