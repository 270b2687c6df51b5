"""Token ids on disk: frequency-ranked, byte-aligned variable-length numbers.

A file holds blocks of whole documents. A block has its own table of ids, the most frequent
first, and stores each id as its rank in that table: one to four bytes of data, and two
bits of control that tell how many. Control bytes are kept apart from data bytes, so a
decoder looks up the lengths of four numbers at a time and gathers all data bytes of a block
with array operations. Every block can be read by itself.

The blocks are rows of Parquet, written by Spark: committed once, wherever Spark can write.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitmill.llm import bpe

SCHEMA = "part int, block int, n_ids long, doc_ids array<long>, lengths array<long>, ids_by_rank binary, control binary, data binary"

# Lengths of the four numbers of every control byte, and their sum.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative numbers below 2**32."""
    ranks = ranks.astype(np.uint32)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    four = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), four[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that were packed."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    four = np.zeros((n, 4), np.uint8)
    four[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return four.view("<u4").reshape(-1)


def rank_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, most frequent first (ties: smaller id), and the rank of every id."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    used = used[np.lexsort((used, -counts[used]))]
    rank = np.zeros(len(counts), np.uint32)
    rank[used] = np.arange(len(used), dtype=np.uint32)
    return used.astype(np.uint32), rank[ids]


# Bytes of text whose distinct pieces are encoded together; a file's block.
BLOCK_BYTES = 32 << 20

# Pieces whose ids a worker keeps for its next blocks and tasks.
KEPT_PIECES = 300_000

# First bytes of the UTF-8 of white space beyond ASCII.
_WIDE_SPACE = {0xC2, 0xE1, 0xE2, 0xE3}


@lru_cache(maxsize=4)
def _tokenizer(path: str, added: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # Unless asked for, the strings of special tokens in a text are ordinary text.
    tokenizer.encode_special_tokens = not added
    # Ids whose bytes begin with a space (byte-level BPE writes it as U+0120).
    vocabulary = tokenizer.get_vocab()
    spaced = np.zeros(max(vocabulary.values()) + 1, bool)
    spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
    return tokenizer, spaced


def added_tokens(path: str) -> tuple[bytes, ...]:
    """The strings of the file's added tokens, which the library finds before it cuts pieces."""
    tokens = _tokenizer(path, True)[0].get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
        raise ValueError("added tokens that look at the text around them are not supported")
    return tuple(t.content.encode() for t in tokens)


@lru_cache(maxsize=2)
def _kept(path: str, added: bool) -> tuple[dict[bytes, int], list[np.ndarray], list[np.ndarray]]:
    """Pieces that this worker has encoded, by number; their ids, and how many each has."""
    return {}, [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]


def encode_pieces(pieces: list[bytes], path: str, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each distinct piece by the tokenizers library, and each piece's first id.

    Frequent pieces stand in block after block; the first KEPT_PIECES of a worker are encoded once.
    """
    number, ids, sizes = _kept(path, added)
    at = np.fromiter((number.get(p, -1) for p in pieces), np.int64, len(pieces))
    new = np.flatnonzero(at < 0)
    found, first = _encode([pieces[i] for i in new.tolist()], path, added)
    size = np.diff(first)
    # Kept ids and new ones side by side.
    every, lengths = np.concatenate([*ids, found]), np.concatenate([*sizes, size])
    at[new] = len(number) + np.arange(len(new))
    room = min(KEPT_PIECES - len(number), len(new))
    if room > 0:
        number.update(zip((pieces[i] for i in new[:room].tolist()), range(len(number), len(number) + room)))
        ids[:] = [every[: int(lengths[: len(number)].sum())]]
        sizes[:] = [lengths[: len(number)]]
    begins = np.cumsum(lengths) - lengths
    return bpe.gather(every, begins[at], lengths[at]), np.concatenate([[0], np.cumsum(lengths[at])])


def _encode(pieces: list[bytes], path: str, added: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each piece by the tokenizers library, and each piece's first id.

    Pieces that begin with a space and go on with other signs are encoded many in a row:
    the library cuts the row at their spaces again, and no id begins with a space inside such a
    piece. All others are encoded one by one. ``added``: a piece that is the string of an added
    token gets its id.
    """
    tokenizer, spaced = _tokenizer(path, added)
    joined = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == 32 and p[1] > 32 and p[1] not in _WIDE_SPACE]
    chosen = set(joined)
    alone = [i for i in range(len(pieces)) if i not in chosen]
    size = np.zeros(len(pieces), np.int64)
    rows = [b"".join(pieces[i] for i in joined[k : k + 2000]).decode() for k in range(0, len(joined), 2000)]
    found = [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
    first_ids = np.concatenate(found) if found else np.zeros(0, np.int32)
    starts = np.flatnonzero(spaced[first_ids])
    if len(starts) != len(joined):
        # The library knows other code points than the cutter; let each piece stand alone.
        joined, alone, first_ids, starts = [], list(range(len(pieces))), first_ids[:0], starts[:0]
    size[joined] = np.diff(np.append(starts, len(first_ids)))
    single = [x.ids for x in tokenizer.encode_batch_fast([pieces[i].decode() for i in alone], add_special_tokens=False)]
    size[alone] = [len(x) for x in single]
    other_ids = np.array([i for x in single for i in x], np.int32)
    begins = np.zeros(len(pieces), np.int64)
    begins[joined] = starts
    begins[alone] = len(first_ids) + np.cumsum(size[alone]) - size[alone]
    ids = bpe.gather(np.concatenate([first_ids, other_ids]), begins, size)
    return ids, np.concatenate([[0], np.cumsum(size)])


def _write(tokenizer_path: str, end_id: int, added: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        whole = added_tokens(tokenizer_path) if added else ()
        for number, block in enumerate(bpe.blocks(batches, "text", BLOCK_BYTES, whole=whole)):
            docs, lengths, ids = [], [], []
            for rows, found, first in block.texts(*encode_pieces(block.distinct(), tokenizer_path, added)):
                docs.append(rows.column("doc_id"))
                lengths.append(np.diff(first) + 1)
                ids.append(np.insert(found, first[1:], end_id))
            every, length = np.concatenate(ids), np.concatenate(lengths)
            by_rank, ranks = rank_ids(every)
            control, data = pack(ranks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([len(every)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), pa.concat_arrays(docs)),
                    pa.ListArray.from_arrays(pa.array([0, len(length)], pa.int32()), pa.array(length)),
                    *(pa.array([x], pa.binary()) for x in (by_rank.astype("<u4").tobytes(), control, data)),
                ],
                names=["part", "block", "n_ids", "doc_ids", "lengths", "ids_by_rank", "control", "data"],
            )

    return run


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order.

    A null text counts as empty: its ids are the end id alone. Rows without doc_id come
    first; repeated rows stay. Other columns are not read. Texts are range partitioned and
    sorted by doc_id, rows of one doc_id by their text's hash. ``added``: the strings of the
    file's added tokens in a text become their ids, as in the library's plain call; else they are
    ordinary text.
    """
    source = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = source.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(_write(tokenizer_path, end_id, added), SCHEMA).write.option("compression", "none").parquet(path)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = {name: batch.column(name)[i] for name in ("ids_by_rank", "control", "data")}
            table = np.frombuffer(raw["ids_by_rank"].as_buffer(), "<u4")
            ranks = unpack(raw["control"].as_buffer(), raw["data"].as_buffer(), batch.column("n_ids")[i].as_py())
            length = np.asarray(batch.column("lengths")[i].values)
            yield batch, i, table[ranks], np.concatenate([[0], np.cumsum(length)])


def read_token_files(spark: SparkSession, path: str, each, fields: str) -> DataFrame:
    """A row per document of the files: ``doc_id``, ``start``, ``n_tokens``, and what ``each`` makes.

    ``each`` gets the ids of a block and where each document begins, and returns a column
    for every field; ``start`` (long) is the number of ids of all documents before.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, ids, first in _read(batches):
            n = len(first) - 1
            columns = [pa.array(np.full(n, batch.column(name)[i].as_py(), np.int32)) for name in ("part", "block")]
            columns += [batch.column("doc_ids")[i].values, pa.array(first[:-1]), pa.array(np.diff(first)), *each(ids, first)]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"part int, block int, doc_id long, start long, n_tokens long, {fields}")
    kinds = to_arrow_schema(schema)
    files = spark.read.schema(SCHEMA).parquet(path)
    # What lies before a block: the blocks of earlier parts, and earlier ones of its own.
    sizes = files.select("part", "block", "n_ids")
    inside = sizes.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("inside"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    before = inside.join(parts, "part").select("part", "block", (F.col("inside") + F.col("ahead")).alias("before"))
    docs = files.mapInArrow(run, schema).join(before, ["part", "block"])
    return docs.withColumn("start", F.col("start") + F.col("before")).drop("part", "block", "before")


def crc32s(ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """The crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    import zlib

    raw = memoryview(np.ascontiguousarray(ids.astype("<u4")).tobytes())
    ends = (first * 4).tolist()
    return [pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())]
