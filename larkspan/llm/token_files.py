"""Token ids in a compact binary file format, and back.

Ids are replaced by their frequency rank over the whole corpus, so that common
ids are small, and written in as many whole bytes as they need: a control byte
holds the lengths of four ranks (two bits each), the data bytes follow apart.
Numpy decodes a block with one table look-up per control byte.

Block layout, little-endian: magic ``TKB1``, documents u32, ids u64, then the
documents' lengths (u32 each), control bytes, data bytes.  A shard is a range
of doc_id; its blocks come in order.  Blocks are the ``payload`` column of a
table, so Spark's commit protocol covers lost executors on any shared store.
The table of ranks is written beside the blocks.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.bpe import Encoder, byte_letters, read_vocabulary
from larkspan.llm.common import kept, lean, shared_folder, ship

MAGIC = b"TKB1"
BLOCK_IDS = 1 << 18
#: Stands for the rank of an id that never occurs.
UNUSED = 0xFFFFFFFF

#: Length of each of the four ranks that a control byte describes.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    """One block of documents of the given lengths."""
    r = np.ascontiguousarray(ranks, "<u4")
    longest = (int(r.max(initial=1)).bit_length() + 7) // 8
    more = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    for k in range(1, longest):
        more[: len(r)] += r >= 1 << 8 * k
    control = more[0::4] | more[1::4] << 2 | more[2::4] << 4 | more[3::4] << 6
    more, bytes_of = more[: len(r)], r.view(np.uint8).reshape(-1, 4)
    start = np.cumsum(more, dtype=np.int64) - more + np.arange(len(r))
    data = np.empty(len(r) + int(more.sum(dtype=np.int64)), np.uint8)
    data[start] = bytes_of[:, 0]
    for k in range(1, longest):
        at = np.flatnonzero(more >= k)
        data[start[at] + k] = bytes_of[at, k]
    return MAGIC + struct.pack("<IQ", len(lengths), len(r)) + lengths.astype("<u4").tobytes() + control.tobytes() + data.tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ranks) of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n = struct.unpack_from("<IQ", block, 4)
    at = 16 + 4 * docs
    lengths = np.frombuffer(block, "<u4", docs, 16)
    controls = -(-n // 4)
    size = _LENGTHS[np.frombuffer(block, np.uint8, controls, at)].reshape(-1)[:n]
    data = np.zeros(len(block) - at - controls + 3, np.uint8)
    data[:-3] = np.frombuffer(block, np.uint8, offset=at + controls)
    end = np.cumsum(size, dtype=np.int64)
    start = end - size
    ranks = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        ranks[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return lengths, ranks


_WORKER: dict[int, Encoder] = kept(__name__)
#: Pieces that a worker remembers, twice: twice those of op2, as this one keeps no decoder beside them.
PIECES = 600_000


def _encoder(source: bytes) -> Encoder:
    key = zlib.crc32(source)
    if key not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(source.decode()).model
        letters = {byte: letter for letter, byte in byte_letters().items()}
        spelt = str.maketrans({chr(byte): letter for byte, letter in letters.items()})

        def make(pieces: list[str]) -> tuple[np.ndarray, list[int]]:
            """The library's model over pieces that are cut already: its own cutting, which keeps an offset for each character, costs as much again."""
            names = "\n".join(pieces).encode().decode("latin-1").translate(spelt).split(letters[10])
            if len(names) != len(pieces):  # some piece holds the separator
                names = [p.encode().decode("latin-1").translate(spelt) for p in pieces]
            ids: list[int] = []
            ends = []
            for name in names:
                ids += [token.id for token in model.tokenize(name)]
                ends.append(len(ids))
            return np.array(ids, "<u4"), ends

        _WORKER[key] = Encoder(source, make, PIECES)
    return _WORKER[key]


_TOKENS = "doc_id long, n long, ids binary, counts binary"
#: Entries of ``counts``: how often an id occurs.
_COUNT = np.dtype([("id", "<i8"), ("n", "<i8")])


def tokenised(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, ids binary little-endian u16 or u32, counts) of each document, end id included.

    One more row a partition holds nothing but how often each id occurs in it
    (``counts``, else null), so that the texts' ids are not read for that again.
    """
    ship(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source.value)
        known = max(len(encoder.codes.text), end_id + 1)
        width, total = "<u2" if known <= 1 << 16 else "<u4", np.zeros(known, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = encoder.encode_all(part.column(1).to_pylist())
                n = np.array([len(x) + 1 for x in ids], np.int64)
                ends = np.cumsum(n)
                flat = np.full(ends[-1], end_id, width)
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = np.concatenate(ids)
                total += np.bincount(flat, minlength=known)
                at = pa.array(np.append(0, ends) * flat.itemsize, pa.int32())
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, at.buffers()[1], pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), raw, pa.nulls(len(n), pa.binary())], _TOKEN_NAMES)
        found = np.flatnonzero(total)
        counts = np.empty(len(found), _COUNT)
        counts["id"], counts["n"] = found, total[found]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], _TOKEN_NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), _TOKENS)


_TOKEN_NAMES = [c.split()[0] for c in _TOKENS.split(", ")]


def _ids(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """rank of each id, most frequent first, then smallest id; as long as the largest id (the vocabulary bounds it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = np.frombuffer(raw, _COUNT)
                yield pa.RecordBatch.from_arrays([pa.array(found["id"].copy()), pa.array(found["n"].copy())], ["id", "n"])

    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted(rows, key=lambda r: (-r["n"], r["id"]))
    ranks = np.full(max([0, *(r["id"] for r in rows)]) + 1, UNUSED, "<u4")
    for rank, row in enumerate(order):
        ranks[row["id"]] = rank
    return ranks


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``path``/tokens (for reuse), ``path``/ranks and ``path``/blocks in ascending doc_id order, null ids first."""
    spark = docs.sparkSession
    tokenised(docs, vocabulary_path, end_id, id_col, text_col).write.parquet(f"{path}/tokens")
    tokens = spark.read.schema(_TOKENS).parquet(f"{path}/tokens")
    ranks = frequency_ranks(tokens)
    spark.createDataFrame([(ranks.tobytes(),)], "ranks binary").coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(ranks)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        held = before = 0

        def flush() -> pa.RecordBatch:
            payload = pack(np.array([len(x) for x in ids]), shared.value[np.concatenate(ids)])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([payload], pa.binary())], _BLOCK_NAMES)

        for batch in batches:
            for key, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys.append(key)
                ids.append(_ids(n, raw))
                held += n
                if held >= BLOCK_IDS:
                    yield flush()
                    ids, keys, held, before, block = [], [], 0, before + held, block + 1
        if keys:
            yield flush()

    tokens.where("counts IS NULL").select("doc_id", "n", "ids").repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids").mapInArrow(lean(blocks), _BLOCKS).write.parquet(f"{path}/blocks")


#: ``start`` counts the ids of the shard's blocks before, so that a reader needs no more than the shards' totals.
_BLOCKS = "shard int, block long, start long, n long, doc_ids array<long>, payload binary"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary little-endian u32) from the files: start counts the ids of all documents before."""
    ship(spark)
    table = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    ranks = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()["ranks"], "<u4")
    used = np.flatnonzero(ranks != UNUSED)
    back = np.zeros(max(1, len(used)), np.uint32)
    back[ranks[used]] = used
    shared = spark.sparkContext.broadcast(back)
    shards = table.groupBy("shard").agg(F.sum("n").alias("total"))  # a row a shard
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, payload, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lengths, ranks = unpack(payload)
                ids = shared.value[ranks].astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                at = pa.array(np.append(0, ends) * ids.itemsize, pa.int32())
                raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, at.buffers()[1], pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), raw], ["doc_id", "start", "n_tokens", "ids"])

    # Blocks are large: they stay where they are read, the shards' few rows come to them.
    return table.join(F.broadcast(before), "shard").select("doc_ids", "payload", (F.col("base") + F.col("start")).alias("start")).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, vocabulary_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written to the shared folder and read back.

    A null text has the end id only; repeated rows are written one after the
    other.  An empty table gives an empty file and no rows.
    """
    path = f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary_path, end_id, id_col, text_col)
    rows = read_token_files(docs.sparkSession, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
