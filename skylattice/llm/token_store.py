"""Token ids in files of directly addressable codes.

Ids are split into byte-sized chunk levels. Level 0 holds the low byte of every id; a bitmap says
which ids continue, and the next level holds the next byte of those alone. A rank directory
(ones before each run of 512 bits) turns a position on one level into a position on the next,
so any id is read with one lookup a level and no block is ever decoded for it.

A store is a folder of Parquet files that Spark commits: a row for each block of
consecutive documents, in ascending doc_id order within and across shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoder import chunk_encoder
from .common import fresh_path, ship, slices, tidy

MAGIC, RUN = b"SKDA", 512
END_ID = 1
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """ids: unsigned, up to 32 bits."""
    rest, parts = np.asarray(ids, np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        runs = np.add.reduceat(_POP[bits], np.arange(0, len(bits), RUN // 8), dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
        directory = (np.cumsum(runs) - runs).astype(np.uint64)
        parts.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        if not more.any():
            return MAGIC + bytes([len(parts)]) + b"".join(parts)
        rest = rest[more] >> np.uint32(8)


class Codes:
    """Random access to the ids of a packed block."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        at, self.levels = 5, []
        for _ in range(blob[4]):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            n_bits, n_runs = -(-n // 8), -(-(-(-n // 8)) // (RUN // 8))
            chunks = np.frombuffer(blob, np.uint8, n, at)
            bits = np.frombuffer(blob, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(blob[at + n + n_bits : at + n + n_bits + 8 * n_runs], np.uint64)
            self.levels.append((chunks, bits, ranks))
            at += n + n_bits + 8 * n_runs

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, pos: int) -> int:
        """Set bits before pos."""
        _, bits, ranks = self.levels[level]
        if not len(bits):
            return 0
        run = min(pos // RUN, len(ranks) - 1)
        first, byte = run * (RUN // 8), pos // 8
        count = int(ranks[run]) + int(_POP[bits[first:byte]].sum())
        return count + (int(_POP[bits[byte] & ((1 << pos % 8) - 1)]) if pos % 8 else 0)

    def __getitem__(self, pos: int) -> int:
        if not 0 <= pos < len(self):
            raise IndexError(pos)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[pos]) << 8 * level
            if not bits[pos // 8] >> (pos % 8) & 1:
                return value
            pos = self._rank(level, pos)
        return value

    def _ranks(self, level: int, pos: np.ndarray) -> np.ndarray:
        """Set bits before each position: the directory's count of the run, and the ones of at most RUN bits behind it."""
        _, bits, ranks = self.levels[level]
        if not len(bits):
            return np.zeros(len(pos), np.int64)
        run = np.minimum(pos // RUN, len(ranks) - 1)
        width = RUN // 8
        at = run[:, None] * width + np.arange(width)  # the bytes of each position's run
        keep = np.clip(pos[:, None] - 8 * at, 0, 8)
        ones = _POP[bits[np.minimum(at, len(bits) - 1)] & ((1 << keep) - 1).astype(np.uint8)]
        return ranks[run].astype(np.int64) + ones.sum(axis=1, dtype=np.int64)

    def spans(self, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The ids between each of the ascending bounds and the next; a span's chunks are all that it touches.

        The directories place all bounds on a level in one go."""
        places = [np.asarray(bounds, np.int64)]
        for level in range(len(self.levels) - 1):
            places.append(self._ranks(level, places[-1]))
        for k in range(len(bounds) - 1):
            edges = [(int(p[k]), int(p[k + 1])) for p in places]
            begin, end = edges[0]
            out, where = self.levels[0][0][begin:end].astype(np.uint32), None
            for level in range(1, len(self.levels)):
                lo, hi = edges[level]
                if lo == hi:
                    break
                above, up_to = edges[level - 1]
                more = np.flatnonzero(np.unpackbits(self.levels[level - 1][1][above // 8 : -(-up_to // 8)], bitorder="little")[above % 8 :][: up_to - above])
                where = more if where is None else where[more]
                out[where] |= self.levels[level][0][lo:hi].astype(np.uint32) << np.uint32(8 * level)
            yield out

    def span(self, begin: int, end: int) -> np.ndarray:
        return next(self.spans(np.array([begin, end])))


def write_store(docs: DataFrame, path: str, tokenizer: str, keep_blanks: bool = False, end_id: int = END_ID, block_tokens: int = 1 << 18) -> None:
    """Write every whole text of docs(doc_id, text) to the folder path.

    One shuffle, by ranges of doc_id; rows are sorted where they land, and a task holds one block at a
    time. Null text: empty (the end id alone). Null doc_id: before all others. Repeated doc_ids are kept,
    in the order of their texts. A long text is a block by itself. Special strings in a text become the special ids that the library gives them; the end id
    tells nothing apart from them, lengths do. Other columns are ignored; an empty table gives an empty store."""
    ship(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, no, start = chunk_encoder(tokenizer, keep_blanks), TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        end = np.array([end_id], np.uint32)
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal no, start, held
            row = {
                "shard": shard, "block": no, "start": start, "tokens": held, "first_doc": names[0], "doc_ids": list(names), "lengths": list(lengths), "codes": pack(np.concatenate(parts)),
            }
            no, start, held = no + 1, start + held, 0
            names.clear(), lengths.clear(), parts.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for part in slices(batch, 1):
                flat, counts = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum(counts)
                for name, a, b in zip(part.column(0).to_pylist(), ends - counts, ends, strict=True):
                    names.append(name)
                    lengths.append(int(b - a) + 1)
                    parts += [flat[a:b], end]
                    held += lengths[-1]
                    if held >= block_tokens:
                        yield flush()
        if names:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(tidy(blocks), STORE).write.parquet(path)


STORE = "shard int, block int, start long, tokens long, first_doc long, doc_ids array<long>, lengths array<long>, codes binary"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only a row for each shard (a range of doc_ids) meets in one task, to sum what is before it."""
    ship(spark)
    store = spark.read.schema(STORE).parquet(path)
    shards = store.groupBy("shard").agg(F.sum("tokens").alias("n"), F.min_by("first_doc", "block").alias("first_doc"))
    before = Window.orderBy("first_doc", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, start, names, sizes, blobs = batch.columns
            for i in range(batch.num_rows):
                codes, lengths = Codes(blobs[i].as_py()), sizes[i].values.to_numpy()
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids.astype("<u4", copy=False)) for ids in codes.spans(np.append(0, ends))]  # each document by itself
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(sums), shard[i].as_py(), np.int32)), names[i].values, pa.array(start[i].as_py() + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64()),
                ], ["shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    docs = store.select("shard", "start", "doc_ids", "lengths", "codes").mapInArrow(tidy(documents), "shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(shards, F.col("shard") == F.col("of")).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def store_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = fresh_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer)
    return read_store(docs.sparkSession, path)
