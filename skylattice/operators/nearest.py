"""Exact vector scoring by matrix products: a batch of frames against a block of probes at a time.

Scores are folded where they arise. What leaves a task is a row for each probe (its best frames, its moments), or what the caller asks for; no row is made for
each pair of frame and probe on the way."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot

#: Bytes of the vectors of a block of probes, which every task gets; scores that a task holds at a time.
BLOCK_BYTES, SCORES = 32 << 20, 1 << 21


@dataclass
class Probes:
    """A block of probes; probe i is (query[i], probe[i]) with the vector of row i."""

    query: np.ndarray
    probe: np.ndarray
    vectors: np.ndarray

    def __len__(self) -> int:
        return len(self.query)

    def columns(self, at: np.ndarray) -> list[pa.Array]:
        return [pa.array(self.query[at]), pa.array(self.probe[at])]


def probe_blocks(probes: DataFrame, most: int = 0) -> Iterator[Probes]:
    """probes(query_id, probe_idx, vector) in blocks of about `most` bytes (BLOCK_BYTES), one after the other; a probe is in one block."""
    few = probes.select(F.col("query_id").cast("long").alias("query_id"), F.col("probe_idx").cast("int").alias("probe_idx"), F.col("vector").cast("array<double>").alias("vector"))
    n, dim = few.agg(F.count("*"), F.max(F.size("vector"))).first()
    parts = max(1, -(-(n or 0) * 8 * (dim or 1) // (most or BLOCK_BYTES)))
    for i in range(parts):
        part = few if parts == 1 else few.where(F.pmod(F.xxhash64("query_id", "probe_idx"), F.lit(parts)) == i)
        found = part.orderBy("query_id", "probe_idx").toArrow()
        if found.num_rows:
            flat = found["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            yield Probes(found["query_id"].to_numpy(), found["probe_idx"].to_numpy(), flat.reshape(found.num_rows, -1))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles; another length is an error."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(vectors) * dim:
        raise ValueError(f"vectors differ in length from {dim}")
    return flat.reshape(len(vectors), dim).astype(np.float64)


def parts_of(batch: pa.RecordBatch, probes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose scores for so many probes are few enough to hold."""
    step = max(1, SCORES // max(1, probes))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def visual_source(frames: DataFrame, probes: DataFrame, source: str = "visual", digits: int | None = None) -> DataFrame:
    """The scores of every frame(row_id, emb) for every probe, spelled out: for results that are that table."""

    def scored(block: Probes) -> DataFrame:
        sent = frames.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            for part in (p for b in batches for p in parts_of(b, len(asked))):
                scores = matrix(part.column(1), asked.vectors.shape[1]) @ asked.vectors.T
                at = np.tile(np.arange(len(asked)), part.num_rows)
                rows = np.repeat(part.column(0).to_numpy(zero_copy_only=False), len(asked))
                flat = scores.ravel() if digits is None else np.round(scores.ravel(), digits)
                yield pa.RecordBatch.from_arrays([*asked.columns(at), pa.array(rows), pa.array(flat)], ["query_id", "probe_idx", "row_id", "score"])

        return frames.select("row_id", "emb").mapInArrow(run, "query_id long, probe_idx int, row_id long, score double")

    every = [scored(b) for b in probe_blocks(probes)] or [frames.sparkSession.createDataFrame([], "query_id long, probe_idx int, row_id long, score double")]
    out = reduce(DataFrame.unionByName, every)
    return out.select("query_id", "probe_idx", F.lit(source).alias("source"), "row_id", "score", F.lit(True).alias("covered"))


def scores_of(cells: DataFrame, frames: DataFrame, probes: DataFrame) -> DataFrame:
    """cells(query_id, probe_idx, row_id, ...) with the score of each: for the rows of a pool."""
    vectors = probes.select("query_id", "probe_idx", "vector")
    met = cells.join(frames.select("row_id", "emb"), "row_id").join(vectors, ["query_id", "probe_idx"])
    return met.withColumn("score", dot(F.col("emb"), F.col("vector"))).drop("emb", "vector")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Rank and keep the k best of each query and probe; ties by row. Spark prunes before the shuffle."""
    if k <= 0:
        raise ValueError(f"k must be positive: {k}")
    order = Window.partitionBy("query_id", "probe_idx").orderBy(F.col("score").desc(), "row_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The best rows of each probe so far, by score and then row, at most per_video of a video."""

    def __init__(self, probes: int, k: int, per_video: int | None):
        self.k, self.per_video = k, per_video
        self.floor = np.full(probes, -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * probes
        self.numbers: dict[str, int] = {}

    def add(self, scores: np.ndarray, rows: np.ndarray, videos: np.ndarray | None, least: float) -> None:
        """scores: a line for each probe. Those that do not exceed `least` are passed over.

        What the quota cuts here it would cut among all rows: whoever is ahead of a row here is matched by as many of the same video there."""
        named = np.zeros(len(rows), np.int64) if videos is None else np.fromiter((self.numbers.setdefault(v, len(self.numbers)) for v in videos), np.int64, len(rows))
        for i, line in enumerate(scores):
            some = np.flatnonzero((line >= self.floor[i]) & (line > least))
            if not len(some):
                continue
            s, r, v = self.held[i]
            s, r = np.concatenate([s, line[some]]), np.concatenate([r, rows[some]])
            v = np.concatenate([v, named[some]])
            order = np.lexsort((r, -s))
            if self.per_video is not None:
                by_video = np.argsort(v[order], kind="stable")
                own = v[order][by_video]
                nth = np.empty(len(order), np.int64)
                nth[by_video] = np.arange(len(order)) - np.searchsorted(own, own)
                order = order[nth < self.per_video]
            order = order[: self.k]
            self.held[i] = s[order], r[order], v[order]
            if len(order) == self.k:
                self.floor[i] = s[order[-1]]


def best_rows(frames: DataFrame, probes: DataFrame, k: int, per_video: int | None = None, least: float = -np.inf, digits: int | None = None, source: str = "visual") -> DataFrame:
    """(query_id, probe_idx, source, row_id, score, covered): candidates for the k best rows of each probe, at most k of them a task.

    With per_video, the best of each video(video_id) count to that number only. One list a probe is carried through all batches of a task."""
    if k <= 0 or per_video is not None and per_video <= 0:
        raise ValueError(f"k and per_video must be positive: {k}, {per_video}")
    columns = ["row_id", "emb", *(["video_id"] if per_video is not None else [])]
    schema = "query_id long, probe_idx int, row_id long, score double"

    def found(block: Probes) -> DataFrame:
        sent = frames.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            best = Best(len(asked), k, per_video)
            for part in (p for b in batches for p in parts_of(b, len(asked))):
                scores = asked.vectors @ matrix(part.column(1), asked.vectors.shape[1]).T
                videos = part.column(2).to_numpy(zero_copy_only=False) if per_video is not None else None
                best.add(scores if digits is None else np.round(scores, digits), part.column(0).to_numpy(zero_copy_only=False), videos, least)
            for lo in range(0, len(asked), 4096):
                lists = best.held[lo : lo + 4096]
                at = np.repeat(np.arange(lo, lo + len(lists)), [len(x[0]) for x in lists])
                yield pa.RecordBatch.from_arrays([*asked.columns(at), pa.array(np.concatenate([x[1] for x in lists]), pa.int64()), pa.array(np.concatenate([x[0] for x in lists]))], ["query_id", "probe_idx", "row_id", "score"])

        return frames.select(*columns).mapInArrow(run, schema)

    every = [found(b) for b in probe_blocks(probes)] or [frames.sparkSession.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, every).select("query_id", "probe_idx", F.lit(source).alias("source"), "row_id", "score", F.lit(True).alias("covered"))


def scan_top_k(frames: DataFrame, probes: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, probe_idx, rank, row_id, score): the k best rows for each probe by one pass of matrix products a block of probes."""
    return top_k(best_rows(frames, probes, k, digits=digits), k).select("query_id", "probe_idx", "rank", "row_id", "score")


def folded(frames: DataFrame, probes: DataFrame, digits: int | None = None) -> DataFrame:
    """(query_id, probe_idx, n, mean, m2): count, mean and sum of squared distances of each probe's scores, a row for each task."""
    schema = "query_id long, probe_idx int, n long, mean double, m2 double"

    def one(block: Probes) -> DataFrame:
        sent = frames.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            n, mean, m2 = 0, np.zeros(len(asked)), np.zeros(len(asked))
            for part in (p for b in batches for p in parts_of(b, len(asked))):
                scores = asked.vectors @ matrix(part.column(0), asked.vectors.shape[1]).T
                scores = scores if digits is None else np.round(scores, digits)
                m, own = part.num_rows, scores.mean(axis=1)
                apart = own - mean
                m2 += ((scores - own[:, None]) ** 2).sum(axis=1) + apart**2 * (n * m / (n + m))
                mean += apart * (m / (n + m))
                n += m
            if n:
                yield pa.RecordBatch.from_arrays([*asked.columns(np.arange(len(asked))), pa.array(np.full(len(asked), n)), pa.array(mean), pa.array(m2)], ["query_id", "probe_idx", "n", "mean", "m2"])

        return frames.select("emb").mapInArrow(run, schema)

    every = [one(b) for b in probe_blocks(probes)] or [frames.sparkSession.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, every)


def over_batches(rows: DataFrame, block: Probes, columns: list[str], work: Callable[[pa.RecordBatch, Probes], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work over slices of rows(columns) that fit with the block's scores into memory."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts_of(b, len(sent.value))):
            yield from work(part, sent.value)

    return rows.select(*columns).mapInArrow(run, schema)
