"""The score matrix of frames, probes and sources, without a row for each of its cells.

A text source scores few frames above zero: its moments follow from those hits and from how many frames it covers, and its nominations are hits.
The vector source is folded a batch at a time into moments and best rows. So the two barriers of a run, moments and nominations, need neither
zeros nor the dense scores of frames that nobody nominates; all sources are looked up for the rows of the pool alone.
Only a result that is the whole matrix is spelled out, frame by frame, from a frame's few hits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import nearest, pooling
from .fusion import LEAST_SIGMA, WEIGHTS, weight_of
from .lexical import Sparse

_PROBE = ["query_id", "probe_idx"]
_LONG = "query_id long, probe_idx int, source string, row_id long, score double, covered boolean, z double"
_FUSED = "query_id long, probe_idx int, row_id long, s double"


def sparse_moments(source: Sparse, probes: DataFrame) -> DataFrame:
    """(query_id, probe_idx, n, mu, sigma) over all covered rows: hits as they are, and a zero for each covered row without one.

    With m and M2 of the h hits, mu = h m / n, and the squared distances sum up to M2 + h (m - mu)^2 + (n - h) mu^2."""
    own = source.hits.groupBy(*_PROBE).agg(F.count("*").alias("h"), F.avg("score").alias("m"), (F.var_pop("score") * F.count("*")).alias("m2"))
    size = source.covered.agg(F.count("*").alias("n"))  # one row
    each = probes.select(*_PROBE).join(own, _PROBE, "left").na.fill(0, ["h", "m", "m2"]).crossJoin(F.broadcast(size))
    h, n = F.col("h"), F.col("n")
    mu = F.when(n > 0, h * F.col("m") / n)
    apart = F.col("m2") + h * (F.col("m") - F.col("mu")) ** 2 + (n - h) * F.col("mu") ** 2
    return each.withColumn("mu", mu).select(*_PROBE, "n", "mu", F.sqrt(apart / n).alias("sigma"))


def dense_moments(folded: DataFrame) -> DataFrame:
    """The same from nearest.folded: the tasks' means around their common one."""
    every = Window.partitionBy(*_PROBE)
    near = folded.withColumn("mu", F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every))
    out = near.groupBy(*_PROBE).agg(F.sum("n").alias("n"), F.first("mu").alias("mu"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("mu")) ** 2).alias("m2"))
    return out.select(*_PROBE, "n", "mu", F.sqrt(F.col("m2") / F.col("n")).alias("sigma"))


def _z(score: Column) -> Column:
    return F.when(F.col("covered") & (F.col("sigma") >= LEAST_SIGMA), (score - F.col("mu")) / F.col("sigma")).otherwise(0.0)


class ScoreMatrix:
    """frames(row_id, video_id, emb), probes(query_id, probe_idx, vector), text sources by name.

    Scores count to `digits` decimals, so that rounding in sums does not decide ties."""

    def __init__(self, frames: DataFrame, probes: DataFrame, texts: dict[str, Sparse], visual: str | None = "visual", digits: int = 9):
        self.frames, self.probes, self.visual, self.digits = frames, probes, visual, digits
        self.texts = {name: Sparse(staged(s.hits.withColumn("score", F.round("score", digits)), f"hits-{name}"), s.covered) for name, s in texts.items()}

    @property
    def sources(self) -> list[str]:
        return [*([self.visual] if self.visual else []), *self.texts]

    @cached_property
    def moments(self) -> DataFrame:
        """(query_id, probe_idx, source, n, mu, sigma), a row for each probe and source; staged."""
        each = [sparse_moments(s, self.probes).withColumn("source", F.lit(name)) for name, s in self.texts.items()]
        if self.visual:
            each.append(dense_moments(nearest.folded(self.frames, self.probes, self.digits)).withColumn("source", F.lit(self.visual)))
        return staged(reduce(DataFrame.unionByName, each).select(*_PROBE, "source", "n", "mu", "sigma"), "moments")

    def coverage(self) -> DataFrame:
        """(source, coverage): the share of frames that each source has something to say about."""
        all_ = self.frames.agg(F.count("*").alias("frames"))
        rows = [s.covered.agg(F.count("*").alias("n")).withColumn("source", F.lit(name)) for name, s in self.texts.items()]
        if self.visual:
            rows.append(all_.select(F.col("frames").alias("n"), F.lit(self.visual).alias("source")))
        share = F.when(F.col("frames") > 0, F.col("n") / F.col("frames")).otherwise(0.0)
        return reduce(DataFrame.unionByName, rows).crossJoin(F.broadcast(all_)).select("source", share.alias("coverage"))

    def nominated(self, per_source: int = pooling.PER_SOURCE, per_video: int | None = pooling.PER_VIDEO) -> DataFrame:
        """What pooling.nominate gives for the whole matrix, from hits and from the tasks' best rows."""
        each = [s.hits.select(*_PROBE, F.lit(name).alias("source"), "row_id", "score", F.lit(True).alias("covered")) for name, s in self.texts.items()]
        if self.visual:
            each.append(nearest.best_rows(self.frames, self.probes, per_source, per_video, 0.0, self.digits, self.visual))
        return pooling.nominate(reduce(DataFrame.unionByName, each), self.frames, per_source, per_video)

    def rows(self, some: DataFrame) -> DataFrame:
        """(query_id, probe_idx, source, row_id, score, covered, z) of some(query_id, row_id), different rows, for all probes of their query."""
        cells = staged(some.select("query_id", "row_id"), "cells").join(self.probes.select(*_PROBE), "query_id")
        each = []
        for name, s in self.texts.items():
            found = cells.join(s.covered.select("row_id", F.lit(True).alias("covered")), "row_id", "left").join(s.hits.select(*_PROBE, "row_id", "score"), [*_PROBE, "row_id"], "left")
            each.append(found.select(*_PROBE, F.lit(name).alias("source"), "row_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("covered", F.lit(False)).alias("covered")))
        if self.visual:
            found = nearest.scores_of(cells, self.frames, self.probes)
            each.append(found.select(*_PROBE, F.lit(self.visual).alias("source"), "row_id", F.round("score", self.digits).alias("score"), F.lit(True).alias("covered")))
        return reduce(DataFrame.unionByName, each).join(self.moments, [*_PROBE, "source"]).withColumn("z", _z(F.col("score"))).drop("n", "mu", "sigma")

    def fused_rows(self, some: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
        """(query_id, probe_idx, row_id, s): weighted sums of z for the rows asked."""
        return self.rows(some).groupBy(*_PROBE, "row_id").agg(F.sum(weight_of(weights) * F.col("z")).alias("s"))

    def _by_frame(self, block: nearest.Probes) -> DataFrame:
        """(row_id, emb, mask, hits): each frame with the text sources that cover it, by bit, and its hits with the numbers of source and probe."""
        spark = self.frames.sparkSession
        number = spark.createDataFrame(pa.table({"query_id": block.query, "probe_idx": block.probe, "i": np.arange(len(block), dtype=np.int32)}))
        out = self.frames.select("row_id", "emb")
        if not self.texts:
            return out.withColumns({"mask": F.lit(0).cast("long"), "hits": F.lit(None).cast("array<struct<k:int,i:int,score:double>>")})
        hits = reduce(DataFrame.unionByName, [s.hits.select(*_PROBE, "row_id", "score", F.lit(k).alias("k")) for k, s in enumerate(self.texts.values())])
        hits = hits.join(F.broadcast(number), _PROBE).groupBy("row_id").agg(F.collect_list(F.struct("k", "i", "score")).alias("hits"))  # as many as a frame has cells here
        covered = reduce(DataFrame.unionByName, [s.covered.select("row_id", F.lit(1 << k).cast("long").alias("bit")) for k, s in enumerate(self.texts.values())])
        covered = covered.groupBy("row_id").agg(F.bit_or("bit").alias("mask"))
        return out.join(covered, "row_id", "left").join(hits, "row_id", "left").select("row_id", "emb", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"), "hits")

    def _moments_of(self, block: nearest.Probes) -> tuple[np.ndarray, np.ndarray]:
        """mu and sigma, a line for each source and a column for each probe of the block."""
        mu, sigma = np.zeros((2, len(self.sources), len(block)))
        at = {(int(q), int(p)): i for i, (q, p) in enumerate(zip(block.query, block.probe, strict=True))}
        spark = self.frames.sparkSession
        own = spark.createDataFrame(pa.table({"query_id": block.query, "probe_idx": block.probe}))
        for r in self.moments.join(F.broadcast(own), _PROBE).toLocalIterator():
            place = self.sources.index(r["source"]), at[r["query_id"], r["probe_idx"]]
            mu[place], sigma[place] = r["mu"] or 0.0, r["sigma"] or 0.0
        return mu, sigma

    def _spelled(self, weights: dict[str, float] | None) -> DataFrame:
        names, visual, digits, n_texts = self.sources, self.visual, self.digits, len(self.texts)
        if weights is not None and (unknown := [s for s in names if s not in weights]):
            raise ValueError(f"no weight for source {unknown[0]}")

        def one(block: nearest.Probes) -> DataFrame:
            mu, sigma = self._moments_of(block)

            def work(part: pa.RecordBatch, asked: nearest.Probes) -> Iterator[pa.RecordBatch]:
                n, p = part.num_rows, len(asked)
                row_ids, mask, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(), part.column(3)
                flat = lists.flatten()
                lengths = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
                whose, (k, i, score) = np.repeat(np.arange(n), lengths), (flat.field(f).to_numpy(zero_copy_only=False) for f in ("k", "i", "score"))
                at, rows = np.tile(np.arange(p), n), np.repeat(row_ids, p)
                total = np.zeros((n, p))
                for line, name in enumerate(names):
                    if weights is not None and weights[name] == 0:
                        continue
                    if name == visual:
                        scores, covered = np.round(nearest.matrix(part.column(1), asked.vectors.shape[1]) @ asked.vectors.T, digits), np.ones((n, p), bool)
                    else:
                        source = line - (len(names) - n_texts)
                        scores, mine = np.zeros((n, p)), k == source
                        scores[whose[mine], i[mine]] = score[mine]
                        covered = np.repeat((mask >> source & 1).astype(bool)[:, None], p, axis=1)
                    varies = sigma[line] >= LEAST_SIGMA
                    z = np.where(covered & varies, (scores - mu[line]) / np.where(varies, sigma[line], 1.0), 0.0)
                    if weights is None:
                        yield pa.RecordBatch.from_arrays([*asked.columns(at), pa.array([name]).take(pa.array(np.zeros(n * p, np.int32))), pa.array(rows), *(pa.array(x.ravel()) for x in (scores, covered, z))], ["query_id", "probe_idx", "source", "row_id", "score", "covered", "z"])
                    else:
                        total += weights[name] * z
                if weights is not None:
                    yield pa.RecordBatch.from_arrays([*asked.columns(at), pa.array(rows), pa.array(total.ravel())], ["query_id", "probe_idx", "row_id", "s"])

            return nearest.over_batches(self._by_frame(block), block, ["row_id", "emb", "mask", "hits"], work, _LONG if weights is None else _FUSED)

        every = [one(b) for b in nearest.probe_blocks(self.probes)] or [self.frames.sparkSession.createDataFrame([], _LONG if weights is None else _FUSED)]
        return reduce(DataFrame.unionByName, every)

    def scores(self) -> DataFrame:
        """The whole matrix, spelled out: (query_id, probe_idx, source, row_id, score, covered, z) of every frame."""
        return self._spelled(None)

    def fused(self, weights: dict[str, float] = WEIGHTS) -> DataFrame:
        """(query_id, probe_idx, row_id, s) of every frame, summed where its scores arise."""
        return self._spelled(weights)
