"""The flagship: probes, four sources, fusion, pool, rerank, alignment, ranked answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import coerced_kind, declarativize, probes
from ..operators import fusion, matrix, pooling, rerank, sequence
from ..sources.staging import staged


@dataclass
class Settings:
    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.WEIGHTS))
    stage_weights: dict[str, float] = field(default_factory=lambda: dict(rerank.STAGE_WEIGHTS))
    per_source: int = pooling.PER_SOURCE
    per_video: int | None = pooling.PER_VIDEO
    cap: int = pooling.CAP
    answers: int = 100


def probe_table(queries: DataFrame) -> DataFrame:
    """(query_id, kind, probe_idx, text, quoted) of queries(query_id, text, kind): questions lose their asking words first."""
    text = F.when(F.col("kind") == "qa", declarativize(F.col("text"))).otherwise(F.col("text"))
    found = queries.select("query_id", "kind", probes(text).alias("p"), text.alias("whole"))
    kind = coerced_kind(F.col("kind"), F.size("p"))
    every = F.when(F.size("p") > 0, F.col("p")).otherwise(F.array(F.struct(F.lit(0).alias("probe_idx"), F.col("whole").alias("text"), F.array().cast("array<string>").alias("quoted"))))
    return found.select("query_id", kind.alias("kind"), F.explode(every).alias("e")).select("query_id", "kind", "e.probe_idx", "e.text", "e.quoted")


def retrieve(scores: matrix.ScoreMatrix, settings: Settings | None = None, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fused, pool) of a score matrix; extra: model scores of some rows, as for rerank.combine.

    Without extra scores, fused has the rows that any source nominates: the only barriers are the moments of each source and the nominations.
    A model's scores are weighed against those of all frames, so with them fused has all."""
    s = settings or Settings()
    nominated = staged(scores.nominated(s.per_source, s.per_video), "nominated")
    fused = scores.fused_rows(nominated.select("query_id", "row_id").distinct(), s.weights)
    pool = pooling.union_pool(nominated, fusion.best_over_probes(fused), s.cap)
    if extra is not None:
        fused = rerank.combine(scores.fused(s.weights), extra, s.stage_weights)
    return fused, pool


def answer(frames: DataFrame, fused: DataFrame, pool: DataFrame, n_probes: int, settings: Settings | None = None) -> DataFrame:
    """Ranked answers of queries with n_probes events each: pool rows only, times in frame order."""
    s = settings or Settings()
    wide = fused.join(pool.select("query_id", "row_id"), ["query_id", "row_id"], "left_semi").groupBy("query_id", "row_id")
    wide = wide.agg(*[F.max(F.when(F.col("probe_idx") == i, F.col("s"))).alias(f"s{i}") for i in range(n_probes)])
    cells = wide.join(frames.select("row_id", "video_id", "frame_idx"), "row_id")
    return sequence.emit(cells, n_probes, s.answers)
