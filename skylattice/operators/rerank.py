"""Second-stage scorers: object crops, pluggable model scores, and their combination."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import BOX_LEAST, box_area
from . import nearest
from .fusion import fuse

#: Weights of the stages, rows a model looks at, crops a frame (fixed values).
STAGE_WEIGHTS = {"fused4": 1.0, "crop": 0.0, "vlm": 0.25}
SHORTLIST, MAX_CROPS = 160, 2


def crops(objects: DataFrame, rows: DataFrame, classes: list[str] | None = None, per_frame: int = MAX_CROPS, least: float = BOX_LEAST) -> DataFrame:
    """The largest boxes of each row: (row_id, entity, box, area, pos), from
    objects(video_id, n, detection_class_entities, detection_boxes) of rows(row_id, video_id, n)."""
    each = rows.join(objects, ["video_id", "n"]).select("row_id", F.posexplode(F.arrays_zip("detection_class_entities", "detection_boxes")).alias("pos", "o"))
    each = each.select("row_id", "pos", F.col("o.detection_class_entities").alias("entity"), F.col("o.detection_boxes").alias("box")).withColumn("area", box_area(F.col("box"))).where(F.col("area") >= least)
    if classes is not None:
        each = each.where(F.col("entity").isin(classes))
    order = Window.partitionBy("row_id").orderBy(F.col("area").desc(), "pos")
    return each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_frame).drop("nth")


def crop_source(crop_vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """The best crop of each row, even if all are negative; rows without crops are absent, that is, not covered.

    Products of crops(row_id, vec) and a block of probes at a time; a slice of crops gives a row for each frame and probe, not for each crop."""

    def best(part: pa.RecordBatch, asked: nearest.Probes) -> Iterator[pa.RecordBatch]:
        rows, at = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
        most = np.full((len(rows), len(asked)), -np.inf)
        np.maximum.at(most, at, nearest.matrix(part.column(1), asked.vectors.shape[1]) @ asked.vectors.T)
        probe = np.tile(np.arange(len(asked)), len(rows))
        yield pa.RecordBatch.from_arrays([*asked.columns(probe), pa.array(np.repeat(rows, len(asked))), pa.array(most.ravel())], ["query_id", "probe_idx", "row_id", "score"])

    schema = "query_id long, probe_idx int, row_id long, score double"
    each = [nearest.over_batches(crop_vectors, block, ["row_id", "vec"], best, schema) for block in nearest.probe_blocks(probes)] or [crop_vectors.sparkSession.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, each).groupBy("query_id", "probe_idx", "row_id").agg(F.max("score").alias("score")).withColumn("source", F.lit("crop")).withColumn("covered", F.lit(True))


def shortlist(base: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """The k best rows of each query by base(query_id, row_id, s)."""
    order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "row_id")
    return base.withColumn("short_rank", F.row_number().over(order)).where(F.col("short_rank") <= k)


def model_rows(base: DataFrame, queries: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """shortlist of the queries(query_id, kind) that a model looks at: those of a sequence are left to its alignment."""
    return shortlist(base.join(queries.where("kind <> 'trake'").select("query_id"), "query_id", "left_semi"), k)


def model_scores(inputs: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], source: str = "vlm") -> DataFrame:
    """Scores of a plugged-in model for inputs(query_id, probe_idx, row_id, ...), batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["query_id", "probe_idx", "row_id"]].assign(score=scorer(b).astype("float64"))

    out = inputs.mapInPandas(run, "query_id long, probe_idx int, row_id long, score double")
    return out.withColumn("source", F.lit(source)).withColumn("covered", F.lit(True))


class TokenModel(Protocol):
    def tokens(self, text: str) -> list[int]:
        """The ids that a string is made of."""

    def logits(self, jobs: list[dict]) -> np.ndarray:
        """For each job (its columns by name) the scores of all tokens that may come next."""


def token_share(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """exp(yes) / (exp(yes) + exp(no)), which no size of either can overflow."""
    apart = np.asarray(yes, np.float64) - np.asarray(no, np.float64)
    small = np.exp(-np.abs(apart))
    return np.where(apart >= 0, 1.0, small) / (1.0 + small)


def token_scores(inputs: DataFrame, load: Callable[[], TokenModel], batch: int = 8, yes: str = "1", no: str = "0", source: str = "vlm") -> DataFrame:
    """Scores of inputs(query_id, probe_idx, row_id, seq, ...), for instance a text and an image or its path: of the two tokens
    by which a model may answer, the share of `yes`.

    Nothing is generated, so scores are continuous and repeat. A model that spells one of the two by several tokens is an error. A batch that fails is absence:
    its rows have no score and the others keep theirs, as do rows whose share is no number. Of rows that come twice the last by `seq` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at, failures = None, [], 0
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                if model is None:
                    model = load()
                    at = [model.tokens(x) for x in (yes, no)]
                    if any(len(ids) != 1 for ids in at):
                        raise ValueError(f"{yes!r} and {no!r} must be a token each")
                part = b.slice(lo, batch)
                try:
                    found = np.asarray(model.logits(part.to_pylist()), np.float64)
                    share = token_share(found[:, at[0][0]], found[:, at[1][0]])
                    if len(share) != part.num_rows:
                        raise ValueError(f"{len(share)} scores for {part.num_rows} rows")
                except Exception as failed:
                    failures += 1
                    if failures == 1:  # the others of this task are counted
                        print(f"a batch of {part.num_rows} rows has no scores: {failed!r}", file=sys.stderr)
                    continue
                keep = pa.array(np.isfinite(share))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).filter(keep) for c in key), pa.array(share[np.isfinite(share)])], [*key, "score"])
        if failures > 1:
            print(f"{failures} batches have no scores", file=sys.stderr)

    key = ["query_id", "probe_idx", "row_id", "seq"]
    rows = inputs.select(F.col("query_id").cast("long").alias("query_id"), F.col("probe_idx").cast("int").alias("probe_idx"), F.col("row_id").cast("long").alias("row_id"), F.col("seq").cast("long").alias("seq"), *[c for c in inputs.columns if c not in key])
    out = rows.mapInArrow(run, "query_id long, probe_idx int, row_id long, seq long, score double")
    return out.groupBy(*key[:3]).agg(F.max_by("score", F.struct("seq", "score")).alias("score")).withColumn("source", F.lit(source)).withColumn("covered", F.lit(True))


def combine(base: DataFrame, extra: DataFrame, weights: dict[str, float] = STAGE_WEIGHTS) -> DataFrame:
    """Base scores of all frames and extra scores of some, each normalised over what it covers, weighted and summed.

    base(query_id, probe_idx, row_id, s); extra has the shape of scores. A row that a model rejects can fall
    below one that no model saw: absence is no score of zero."""
    own = base.select("query_id", "probe_idx", F.lit("fused4").alias("source"), "row_id", F.col("s").alias("score"), F.lit(True).alias("covered"))
    return fuse(own.unionByName(extra.select(*own.columns)), weights)
