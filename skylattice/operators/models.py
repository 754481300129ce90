"""Steps that a plugged-in model makes: encoders, readers, writers. No model ships; a factory loads one in each worker."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from ..sources.versions import Versions
from .frame_index import pending

#: Characters of context that a reader sees, and of an answer that it may give (fixed values).
OCR_CHARS, SPEECH_CHARS, ANSWER_CHARS = 300, 400, 120
#: Sides of a crop in pixels: the least that is looked at, and the greatest that a model gets (fixed values).
CROP_LEAST, CROP_MOST = 24, 336


class Encoder(Protocol):
    dim: int

    def encode(self, values: list) -> np.ndarray: ...


class LazyEncoder:
    """An encoder that is loaded when it is first asked; an empty batch needs no model and has no rows."""

    def __init__(self, load: Callable[[], Encoder], dim: int):
        self.load, self.dim, self.loaded = load, dim, None

    def encode(self, values: list) -> np.ndarray:
        if not len(values):
            return np.zeros((0, self.dim), np.float32)
        self.loaded = self.loaded or self.load()
        out = np.asarray(self.loaded.encode(values), np.float32)
        if out.shape != (len(values), self.dim):
            raise ValueError(f"encoder gave {out.shape} for {len(values)} values of {self.dim} dimensions")
        return out


def encoded(rows: DataFrame, column: str, load: Callable[[], Encoder], dim: int, batch: int = 64, vector: str = "vector") -> DataFrame:
    """rows without `column`, and the unit vector of what it holds; a null value has no vector and the row goes.

    The model is loaded once a task and sees `batch` values at a time."""
    kept = [c for c in rows.columns if c != column]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = LazyEncoder(load, dim)
        for f in frames:
            f = f[f[column].notna()]
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                v = encoder.encode(part[column].tolist()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield part[kept].assign(**{vector: list(v.astype(np.float32))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.select(*kept, column).mapInPandas(run, f"{schema}, `{vector}` array<float>")


def shard_stats(vector: str = "vector", number: str = "n") -> dict[str, Column]:
    """What is noted of a video's stored vectors, for frame_index.pending: their number, that of their frames, their dimensions, whether all are finite."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return {"vectors": F.count(vector), "ids": F.count(number), "dim": F.max(F.size(vector)), "finite": F.min(finite.cast("int")).cast("boolean")}


def encode_pending(frames: DataFrame, store: Versions, column: str, load: Callable[[], Encoder], dim: int, group_rows: int = 1_000_000, batch: int = 64, groups: int | None = None) -> int:
    """Encode what frames(video_id, n, column) has and the store lacks, a group of videos of about group_rows rows at a time. How many groups.

    A group is a version of the store: it is there with its marker or not at all. So a run that is killed goes on with the videos that are not
    whole when it is started again, and a video that is done again replaces itself. `groups` is the most that this run does."""
    expected = frames.groupBy("video_id").agg(F.count(column).alias("frames")).where("frames > 0")
    held = store.units()
    todo = staged(pending(expected, held) if "vectors" in held.columns else expected, "pending-videos")
    parts = -(-(todo.agg(F.sum("frames")).first()[0] or 0) // group_rows)
    done = 0
    for i in range(min(parts, parts if groups is None else groups)):
        some = todo.where(F.pmod(F.xxhash64("video_id"), F.lit(parts)) == i).select("video_id")
        if not some.isEmpty():
            store.append(encoded(frames.select("video_id", "n", column).join(some, "video_id", "left_semi"), column, load, dim, batch))
            done += 1
    return done


def encode_missing(texts: DataFrame, cache: DataFrame, load: Callable[[], Encoder], dim: int) -> DataFrame:
    """(key, vector) of the different texts(key, text) that cache(key, vector) lacks."""
    return encoded(texts.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"), "text", load, dim)


def crop_plan(crops: DataFrame, sizes: DataFrame, pixel_box: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """crops(row_id, box, ...) with their pixels in images of sizes(row_id, width, height): left, top, right, bottom, and the
    width and height that a model gets. Crops below CROP_LEAST on a side go, and so do those of images that are not there."""
    px = crops.join(sizes, "row_id").withColumn("px", pixel_box(F.col("box"), F.col("width"), F.col("height")))
    wide, high = F.col("px.right") - F.col("px.left"), F.col("px.bottom") - F.col("px.top")
    scale = F.least(F.lit(1.0), CROP_MOST / F.greatest(wide, high))
    fit = lambda side: F.greatest(F.lit(1), F.bround(side * scale).cast("int"))
    kept = px.where(F.least(wide, high) >= CROP_LEAST)
    return kept.select(*[c for c in crops.columns], "px.*", fit(wide).alias("crop_width"), fit(high).alias("crop_height"))


def answered(questions: DataFrame, load: Callable[[], Callable[[str, str, str, bytes | None], str]]) -> DataFrame:
    """(query_id, answer) of questions(query_id, question, ocr, speech, image): a reader sees the question, the first
    characters of both contexts and the image, and answers in one line of bounded length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for f in frames:
            read = read or load()
            said = [" ".join(read(q, (o or "")[:OCR_CHARS], (s or "")[:SPEECH_CHARS], i).split())[:ANSWER_CHARS] for q, o, s, i in zip(f["question"], f["ocr"], f["speech"], f["image"], strict=True)]
            yield pd.DataFrame({"query_id": f["query_id"], "answer": said})

    kind = dict(questions.dtypes)["query_id"]
    return questions.select("query_id", "question", "ocr", "speech", "image").mapInPandas(run, f"query_id {kind}, answer string")


def written_queries(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list[str]]], clean: Callable[[Column], Column]) -> DataFrame:
    """rows and a column `text` with the query that a model writes for each, cleaned."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = None
        for f in frames:
            write = write or load()
            yield f.assign(text=write(f))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, text string").withColumn("text", clean(F.col("text")))


def encoder_speed(encoder: Encoder, values: list, sizes: tuple[int, ...] = (1, 8, 64)) -> list[dict]:
    """Rows a second of an encoder by batch size, on one machine: a probe before a fleet is hired."""
    out = []
    for size in sizes:
        began = time.perf_counter()
        for lo in range(0, len(values), size):
            encoder.encode(values[lo : lo + size])
        out.append({"batch": size, "rows_per_second": len(values) / max(time.perf_counter() - began, 1e-9)})
    return out
