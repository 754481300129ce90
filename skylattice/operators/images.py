"""Stored images to crop vectors: decode, cut, scale, encode, in the task that opens the file.

A row carries an image's path, never its bytes; a task holds one image and a batch of crops. Codecs plug in; an image that is not there or cannot be
decoded is absence, not an error: its crops have no rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pixel_box
from ..sources.files import content, dealt
from .models import Encoder, LazyEncoder, crop_plan

#: Bytes at the head of a file that tell an image's size.
HEAD = 1 << 16


class Codec(Protocol):
    def size(self, head: bytes) -> tuple[int, int]:
        """Width and height from the first bytes."""

    def decode(self, data: bytes) -> np.ndarray:
        """Rows, columns, channels; ValueError for what is no image."""

    def encode(self, pixels: np.ndarray) -> bytes: ...


class Netpbm:
    """The binary grey (P5) and colour (P6) maps of one byte a value: a codec without a library."""

    _HEAD = re.compile(rb"P([56])\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+255\s")

    def _read(self, data: bytes) -> re.Match:
        if not (m := self._HEAD.match(data)):
            raise ValueError("not a binary grey or colour map")
        return m

    def size(self, head: bytes) -> tuple[int, int]:
        m = self._read(head)
        return int(m[2]), int(m[3])

    def decode(self, data: bytes) -> np.ndarray:
        m = self._read(data)
        shape = int(m[3]), int(m[2]), 3 if m[1] == b"6" else 1
        if len(data) - m.end() < shape[0] * shape[1] * shape[2]:
            raise ValueError("image is cut off")
        return np.frombuffer(data, np.uint8, shape[0] * shape[1] * shape[2], m.end()).reshape(shape)

    def encode(self, pixels: np.ndarray) -> bytes:
        kind = b"P6" if pixels.shape[2] == 3 else b"P5"
        return b"%s %d %d 255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Shrunk to width and height: each pixel is the mean of those that fall to it. A side is never stretched."""
    out = pixels.astype(np.float64)
    for axis, want in ((0, height), (1, width)):
        have = out.shape[axis]
        if want < have:
            starts = np.arange(want) * have // want
            counts = np.diff(np.append(starts, have))
            out = np.add.reduceat(out, starts, axis=axis) / counts.reshape([-1 if a == axis else 1 for a in range(out.ndim)])
    return np.floor(out + 0.5).astype(np.uint8)


def image_sizes(images: DataFrame, codec: Callable[[], Codec]) -> DataFrame:
    """(row_id, width, height) of images(row_id, path), from the heads of their files; without those that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            found = []
            for row, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found.append((row, *own.size(content(path, HEAD))))
                except (OSError, ValueError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["row_id", "width", "height"])

    return dealt(images.select("row_id", "path"), "path").mapInArrow(run, "row_id long, width int, height int")


def _cuts(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row_id, pos, pixels) of planned crops; rows are in order of their image, which is decoded once."""
    now, pixels = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != now:
                now, pixels = row["path"], None
                try:
                    pixels = codec.decode(content(now))
                except (OSError, ValueError):
                    continue
            if pixels is not None:
                yield row["row_id"], row["pos"], scaled(pixels[row["top"] : row["bottom"], row["left"] : row["right"]], row["crop_width"], row["crop_height"])


def planned(crops: DataFrame, images: DataFrame, codec: Callable[[], Codec]) -> DataFrame:
    """crops(row_id, pos, box) of images(row_id, path) with their pixels, an image's crops in one task, one after the other."""
    plan = crop_plan(crops.select("row_id", "pos", "box"), image_sizes(images, codec), pixel_box)
    fields = ["path", "row_id", "pos", "left", "top", "right", "bottom", "crop_width", "crop_height"]
    rows = plan.join(images.select("row_id", "path"), "row_id").select(*fields)
    return dealt(rows, "path").sortWithinPartitions("path", "row_id", "pos")


def cut_crops(crops: DataFrame, images: DataFrame, codec: Callable[[], Codec], most: int = 4 << 20) -> DataFrame:
    """(row_id, pos, image): the crops as encoded images, sent on in batches of about `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = codec(), [], 0
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["row_id", "pos", "image"])
        for row, pos, pixels in _cuts(batches, own):
            held.append((row, pos, own.encode(pixels)))
            size += len(held[-1][2])
            if size >= most:
                yield rows()
                held, size = [], 0
        yield rows()

    return planned(crops, images, codec).mapInArrow(run, "row_id long, pos int, image binary")


def crop_vectors(crops: DataFrame, images: DataFrame, codec: Callable[[], Codec], load: Callable[[], Encoder], dim: int, batch: int = 32) -> DataFrame:
    """(row_id, pos, vec): unit vectors of the crops(row_id, pos, box) of images(row_id, path), `batch` at a time through a model that each task loads once.

    Pixels do not leave the task. What rerank.crop_source compares with probes; rows whose crops are too small, missing or broken are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = LazyEncoder(load, dim), []

        def rows() -> pa.RecordBatch:
            v = encoder.encode([x[2] for x in held]).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.float32).ravel()), dim).cast(pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int32()), lists], ["row_id", "pos", "vec"])

        for cut in _cuts(batches, codec()):
            held.append(cut)
            if len(held) >= batch:
                yield rows()
                held = []
        yield rows()

    return planned(crops, images, codec).mapInArrow(run, "row_id long, pos int, vec array<float>").where(F.col("row_id").isNotNull())
