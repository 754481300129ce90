"""Shared plumbing of the corpus operators: table access, written tables, code shipping."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import fresh_path
from ..sources.staging import staged as written

__all__ = ["arrow_batches", "cuts", "fresh_path", "kept_rows", "read", "release", "ship", "slices", "tidy", "tokenizer_path", "written"]
ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Jobs that run meanwhile send batches of at most that many bytes to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    known = os.environ.get("PYTHONPATH", "").split(":")
    if str(ROOT) in known or os.path.realpath(os.getcwd()) == str(ROOT):
        return
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        import shutil

        base = tempfile.mkdtemp(prefix="skylattice-code-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{base}/skylattice_code", "zip", ROOT, "skylattice"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters (or bytes) of text that a step in Python holds at a time; a longer text is alone in its slice.
SLICE = 1 << 19


def cuts(sizes: list[int], rows: int = 256, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Bounds (lo, hi) of slices in order: at most `rows` items and, unless an item alone is larger, at most `size` in sum."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo >= rows or held + n > size):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text in that column (see cuts); nulls count as empty."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for lo, hi in cuts(lengths, rows, size):
        yield batch.slice(lo, hi - lo)


def release() -> None:
    """Give free memory of this worker back to the machine, for what runs beside and after it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only one C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and release() when a task's rows are through: workers outlive their tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def kept_rows(docs: DataFrame, good: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs, all columns, whose `text` is good; any other column may have any name and type.

    Texts alone go to Python, and a boolean each comes back. `good` sees slices of bounded size."""

    def judge(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        kept = pa.array([g for part in slices(batch, 0) for g in good(part.column(0).to_pylist())], pa.bool_())
        release()
        return kept

    ship(docs.sparkSession)
    return docs.where(F.arrow_udf(judge, "boolean")(F.col("text")))
