"""Files that tasks open by themselves: archive directories, images, and writers of small files.

Paths are URIs of stores that pyarrow opens (file, hdfs, s3, gs); a path without a scheme is a shared folder. Bytes of files never pass the driver."""

from __future__ import annotations

import fnmatch
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = "video_id string, n int, archive string, member string"
_MEMBER = re.compile(r"([^/]+)/(\d+)\.(?:webp|jpe?g|png)$", re.I)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def content(path: str, most: int | None = None) -> bytes:
    """A file, or its first bytes."""
    fs, inner = opened(path)
    with fs.open_input_file(inner) as f:
        return f.read() if most is None else f.read(most)


def keyframes(file, archive: str) -> Iterator[tuple[str, int, str, str]]:
    """(video_id, n, archive, member) of an open archive: its end and its directory are read, no member is."""
    for name in zipfile.ZipFile(file).namelist():
        if m := _MEMBER.search(name):
            yield m[1], int(m[2]), archive, name


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Directories(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        base = re.split(r"[*?\[]", self.path)[0]
        base = base if base == self.path else base.rpartition("/")[0]
        fs, root = opened(base)
        scheme, pattern = base.removesuffix(root), root + self.path[len(base) :]
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [_Archive(self.path)]
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.path.lower().endswith(".zip")]
        if pattern != root:
            found = [p for p in found if fnmatch.fnmatch(p, pattern) and p.count("/") == pattern.count("/")]
        return [_Archive(scheme + p) for p in sorted(found)]

    def read(self, partition: _Archive) -> Iterator[tuple[str, int, str, str]]:
        fs, inner = opened(partition.path)
        with fs.open_input_file(inner) as f:
            yield from keyframes(f, partition.path)


class ArchiveDirectories(DataSource):
    """spark.read.format("archive_directories").load(path): a partition for each zip archive, a row for each keyframe in it."""

    @classmethod
    def name(cls) -> str:
        return "archive_directories"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Directories(self.options["path"])


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, n, archive, member) of keyframes in zip archives (a folder, a file or a pattern), from their directories alone."""
    spark.dataSource.register(ArchiveDirectories)
    return spark.read.format(ArchiveDirectories.name()).load(path)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Light rows that stand for heavy work (a file each) over all cores, by a key: they are so few bytes that a scan, or adaptive execution after a shuffle, puts them in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def write_files(files: DataFrame) -> int:
    """files(path, content) one by one, where their rows are; a file appears whole, and one that is there is replaced. How many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for path, data in ((p.as_py(), c.as_py()) for b in batches for p, c in zip(*b.columns, strict=True)):
            fs, inner = opened(path)
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            part = f"{inner}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as out:
                out.write(data)
            fs.move(part, inner)
            done += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_archives(members: DataFrame) -> int:
    """members(archive, member, content) as zip archives, each a file that one task streams, a member at a time. How many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, z, done = None, None, None, 0

        def close() -> None:
            if now is not None:
                z.close()
                out.close()
                fs, inner = opened(now)
                fs.move(part, inner)

        for batch in batches:
            for archive, member, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != now:
                    close()
                    now, done = archive, done + 1
                    fs, inner = opened(archive)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    part = f"{inner}.{uuid.uuid4().hex}.part"
                    out = fs.open_output_stream(part)
                    z = zipfile.ZipFile(out, "w")
                z.writestr(member, data)
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    rows = members.select("archive", "member", F.col("content").cast("binary")).repartition("archive").sortWithinPartitions("archive", "member")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
