"""Tables that a plan writes and reads back: lineage is cut, and what several steps need is computed once."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: dict[str, tuple[SparkSession, list[str]]] = {}
#: Rows of a table that may be sent to every task.
SMALL = 50_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a local session uses a temporary folder, and a cluster is refused."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="skylattice-"))
    return _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = (spark, [])
        atexit.register(_at_exit, spark)
    path = f"{shared_dir(spark)}/skylattice-staged/{app}/{name}-{uuid.uuid4().hex}"
    _written[app][1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application has staged; its results must have been read by then."""
    _, paths = _written.get(spark.sparkContext.applicationId if spark.sparkContext._jsc else "", (None, []))
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        clear(spark)


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file by name, wherever the path is; it appears whole, and one that is there is replaced."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    part, whole = hadoop.Path(f"{path}.part"), hadoop.Path(path)
    fs = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(content)
    out.close()
    fs.delete(whole, False)
    fs.rename(part, whole)
