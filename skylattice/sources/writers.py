"""Writers; Spark's commit protocol stands for temporary names and renames."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import shard_stats
from ..operators.submission import payload, require, violations
from .versions import Versions


def submission_csv(answers: DataFrame, path: str) -> None:
    """A folder for each task with headerless lines video,frame...[,answer] in order of rank; answers are quoted where they need it."""
    need = F.col("answer").rlike('[",\n\r]')
    answer = F.when(need, F.concat(F.lit('"'), F.regexp_replace("answer", '"', '""'), F.lit('"'))).otherwise(F.col("answer"))
    line = F.concat_ws(",", "video_id", F.array_join(F.transform("frames", lambda f: f.cast("string")), ","), answer)
    rows = answers.select("task_id", "rank", line.alias("value")).repartition("task_id").sortWithinPartitions("task_id", "rank")
    rows.select("task_id", "value").write.mode("overwrite").partitionBy("task_id").text(path)


def predictions_json(tasks: DataFrame, answers: DataFrame, path: str, shift: int = 0, **rules) -> None:
    """Checked predictions, one JSON object a line; nothing is written if a rule is broken."""
    require(violations(tasks, answers, **rules), "submission is not valid")
    payload(tasks, answers, shift).select("json").write.mode("overwrite").text(path)


def frame_index(frames: DataFrame, path: str) -> None:
    """Frames in order of video and ordinal, with the short prefix of the vectors as a column of its own, so that scans may leave out the rest."""
    wide = frames.withColumn("emb_head", F.slice("emb", 1, 512))
    wide.repartitionByRange("video_id", "n").sortWithinPartitions("video_id", "n").write.mode("overwrite").parquet(path)


def video_shards(spark: SparkSession, path: str) -> Versions:
    """Stored vectors(video_id, n, vector) by video, which models.encode_pending fills."""
    return Versions(spark, path, "video_id string", ["video_id", "n"], shard_stats())


def rerank_trace(rows: DataFrame, path: str) -> None:
    """Pool rows with base, model scores, agreement and provenance, in ranges of query and row: a query's rows are in few row groups, without a folder each."""
    if bad := [c for c in ("query_id", "row_id", "base", "prov") if c not in rows.columns]:
        raise ValueError(f"trace lacks {bad}")
    rows.repartitionByRange("query_id", "row_id").sortWithinPartitions("query_id", "row_id").write.mode("overwrite").parquet(path)


def vector_cache(spark: SparkSession, path: str) -> Versions:
    """Vectors of texts by a digest of the text: of a key, what was written last."""
    return Versions(spark, path, "key string")


def cache_vectors(vectors: DataFrame, cache: Versions) -> None:
    """vectors(key, vector) into the cache; of a key that comes twice at once, the greater vector."""
    cache.append(vectors.groupBy("key").agg(F.max("vector").alias("vector")))


class RunReport:
    """Settings and seconds of each stage of a run, as one JSON document."""

    def __init__(self, **settings):
        self.content = {"settings": settings, "timing_s": {}}

    def stage(self, name: str):
        report = self.content["timing_s"]

        class _Timer:
            def __enter__(self):
                self.began = time.monotonic()

            def __exit__(self, *_):
                report[name] = round(time.monotonic() - self.began, 3)

        return _Timer()

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.content, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file of an artifact, computed where the files are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def git_state(root: str) -> dict[str, str | None]:
    """Branch and commit of a working copy, read from its files; null where there is none."""
    git = Path(root) / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
    except OSError:
        return {"branch": None, "commit": None}
    if not head.startswith("ref: "):
        return {"branch": None, "commit": head}
    name = head[5:]
    packed = (git / "packed-refs").read_text().splitlines() if (git / "packed-refs").exists() else []
    commit = (git / name).read_text().strip() if (git / name).exists() else next((x.split()[0] for x in packed if x.endswith(" " + name)), None)
    return {"branch": name.removeprefix("refs/heads/"), "commit": commit}


def manifest(spark: SparkSession, artifacts: str, path: str, root: str) -> None:
    """Every file of the artifacts with size and digest, and the state of the working copy, a JSON object a line."""
    state = git_state(root)
    provenance(spark, artifacts).select("*", F.lit(state["branch"]).alias("branch"), F.lit(state["commit"]).alias("commit")).write.mode("overwrite").json(path)


def eval_report(tables: dict[str, DataFrame], path: str) -> None:
    """Result tables of an evaluation by name, a JSON object for each row."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def verified(found: DataFrame, stated: DataFrame) -> DataFrame:
    """stated(path, sha256) with status: verified, not_applicable (nothing is stated) or unverifiable (no such file, or it differs)."""
    met = stated.join(found.select("path", F.col("sha256").alias("own")), "path", "left")
    return met.select("path", F.when(F.col("sha256").isNull(), "not_applicable").when(F.col("own") == F.col("sha256"), "verified").otherwise("unverifiable").alias("status"))


def generated_queries(queries: DataFrame, path: str, least_words: int = 8) -> None:
    """Generated queries with enough words, as text by query and as ground truth."""
    kept = queries.where(F.size(F.split(F.trim("text"), r"\s+")) >= least_words).withColumn("query_id", F.concat_ws("_", F.lit("h"), "video_id", "n"))
    kept.select("query_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("query_id").text(f"{path}/texts")
    kept.select("query_id", F.col("text").alias("query_text"), "query_type", "video_id", F.col("n").alias("frame_id"), "frame_idx").write.mode("overwrite").json(f"{path}/truth")
