"""Checking and building submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import BUDGET


def violations(tasks: DataFrame, answers: DataFrame, budget: int = BUDGET, full: bool = False, bounds: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """(task_id, rank, rule) of all that is wrong; an empty result passes. rank is null for rules of a task.

    tasks(task_id, task_type, n_moments); answers(task_id, rank, video_id, frames, answer, score);
    bounds(video_id, n_frames); valid(video_id, frame_idx): frames that exist, for videos that it has."""
    per = answers.groupBy("task_id").agg(F.count("*").alias("n_answers"), F.count("score").alias("n_scores"))
    t = tasks.join(per, "task_id", "left").withColumn("n_answers", F.coalesce("n_answers", F.lit(0)))
    task_rules: list[tuple[str, Column]] = [
        ("empty task id", F.trim(F.coalesce("task_id", F.lit(""))) == ""),
        ("moments below one", F.col("n_moments") < 1),
        ("one moment only", F.col("task_type").isin("kis", "qa") & (F.col("n_moments") != 1)),
        ("over budget", F.col("n_answers") > budget),
        ("no answers", F.col("n_answers") == 0),
        ("scores missing", (F.col("n_scores") > 0) & (F.col("n_scores") < F.col("n_answers"))),
    ]
    if full:
        task_rules.append(("budget not used", (F.col("n_answers") > 0) & (F.col("n_answers") < budget)))
    a = answers.join(tasks, "task_id")
    by_rank = Window.partitionBy("task_id").orderBy("rank")
    a = a.withColumn("earlier", F.row_number().over(Window.partitionBy("task_id", "video_id", "frames").orderBy("rank"))).withColumn("better", F.lag("score").over(by_rank))
    answer_rules: list[tuple[str, Column]] = [
        ("empty video id", F.trim(F.coalesce("video_id", F.lit(""))) == ""),
        ("wrong number of frames", F.size("frames") != F.col("n_moments")),
        ("frame missing", F.exists("frames", lambda f: f.isNull())),
        ("negative frame", F.exists("frames", lambda f: f < 0)),
        ("frames not ascending", (F.col("n_moments") > 1) & (F.array_sort("frames") != F.col("frames"))),
        ("answer missing", (F.col("task_type") == "qa") & (F.trim(F.coalesce("answer", F.lit(""))) == "")),
        ("duplicate answer", F.col("earlier") > 1),
        ("scores not descending", F.col("score") > F.col("better")),
    ]
    if bounds is not None:
        a = a.join(bounds.select("video_id", "n_frames"), "video_id", "left")
        answer_rules += [("unknown video", F.col("n_frames").isNull()), ("frame beyond end", F.exists("frames", lambda f: f >= F.col("n_frames")))]
    if valid is not None:
        a = a.join(valid.groupBy("video_id").agg(F.collect_set("frame_idx").alias("known")), "video_id", "left")
        answer_rules.append(("not a frame of the video", F.col("known").isNotNull() & (F.size(F.array_except("frames", "known")) > 0)))
    said = lambda rules: F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    of_tasks = t.select("task_id", F.lit(None).cast("int").alias("rank"), F.explode(said(task_rules)).alias("rule"))
    twice = tasks.groupBy("task_id").count().where("count > 1").select("task_id", F.lit(None).cast("int").alias("rank"), F.lit("duplicate task id").alias("rule"))
    return of_tasks.unionByName(twice).unionByName(a.select("task_id", F.col("rank").cast("int").alias("rank"), F.explode(said(answer_rules)).alias("rule")))


def missing_and_extra(expected: DataFrame, given: DataFrame) -> DataFrame:
    """(task_id, side) of expected(task_id) without an answer and of given(task_id) that nobody asked for; null is equal to no id.

    One aggregation over both sides: a number an id, in as many tasks as there are partitions, which adaptive execution would put together."""
    rows = expected.select("task_id", F.lit(1).alias("sides")).unionByName(given.select("task_id", F.lit(2).alias("sides")))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    met = rows.repartition(parts, "task_id").groupBy("task_id").agg(F.bit_or("sides").alias("sides"))
    alone = lambda side: (F.col("sides") == side) | (F.col("task_id").isNull() & (F.col("sides") == 3))
    return met.select("task_id", F.explode(F.array_compact(F.array(F.when(alone(1), "missing"), F.when(alone(2), "extra")))).alias("side"))


def require(found: DataFrame, what: str) -> None:
    """Raise with the first few rows if there are any."""
    if rows := found.take(5):
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def from_ranked(ranked: DataFrame, task_type: str = "kis", limit: int = BUDGET) -> DataFrame:
    """answers(task_id, rank, video_id, frames, answer, score) of ranked(query_id, score, video_id, frames)."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "video_id", "frames")
    out = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    answer = F.col("answer") if "answer" in ranked.columns else F.lit(None).cast("string")
    return out.select(F.col("query_id").alias("task_id"), "rank", "video_id", "frames", answer.alias("answer"), "score").withColumn("task_type", F.lit(task_type))


def payload(tasks: DataFrame, answers: DataFrame, shift: int = 0) -> DataFrame:
    """(task_id, json): one prediction for each task, results in order of rank; frames may be shifted by a constant."""
    frames = F.transform("frames", lambda f: f + shift)
    a = answers.join(tasks.select("task_id", "task_type"), "task_id") if "task_type" not in answers.columns else answers
    each = F.struct(
        "rank", "video_id", F.when(F.col("task_type") != "trake", frames[0]).alias("frame_id"), F.when(F.col("task_type") == "trake", frames).alias("frame_ids"), F.when(F.col("task_type") == "qa", F.col("answer")).alias("answer"),
    )
    return a.groupBy("task_id", "task_type").agg(F.array_sort(F.collect_list(each)).alias("results")).select("task_id", F.to_json(F.struct("task_id", "task_type", "results")).alias("json"))
