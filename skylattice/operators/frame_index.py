"""The frame table: building, checking, resuming, and answering from rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, is_unit, truncate_and_normalize
from .submission import require


def missing_keys(expected: DataFrame, present: DataFrame, key: tuple[str, ...] = ("video_id", "n")) -> DataFrame:
    return expected.select(*key).join(present.select(*key), list(key), "left_anti")


def build(vectors: DataFrame, frame_idx: DataFrame) -> DataFrame:
    """frames(row_id, video_id, n, frame_idx, emb) of vectors(video_id, n, emb) and frame_idx(video_id, n, frame_idx).

    Repeated keys, vectors of several lengths or not of unit length, and keys without a frame number are errors.
    row_id follows (video_id, n): counts of the videos before, and the place in the video, so no global sort in one task."""
    require(vectors.groupBy("video_id", "n").count().where("count > 1"), "keys repeat")
    require(vectors.where(~is_unit(F.col("emb"))).select("video_id", "n"), "vectors not of unit length")
    if vectors.select(F.size("emb")).distinct().count() > 1:
        raise ValueError("vectors differ in length")
    require(missing_keys(vectors, frame_idx), "keys without a frame number")
    joined = vectors.join(frame_idx.select("video_id", "n", "frame_idx"), ["video_id", "n"])
    before = Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = joined.groupBy("video_id").agg(F.count("*").alias("c")).select("video_id", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("n")) - 1
    return joined.join(starts, "video_id").select((F.col("first") + place).alias("row_id"), "video_id", "n", "frame_idx", "emb")


def timed(frames: DataFrame, times: DataFrame) -> DataFrame:
    """frames with ts_ms of times(video_id, n, ts_ms), 0 where there is none."""
    return frames.drop("ts_ms").join(times.select("video_id", "n", "ts_ms"), ["video_id", "n"], "left").withColumn("ts_ms", F.coalesce("ts_ms", F.lit(0.0)))


def of_groups(videos: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of the videos of some groups: those whose video_id begins with one of the names and an underscore."""
    starts = [F.col("video_id").startswith(g.strip() + "_") for g in groups if g.strip()]
    return videos.where(reduce(or_, starts, F.lit(False)))


def measurable_classes(classes: DataFrame, n_frames: DataFrame, least: int = 150, most: float = 0.35) -> DataFrame:
    """(class, frames, prevalence) of classes(class, ...), a row for each frame that shows one: frequent enough to
    measure, rare enough to tell anything. n_frames(all) has one row."""
    per = classes.groupBy("class").agg(F.count("*").alias("frames")).crossJoin(F.broadcast(n_frames.select("all")))
    return per.withColumn("prevalence", F.col("frames") / F.col("all")).where((F.col("frames") >= least) & (F.col("prevalence") <= most)).drop("all")


def ranges(frames: DataFrame) -> DataFrame:
    """Half-open row range of each video."""
    return frames.groupBy("video_id").agg(F.min("row_id").alias("lo"), (F.max("row_id") + 1).alias("hi"))


def problems(frames: DataFrame) -> DataFrame:
    """(problem, video_id, n) of what breaks the table's invariants."""
    order = Window.partitionBy("video_id").orderBy("row_id")
    f = frames.withColumn("before", F.lag("n").over(order)).withColumn("step", F.col("row_id") - F.lag("row_id").over(order))
    rules = {"no frame number": F.col("frame_idx").isNull(), "not of unit length": ~is_unit(F.col("emb")), "keys out of order": F.col("before") >= F.col("n"), "rows not contiguous": F.col("step") != 1}
    said = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return f.select(F.explode(said).alias("problem"), "video_id", "n")


def load(spark, path: str, dim: int | None = None) -> DataFrame:
    """The stored table, checked; then vectors cut to dim values and made unit again."""
    frames = spark.read.parquet(path)
    require(problems(frames), "stored index is broken")
    return frames if dim is None else frames.withColumn("emb", truncate_and_normalize(F.col("emb"), dim))


def pending(expected: DataFrame, shards: DataFrame) -> DataFrame:
    """Videos still to encode: those without a stored shard that is whole.

    expected(video_id, frames); shards(video_id, vectors, ids, dim, finite) as read back."""
    whole = shards.where((F.col("vectors") == F.col("ids")) & (F.col("vectors") > 0) & (F.col("dim") > 0) & F.col("finite"))
    return expected.join(whole, expected["video_id"].eqNullSafe(whole["video_id"]) & (F.col("frames") == F.col("vectors")), "left_anti")


def answers(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """(query_id, rank, video_id, frames) of rows(query_id, rank, path): rows of one video in ascending frames.

    Unknown rows, paths over several videos and paths out of order are errors."""
    each = rows.select("query_id", "rank", F.posexplode("path").alias("pos", "row_id")).join(frames.select("row_id", "video_id", "frame_idx"), "row_id", "left")
    out = each.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct("pos", "frame_idx"))).alias("f"), F.min("video_id").alias("video_id"), F.max("video_id").alias("other"), F.count("video_id").alias("found"), F.count("*").alias("n"))
    out = out.withColumn("frames", F.transform("f", lambda x: x["frame_idx"]))
    wrong = (F.col("found") < F.col("n")) | (F.col("video_id") != F.col("other")) | (F.array_sort("frames") != F.col("frames"))
    return out.select("query_id", "rank", F.when(wrong, F.raise_error("path is not of one video in order")).otherwise(F.col("video_id")).alias("video_id"), "frames")


def temporal_cohesion(frames: DataFrame, seed: int = 0, lane_rows: int = 4096) -> DataFrame:
    """One row: mean cosine of frames that follow each other, of frames of different videos, and if the gap is over 0.05.

    Every frame is compared with the next of its video, and with the frame of another video that a seeded order puts next to
    it. Only ids are put in order, in as many lanes as the rows need; the pairs' vectors are joined to them."""
    order = Window.partitionBy("video_id").orderBy("row_id")
    lanes = max(1, -(-frames.count() // lane_rows))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")))
    lane = F.pmod(F.conv(F.substring(draw, 1, 8), 16, 10).cast("long"), F.lit(lanes))
    other = Window.partitionBy("lane").orderBy("draw", "row_id")
    ids = frames.select("row_id", "video_id", lane.alias("lane"), draw.alias("draw"))
    after = F.lead(F.struct("row_id", "video_id"))
    near = ids.select("row_id", F.lead("row_id").over(order).alias("to"), F.lit("within").alias("kind"))
    far = ids.withColumn("o", after.over(other)).where(F.col("o.video_id") != F.col("video_id")).select("row_id", F.col("o.row_id").alias("to"), F.lit("across").alias("kind"))
    a, b = frames.select("row_id", F.col("emb").alias("x")), frames.select(F.col("row_id").alias("to"), F.col("emb").alias("y"))
    met = near.where(F.col("to").isNotNull()).unionByName(far).join(a, "row_id").join(b, "to").select("kind", dot(F.col("x"), F.col("y")).alias("c"))
    out = met.agg(F.avg(F.when(F.col("kind") == "within", F.col("c"))).alias("within"), F.avg(F.when(F.col("kind") == "across", F.col("c"))).alias("across"))
    return out.withColumn("passed", F.col("within") - F.col("across") > 0.05)


def sample_by_evidence(frames: DataFrame, n: int, seed: int, banned: DataFrame | None = None, per_video: int = 2) -> DataFrame:
    """A seeded sample of frames(row_id, video_id, query_type), a quarter of n for each type (the rest to the last), at most per_video of a video.

    The draw is a digest of seed and row, so any engine draws alike."""
    rows = frames.where(F.col("query_type").isNotNull())
    if banned is not None:
        rows = rows.join(banned.select("video_id"), "video_id", "left_anti")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")))
    rows = rows.withColumn("draw", draw).withColumn("in_video", F.row_number().over(Window.partitionBy("video_id").orderBy("draw", "row_id"))).where(F.col("in_video") <= per_video)
    wanted = F.when(F.col("query_type") == "vision+ocr+asr", n - 3 * (n // 4)).otherwise(n // 4)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_type").orderBy("draw", "row_id"))).where(F.col("nth") <= wanted).drop("draw", "in_video", "nth")
