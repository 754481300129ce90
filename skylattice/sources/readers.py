"""Readers: every one names its schema, prunes to what it returns, and is lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_kind, squeezed

OCR = "video_id string, n int, shot_id int, text_ascii_folded string, text_normalized string, text_raw string"
FRAMES = "n int, frame_idx int, fps double, shot_id int, shot_start_frame int, shot_end_frame int"
ASR = "video_id string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
OBJECTS = "layout_folded string, count_folded string, classes_folded string, detection_class_entities array<string>, detection_boxes array<array<double>>, classes array<string>, entities_vi array<string>, frame_id string, frame_idx int"
SHOT_TRUTH = (
    "query_id string, query_text string, query_type string, positive_shots array<struct<shot_id:string>>, partial_shots array<struct<shot_id:string>>, "
    "hard_negative_shots array<struct<shot_id:string>>, representative_frame string, evidence string, status string"
)


def _stem(depth: int = 0) -> Column:
    """File name without its ending, or the name of a folder above it, of which `column=value` gives the value."""
    part = F.url_decode(F.replace(F.element_at(F.split(F.input_file_name(), "/"), -1 - depth), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(part, r"\.[^.]*$", "") if depth == 0 else F.regexp_replace(part, "^[^=]*=", "")


def ocr_text(spark: SparkSession, path: str, field: str = "text_ascii_folded") -> DataFrame:
    """(video_id, n, text): trimmed and not empty; of a key that repeats, the line that stands last.

    Line order is file name, then offset in the file as read."""
    rows = spark.read.schema(OCR).json(path).select("video_id", "n", F.trim(field).alias("text"), F.monotonically_increasing_id().alias("line"))
    return rows.where(F.col("text") != "").groupBy("video_id", "n").agg(F.max_by("text", "line").alias("text"))


def ocr_raw(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, n, text) for a reader: the normalised text, else the raw one."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    return spark.read.schema(OCR).json(path).select("video_id", "n", F.coalesce(blank("text_normalized"), blank("text_raw")).alias("text")).where(F.col("text").isNotNull())


def shot_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OCR).json(path).where(F.col("shot_id").isNotNull()).select("video_id", "n", "shot_id")


def frame_table(spark: SparkSession, path: str, depth: int = 0) -> DataFrame:
    """All columns of the frame CSVs and the video_id from the file's name, or that of a folder above it (depth 1); byte-order marks and blank lines are skipped.

    The header is matched by name in each file, so column order may differ. Files are read by lines and split like any other, so a video of any length
    is many tasks; `pos` orders rows by file, place of the split, and line. Where each file has its columns, a row a file, goes to every task."""
    kinds = dict(c.split() for c in FRAMES.split(", "))
    place = F.struct(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(_stem(depth).alias("video_id"), place.alias("pos"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("value")).where(F.trim("value") != "")
    head = F.transform(F.split("h.value", ","), lambda x: F.trim(x))
    heads = lines.groupBy("pos.file").agg(F.min(F.struct("pos", "value")).alias("h")).select("file", F.col("h.pos").alias("first"), *[F.array_position(head, c).cast("int").alias(f"at_{c}") for c in kinds])
    rows = lines.withColumn("file", F.col("pos.file")).join(F.broadcast(heads), "file").where(F.col("pos") > F.col("first")).withColumn("cells", F.split("value", ","))
    return rows.select("video_id", "pos", *[F.expr(f"try_cast(nullif(trim(get(cells, at_{c} - 1)), '') as {kind})").alias(c) for c, kind in kinds.items()])


def shot_bounds(frames: DataFrame) -> DataFrame:
    return frames.where("shot_start_frame is not null and shot_end_frame is not null").select("video_id", "n", "shot_start_frame", "shot_end_frame")


def video_last_frame(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.max("shot_end_frame").alias("last_frame")).where("last_frame > 0")


def frame_numbers(frames: DataFrame) -> DataFrame:
    return frames.where("frame_idx is not null").select("video_id", "n", "frame_idx")


def frame_times(frames: DataFrame) -> DataFrame:
    return frames.where("frame_idx is not null and fps is not null").select("video_id", "n", (F.col("frame_idx") / F.col("fps") * 1000.0).alias("ts_ms"))


def shot_frames(frames: DataFrame) -> DataFrame:
    """(video_id, shot_id, start, end): a shot's first row decides."""
    rows = frames.where("shot_id is not null")
    first = F.min_by(F.struct(F.col("shot_start_frame").alias("start"), F.col("shot_end_frame").alias("end")), "pos")
    return rows.groupBy("video_id", "shot_id").agg(first.alias("f")).select("video_id", "shot_id", "f.start", "f.end")


def object_records(spark: SparkSession, root: str) -> DataFrame:
    """Detector records with keys from the path root/video/n.json.

    Folders of videos are listed, not files one by one: there is a file for each frame. What stands higher or deeper is left out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    depth = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).depth()
    read = spark.read.schema(OBJECTS).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(f"{root}/*")
    parts = F.split(F.regexp_replace(F.input_file_name(), "^[^:/]+:(//[^/]*)?/", ""), "/")
    return read.where(F.size(parts) == depth + 2).withColumn("video_id", _stem(1)).withColumn("n", _stem().cast("int"))


def object_text(records: DataFrame) -> DataFrame:
    parts = [F.when(F.trim(c) != "", F.col(c)) for c in ("layout_folded", "count_folded", "classes_folded")]
    return records.select("video_id", "n", F.concat_ws(" ", *parts).alias("text")).where(F.col("text") != "")


def object_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(video_id, n, class), and (class, phrase) with the phrase of the first record that has one."""
    labels = records.select("video_id", "n", F.explode(F.array_distinct("classes")).alias("class"))
    named = records.select("video_id", "n", F.posexplode(F.arrays_zip("detection_class_entities", "entities_vi")).alias("pos", "p"))
    phrase = named.groupBy(F.col("p.detection_class_entities").alias("class")).agg(F.min_by("p.entities_vi", F.struct("video_id", "n", "pos")).alias("phrase"))
    return labels, phrase


def speech(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, start_ms, end_ms, text) of transcript files; the file's name stands in for a missing id."""
    rows = spark.read.schema(ASR).option("multiLine", True).json(path).select(F.coalesce("video_id", _stem()).alias("video_id"), F.explode("segments").alias("s"))
    return rows.select("video_id", "s.start_ms", "s.end_ms", F.trim("s.text").alias("text")).where(F.col("text") != "")


def query_files(spark: SparkSession, path: str, depth: int = 0) -> DataFrame:
    """queries(query_id, text, kind) from a folder of text files; empty ones are skipped."""
    rows = spark.read.text(path, wholetext=True).select(_stem(depth).alias("query_id"), squeezed(F.col("value")).alias("text")).where(F.col("text") != "")
    return rows.withColumn("kind", query_kind(F.col("query_id"), F.col("text")))


def image_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(video_id, n, path): for each keyframe the file of the first root that has it."""
    found = None
    for order, root in enumerate(roots):
        part = spark.read.format("binaryFile").load(f"{root}/*/*.webp").select("path").withColumn("root", F.lit(order))
        found = part if found is None else found.unionByName(part)
    keyed = found.select("path", "root", F.element_at(F.split("path", "/"), -2).alias("video_id"), F.regexp_extract("path", r"(\d+)\.webp$", 1).cast("int").alias("n"))
    return keyed.groupBy("video_id", "n").agg(F.min_by("path", "root").alias("path"))


def submission_files(spark: SparkSession, path: str, depth: int = 0) -> DataFrame:
    """(task_id, rank, video_id, frames, answer): numeric cells are frames, a last cell that isn't a number is an answer.

    A file is one value while its lines are split: it holds one task's answers, some hundred lines."""
    rows = spark.read.text(path, wholetext=True).select(_stem(depth).alias("task_id"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    quoted = F.regexp_extract("line", r'^[^"]*,"((?:[^"]|"")*)"\s*$', 1)
    bare = F.when(quoted != "", F.regexp_replace("line", r',"(?:[^"]|"")*"\s*$', "")).otherwise(F.col("line"))
    cells = F.transform(F.split(bare, ","), lambda x: F.trim(x))
    rest = F.slice(cells, 2, F.size(cells))
    number = lambda x: x.rlike(r"^-?\d+$")
    last = F.element_at(cells, -1)
    answer = F.when(quoted != "", F.regexp_replace(quoted, '""', '"')).when((F.size(cells) > 1) & ~number(last), last)
    return rows.select("task_id", (F.col("pos") + 1).alias("rank"), cells[0].alias("video_id"), F.transform(F.filter(rest, number), lambda x: x.cast("int")).alias("frames"), answer.alias("answer"))


def task_query(task_id: Column) -> Column:
    """The query a task is for: what follows the last hyphen."""
    return F.element_at(F.split(task_id, "-"), -1)


def shot_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_type, shot_id, relevance): positive shots 2, partial shots 1."""
    rows = spark.read.schema(SHOT_TRUTH).json(path)
    shot = lambda c, r: rows.select("query_id", "query_type", F.explode(f"{c}.shot_id").alias("shot_id"), F.lit(r).alias("relevance"))
    return shot("positive_shots", 2).unionByName(shot("partial_shots", 1)).groupBy("query_id", "query_type", "shot_id").agg(F.max("relevance").alias("relevance"))


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """One row for each key: the last by `by`."""
    order = Window.partitionBy(*key).orderBy(F.col(by).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
