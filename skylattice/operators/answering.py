"""Questions: the best frame for each, the text on and around it, and where a reader comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .models import OCR_CHARS, SPEECH_CHARS


def best_row(fused: DataFrame) -> DataFrame:
    """(query_id, row_id): the first row by score of each query's first probe."""
    order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "row_id")
    first = fused.where("probe_idx = 0").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 1)
    return first.select("query_id", "row_id")


def contexts(best: DataFrame, frames: DataFrame, ocr: DataFrame, speech: DataFrame) -> DataFrame:
    """(query_id, row_id, video_id, n, ocr, speech) of best(query_id, row_id): what stands on the frame and is said around it, cut to what a reader sees.

    ocr(row_id, text); speech as for intervals.window_text. Frames without either have an empty string."""
    at = best.join(frames.select("row_id", "video_id", "n", "ts_ms"), "row_id")
    around = intervals.window_text(at.select("row_id", "video_id", "ts_ms").distinct(), speech, limit=SPEECH_CHARS).withColumnRenamed("text", "speech")
    seen = ocr.select("row_id", F.substring("text", 1, OCR_CHARS).alias("ocr"))
    out = at.join(seen, "row_id", "left").join(around, "row_id", "left")
    return out.select("query_id", "row_id", "video_id", "n", F.coalesce("ocr", F.lit("")).alias("ocr"), F.coalesce("speech", F.lit("")).alias("speech"))
