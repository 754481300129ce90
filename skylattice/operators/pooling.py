"""Candidate pools: what each source nominates by itself, and who nominated it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Nominations a source, per video, and rows in a query's pool (fixed values).
PER_SOURCE, PER_VIDEO, CAP = 40, 10, 200
#: Bits of the provenance mask (fixed values).
BITS = {"visual": 1, "object": 2, "ocr": 4, "asr": 8}


def nominate(scores: DataFrame, videos: DataFrame, per_source: int = PER_SOURCE, per_video: int | None = PER_VIDEO) -> DataFrame:
    """Rows that each source puts forward: covered, positive, at most per_video of a video and per_source in all.

    Two ranked limits give what a greedy pass with quotas gives. videos: (row_id, video_id)."""
    if per_source < 1 or per_video is not None and per_video < 1:
        raise ValueError("quotas must be positive")
    key, best = ["query_id", "probe_idx", "source"], [F.col("score").desc(), F.col("row_id")]
    out = scores.where(F.col("covered") & (F.col("score") > 0)).join(videos.select("row_id", "video_id"), "row_id")
    if per_video is not None:
        out = out.withColumn("in_video", F.row_number().over(Window.partitionBy(*key, "video_id").orderBy(*best))).where(F.col("in_video") <= per_video).drop("in_video")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*best))).where(F.col("nth") <= per_source)


def union_pool(nominated: DataFrame, base: DataFrame, cap: int | None = CAP, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Distinct nominated rows, with the sources and mask of who nominated them, best first by
    base(*by, row_id, s), at most cap for each group."""
    bit = F.create_map(*[F.lit(x) for pair in BITS.items() for x in pair])[F.col("source")]
    pool = nominated.groupBy(*by, "row_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.bit_or(F.coalesce(bit, F.lit(0))).alias("prov"))
    pool = pool.withColumn("agree", F.size("sources")).join(base, [*by, "row_id"], "left")
    order = Window.partitionBy(*by).orderBy(F.coalesce("s", F.lit(float("-inf"))).desc(), "row_id")
    pool = pool.withColumn("pool_rank", F.row_number().over(order))
    return pool if cap is None else pool.where(F.col("pool_rank") <= cap)


def nomination_counts(nominated: DataFrame) -> DataFrame:
    return nominated.groupBy("query_id", "source").agg(F.count("*").alias("nominated"))


def in_pool(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """rows with a flag that tells whether the query's pool holds them."""
    mark = pool.select("query_id", "row_id", F.lit(True).alias("pooled"))
    return rows.join(mark, ["query_id", "row_id"], "left").withColumn("pooled", F.coalesce("pooled", F.lit(False)))


def fused_first(base: DataFrame, videos: DataFrame, budget: int, per_video: int | None = None) -> DataFrame:
    """Policy: the best `budget` rows of base(query_id, row_id, s) by themselves, at most per_video of a video."""
    best = [F.col("s").desc(), F.col("row_id")]
    rows = base.join(videos.select("row_id", "video_id"), "row_id")
    if per_video is not None:
        rows = rows.withColumn("in_video", F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy(*best))).where(F.col("in_video") <= per_video)
    return rows.withColumn("pool_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("pool_rank") <= budget).select("query_id", "row_id", "s", "pool_rank", F.lit("fused").alias("reason"))


def rescued(base: DataFrame, nominated: DataFrame, videos: DataFrame, budget: int, core: float = 0.5) -> DataFrame:
    """Policy: a core of the best rows by base, then rows that sources nominate and the core lacks, best nomination first, up to the
    budget. `reason` tells fused from the source that rescued a row (of several the one that ranks it best, then by name)."""
    kept = fused_first(base, videos, max(1, int(budget * core)))
    more = nominated.groupBy("query_id", "row_id").agg(F.min(F.struct("nth", "source")).alias("by")).join(kept, ["query_id", "row_id"], "left_anti").join(base, ["query_id", "row_id"])
    size = kept.groupBy("query_id").agg(F.count("*").alias("core"))
    order = Window.partitionBy("query_id").orderBy("by.nth", F.col("s").desc(), "row_id")
    more = more.withColumn("k", F.row_number().over(order)).join(size, "query_id").where(F.col("k") + F.col("core") <= budget)
    return kept.unionByName(more.select("query_id", "row_id", "s", (F.col("k") + F.col("core")).cast("int").alias("pool_rank"), F.concat(F.col("by.source"), F.lit("_rescue")).alias("reason")))
