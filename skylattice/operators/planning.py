"""Dealing videos to shards, and reports on the deal."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import lpt_bound
from ..sources.staging import staged
from .submission import require


def balance(weights: list[tuple[str, int]], shards: int) -> list[tuple[str, int, int]]:
    """(video_id, weight, shard): heaviest first to the lightest shard so far."""
    if shards < 1:
        raise ValueError(f"shards must be positive: {shards}")
    loads = [(0, s) for s in range(shards)]
    out = []
    for video, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(loads)
        out.append((video, w, s))
        heapq.heappush(loads, (load + w, s))
    return out


#: A video is heavy if it is more than this part of a shard's fair share, so at most HEAVY videos a shard are.
HEAVY = 100


def water_level(loads: list[int], more: int) -> tuple[int, int]:
    """(volume, m): the m lightest loads rise to volume / m when `more` is poured over them all."""
    total, best = more, (more, 1)
    for m, load in enumerate(sorted(loads), 1):
        total += load
        if total >= m * load:
            best = (total, m)
    return best


def deal(videos: DataFrame, shards: int) -> DataFrame:
    """videos(video_id, weight) with their shard; doubled ids and weights below one are errors.

    Two levels: heavy videos, at most HEAVY a shard, are dealt greedily by the driver; the light ones, any number, are laid end to end in order of
    video_id, and fall to the shard in whose free room they begin. Rooms end where all shards would be level, so no shard passes the greater of
    that level and its heavy load by more than one light video: at most 1 / HEAVY of a fair share above what greedy dealing reaches.
    Only sums of ranges of the light videos meet in one task."""
    require(videos.groupBy("video_id").count().where("count > 1"), "video ids repeat")
    require(videos.where("weight <= 0 or weight is null"), "weights must be positive")
    if shards < 1:
        raise ValueError(f"shards must be positive: {shards}")
    v = videos.select("video_id", F.col("weight").cast("long").alias("weight"))
    total = v.agg(F.sum("weight")).first()[0] or 0
    is_heavy = F.col("weight") * shards * HEAVY > total
    dealt = balance([(r["video_id"], r["weight"]) for r in v.where(is_heavy).collect()], shards)
    loads = [0] * shards
    for _, weight, shard in dealt:
        loads[shard] += weight
    volume, m = water_level(loads, total - sum(loads))
    ends, at = [], 0
    for load in loads:  # in m-ths, so that all is whole numbers
        at += max(0, volume - m * load)
        ends.append(at)
    light = staged(v.where(~is_heavy).repartitionByRange("video_id").withColumn("part", F.spark_partition_id()), "light-videos")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sums = light.groupBy("part").agg(F.sum("weight").alias("in_part"))
    sums = sums.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("below"))
    within = Window.partitionBy("part").orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)
    begin = (F.col("below") + F.coalesce(F.sum("weight").over(within), F.lit(0))) * m
    rooms = F.array(*[F.lit(e).cast("long") for e in ends])
    placed = light.join(F.broadcast(sums), "part").withColumn("begin", begin)
    placed = placed.select("video_id", "weight", F.size(F.filter(rooms, lambda e: e <= F.col("begin"))).alias("shard"))
    heavy = videos.sparkSession.createDataFrame(dealt, "video_id string, weight long, shard int")
    return heavy.unionByName(placed.select(F.col("video_id").cast("string").alias("video_id"), "weight", F.least("shard", F.lit(shards - 1)).alias("shard")))


def shard_report(dealt: DataFrame, shards: int) -> DataFrame:
    """One row: number, least, greatest and mean load, imbalance, and the bound of the method; empty shards count."""
    every = dealt.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(dealt, "shard", "left").groupBy("shard").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("load"))
    out = loads.agg(F.count("*").alias("shards"), F.min("load").alias("least"), F.max("load").alias("most"), F.avg("load").alias("mean"))
    return out.withColumn("imbalance", F.when(F.col("mean") > 0, F.col("most") / F.col("mean")).otherwise(1.0)).withColumn("bound", lpt_bound(F.col("shards")))
