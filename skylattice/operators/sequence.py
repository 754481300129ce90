"""Ordered events: the best increasing path of frames, one frame an event.

One best path a video is a chain of running maxima over a window; k best paths come
from joins of a small pool with itself, or from a best-first search in each group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

_GROUP = ["query_id", "video_id"]


def best_paths(cells: DataFrame, n: int, penalty: float = 0.0, by: list[str] = _GROUP) -> DataFrame:
    """(by, score, path): for each group the best n rows in time order, from cells(by, row_id, ts_ms, s0 ... s{n-1}).

    A path pays `penalty` for each second between its ends. Equal times are in order of row. Among equal
    predecessors the latest wins, among equal ends the first. Groups with fewer than n rows have no path."""
    if penalty < 0 or n < 1:
        raise ValueError("n must be positive and penalty not negative")
    order = Window.partitionBy(*by).orderBy("ts_ms", "row_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.min("ts_ms").over(Window.partitionBy(*by))
    now = cells.withColumn("_t", (F.col("ts_ms") - start) / 1000.0).withColumn("_at", F.row_number().over(order))
    now = now.withColumn("_dp", F.col("s0").cast("double")).withColumn("_path", F.array("row_id"))
    for i in range(1, n):
        best = F.max(F.when(F.col("_dp").isNotNull(), F.struct((F.col("_dp") + penalty * F.col("_t")).alias("k"), F.col("_at").alias("at"), F.col("_path").alias("path")))).over(past)
        now = now.withColumn("_b", best)
        now = now.withColumn("_dp", F.col(f"s{i}") + F.col("_b.k") - penalty * F.col("_t")).withColumn("_path", F.when(F.col("_b").isNotNull(), F.concat("_b.path", F.array("row_id")))).drop("_b")
    end = F.max_by(F.struct(F.col("_dp").alias("score"), F.col("_path").alias("path")), F.struct("_dp", -F.col("_at")))
    return now.where(F.col("_dp").isNotNull()).groupBy(*by).agg(end.alias("e")).select(*by, "e.score", "e.path")


def best_paths_in_chunks(cells: DataFrame, n: int, penalty: float = 0.0, by: list[str] = _GROUP) -> DataFrame:
    """best_paths where one group may be larger than a task: its rows are put in order by ranges, and each range is a chunk of its time.

    A chunk's transfer matrix says for every i < j what the best rows for the events i to j - 1 within it earn. Matrices multiply in (max, +), so
    folding a group's chunks in order gives its best path; a group meets in one task as a matrix a chunk, n (n + 1) / 2 short paths each.
    Scores are summed up by chunks, so they can differ from best_paths in the last digit; ties are broken alike."""
    if penalty < 0 or n < 1:
        raise ValueError("n must be positive and penalty not negative")
    scores = [f"s{i}" for i in range(n)]
    start = cells.groupBy(*by).agg(F.min("ts_ms").alias("_start"))
    placed = cells.select(*by, "row_id", "ts_ms", *scores).repartitionByRange(*by, "ts_ms", "row_id").withColumn("_part", F.spark_partition_id().cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    placed = staged(placed, "chunks").join(start.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_start"), same)
    order = Window.partitionBy(*by, "_part").orderBy("ts_ms", "row_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    # a later row wins a tie, but of the last event the first
    now = placed.withColumn("_t", (F.col("ts_ms") - F.col("_start")) / 1000.0 * penalty).withColumn("_at", F.col("_part") * (1 << 32) + F.row_number().over(order))
    cell = lambda score, key, path: F.struct(score.alias("score"), key.alias("key"), path.alias("path"))
    worth, place = [], []
    for i in range(n):
        w = F.col(f"s{i}").cast("double")
        w = w + F.col("_t") if i == 0 and n > 1 else w
        worth.append(w - F.col("_t") if i == n - 1 and n > 1 else w)
        place.append(F.array(-F.col("_at") if i == n - 1 else F.col("_at")))
    for i in range(n):
        now = now.withColumn("_cur", F.when(worth[i].isNotNull(), cell(worth[i], place[i], F.array("row_id")))).withColumn(f"_m{i}_{i + 1}", F.col("_cur"))
        for j in range(i + 1, n):
            now = now.withColumn("_b", F.max("_cur").over(past))
            now = now.withColumn("_cur", F.when(F.col("_b").isNotNull() & worth[j].isNotNull(), cell(F.col("_b.score") + worth[j], F.concat(place[j], F.col("_b.key")), F.concat(F.col("_b.path"), F.array("row_id"))))).drop("_b")
            now = now.withColumn(f"_m{i}_{j + 1}", F.col("_cur"))
    cells_of = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
    chunks = now.groupBy(*by, "_part").agg(*[F.max(f"_m{i}_{j}").alias(f"m{i}_{j}") for i, j in cells_of])
    inner = dict(chunks.dtypes)["m0_1"]
    empty = F.struct(*[F.lit(None).cast(inner).alias(f"e{j}") for j in range(1, n + 1)])

    def folded(held: Column, chunk: Column) -> Column:
        """held: the best rows so far for the events 0 to j - 1, by j."""
        out = []
        for j in range(1, n + 1):
            ways = [held[f"e{j}"], chunk[f"m0_{j}"]]
            for i in range(1, j):
                one, two = held[f"e{i}"], chunk[f"m{i}_{j}"]
                ways.append(F.when(one.isNotNull() & two.isNotNull(), cell(one["score"] + two["score"], F.concat(two["key"], one["key"]), F.concat(one["path"], two["path"]))))
            out.append(F.greatest(*ways).alias(f"e{j}"))
        return F.struct(*out)

    listed = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", *[f"m{i}_{j}" for i, j in cells_of]))).alias("c"))
    done = listed.select(*by, F.aggregate("c", empty, folded)[f"e{n}"].alias("e")).where(F.col("e").isNotNull())
    return done.select(*by, "e.score", "e.path")


def ranked_paths(paths: DataFrame) -> DataFrame:
    """best_paths with their rank among the videos of a query; equal scores in order of video."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "video_id")
    return paths.withColumn("rank", F.row_number().over(order))


def k_best_by_joins(pool: DataFrame, n: int, k: int | None, min_gap: int = 1, pacing: float = 0.0, by: list[str] = _GROUP) -> DataFrame:
    """(by, score, f0 ... f{n-1}, rank): the k best increasing n-tuples of pool(by, frame_idx, s0 ...), gaps of min_gap or more.

    For pools of a bounded quota a video. Scores are net of `pacing` for each frame between ends;
    ties by the last frame, then the one before it, and so on."""
    if min_gap < 1 or pacing < 0 or k is not None and k < 1:
        raise ValueError("k and min_gap must be positive and pacing not negative")
    out = pool.select(*by, F.col("frame_idx").alias("f0"), F.col("s0").cast("double").alias("score"))
    for i in range(1, n):
        step = pool.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("frame_idx").alias(f"f{i}"), F.col(f"s{i}").alias("_s"))
        on = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col(f"f{i}") >= F.col(f"f{i - 1}") + min_gap]
        gap = F.col(f"f{i}") - F.col(f"f{i - 1}")
        out = out.join(step, on).withColumn("score", F.col("score") + F.col("_s") - pacing * gap).drop("_s", *[f"_{c}" for c in by])
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), *[F.col(f"f{i}") for i in range(n - 1, -1, -1)])
    out = out.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def best_tuples(pool: DataFrame, n: int, min_gap: int = 1, pacing: float = 0.0, by: list[str] = _GROUP) -> DataFrame:
    """The first row of k_best_by_joins in each group, as (by, score, f0 ...), by one sort and n - 1 running maxima.

    frame_idx must be distinct in a group. A row's best tuple that ends at event i joins its score to the best one of event
    i - 1 that ends min_gap or more before; ties by the lesser frame."""
    if min_gap < 1 or pacing < 0 or n < 1:
        raise ValueError("n and min_gap must be positive and pacing not negative")
    behind = Window.partitionBy(*by).orderBy("frame_idx").rangeBetween(Window.unboundedPreceding, -min_gap)
    f = F.col("frame_idx")
    now = pool.withColumn("_e", F.struct(F.col("s0").cast("double").alias("score"), F.array("frame_idx").alias("path")))
    for i in range(1, n):
        free = F.struct((F.col("_e.score") + pacing * f).alias("k"), (-f).alias("near"), F.col("_e.path").alias("path"))
        now = now.withColumn("_b", F.max(F.when(F.col("_e").isNotNull(), free)).over(behind))
        now = now.withColumn("_e", F.when(F.col("_b").isNotNull(), F.struct((F.col("_b.k") + F.col(f"s{i}") - pacing * f).alias("score"), F.concat("_b.path", F.array("frame_idx")).alias("path")))).drop("_b")
    end = F.max_by("_e", F.struct(F.col("_e.score"), -f))
    found = now.where(F.col("_e").isNotNull()).groupBy(*by).agg(end.alias("e"))
    return found.select(*by, "e.score", *[F.col("e.path")[i].alias(f"f{i}") for i in range(n)])


def k_best_tuples(frames: list[int], scores: list[list[float]], k: int, min_gap: int = 1, pacing: float = 0.0) -> list[tuple[float, tuple[int, ...]]]:
    """The k best increasing tuples over strictly increasing frames; scores[i][j] is event i at frame j.

    Best-first search from the last event back. reach[i][j] is the most that any tuple of events 0 to i earns that ends
    at frame j, so what a partial tuple can still become is known exactly, and complete tuples leave the queue in order:
    by score, then by the last frame, the one before it, and so on. Of the frames that may come
    before, the k most promising are enough."""
    f, s = np.asarray(frames, np.int64), np.asarray(scores, np.float64).reshape(len(scores), len(frames))
    if (np.diff(f) <= 0).any():
        raise ValueError("frames must increase strictly")
    ends = np.searchsorted(f, f - min_gap, "right")  # how many frames may stand before each
    reach = [s[0]]
    for row in s[1:]:
        most = np.concatenate([[-np.inf], np.maximum.accumulate(reach[-1] + pacing * f)]) if len(f) else np.zeros(1)
        reach.append(row + most[ends] - pacing * f)

    def promising(i: int, upto: int) -> list[int]:
        worth = reach[i][:upto] + pacing * f[:upto]
        order = np.lexsort((f[:upto], -worth))[:k]
        return order[np.isfinite(worth[order])].tolist()

    last = len(s) - 1
    queue = [(-float(reach[last][j]), (int(f[j]),), last, j, 0.0) for j in np.lexsort((f, -reach[last]))[:k].tolist() if np.isfinite(reach[last][j])]
    heapq.heapify(queue)
    found: list[tuple[float, tuple[int, ...]]] = []
    while queue and len(found) < k:
        total, path, i, j, earned = heapq.heappop(queue)
        if i == 0:
            found.append((-total, path[::-1]))
            continue
        earned += float(s[i][j])
        for p in promising(i - 1, int(ends[j])):
            step = earned - pacing * float(f[j] - f[p])
            heapq.heappush(queue, (-(float(reach[i - 1][p]) + step), (*path, int(f[p])), i - 1, p, step))
    return found


def k_best_by_groups(pool: DataFrame, n: int, k: int, min_gap: int = 1, pacing: float = 0.0, by: list[str] = _GROUP) -> DataFrame:
    """As k_best_by_joins, by a best-first search in each group: work in proportion to frames and k, not to tuples.

    A group meets in one task whole: it is for pools, whose quota bounds a video's rows."""
    names = [f"f{i}" for i in range(n)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx").drop_duplicates("frame_idx")
        found = k_best_tuples(rows["frame_idx"].tolist(), [rows[f"s{i}"].tolist() for i in range(n)], k, min_gap, pacing)
        own = {c: rows[c].iloc[0] for c in by}
        return pd.DataFrame([own | {"score": s, "rank": r, **dict(zip(names, p, strict=True))} for r, (s, p) in enumerate(found, 1)], columns=[*by, "score", *names, "rank"])

    kinds = dict(pool.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "score double", *(f"{c} {kinds['frame_idx']}" for c in names), "rank int"])
    return pool.select(*by, "frame_idx", *[F.col(f"s{i}").cast("double").alias(f"s{i}") for i in range(n)]).groupBy(*by).applyInPandas(run, schema)


def paced(tuples: DataFrame, n: int, decay: float, by: list[str] = _GROUP) -> DataFrame:
    """Tuples rescored after the fact by `decay` for each frame between their ends, and ranked anew; ties keep their order."""
    if decay < 0:
        raise ValueError("decay must not be negative")
    out = tuples.withColumn("score", F.col("score") - decay * (F.col(f"f{n - 1}") - F.col("f0")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "rank")))


def emit(pool: DataFrame, n: int, limit: int = 100, min_gap: int = 1, pacing: float = 0.0) -> DataFrame:
    """Answers (query_id, answer_rank, video_id, score, f0 ...): every frame if n is 1, else the best tuple of
    each video; distinct frames first, then a global order by score, video and frames."""
    once = Window.partitionBy("query_id", "video_id", "frame_idx").orderBy(F.col("s0").desc(), "row_id")
    distinct = pool.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    found = distinct.select(*_GROUP, F.col("s0").cast("double").alias("score"), F.col("frame_idx").alias("f0")) if n == 1 else best_tuples(distinct, n, min_gap, pacing)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "video_id", *[f"f{i}" for i in range(n)])
    return found.withColumn("answer_rank", F.row_number().over(order)).where(F.col("answer_rank") <= limit)
