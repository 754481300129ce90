"""Grading answers: hits, recall at ranks, final score, shots, resampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import BUDGET, CUTS
from ..functions.text import answer_matches, shot_parts


def r_score(kind: Column, video: Column, frames: Column, answer: Column, gt_video: Column, windows: Column, accepted: Column, matches: Callable[[Column, Column], Column] = answer_matches) -> Column:
    """1 or 0 for one frame (and a matching answer, if one is asked for); hits over windows for sequences.

    Windows count whether or not a frame was given for them; extra frames do not count."""
    hit = F.coalesce(frames[0].between(windows[0]["s"], windows[0]["e"]), F.lit(False))
    hits = F.size(F.filter(F.arrays_zip(windows.alias("w"), F.slice(frames, 1, F.size(windows)).alias("f")), lambda x: x["f"].between(x["w"]["s"], x["w"]["e"])))
    return (
        F.when(~kind.isin("kis", "qa", "trake"), F.raise_error(F.concat(F.lit("unknown kind "), kind)).cast("double")).when(video != gt_video, 0.0).when(kind == "kis", hit.cast("double"))
        .when(kind == "qa", (hit & matches(answer, accepted)).cast("double")).otherwise(hits / F.size(windows))
    )


def graded(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank, r) of a submission's answers(query_id, rank, video_id, frames, answer), against truth(query_id, kind, video_id, windows, accepted).

    Answers to questions that nobody asked do not count; recall_table gives zeros to queries of the truth that have none."""
    known = truth.select("query_id", "kind", F.col("video_id").alias("gt"), "windows", "accepted")
    r = r_score(F.col("kind"), F.col("video_id"), F.col("frames"), F.col("answer"), F.col("gt"), F.col("windows"), F.col("accepted"))
    return answers.join(known, "query_id").select("query_id", "rank", r.alias("r"))


def recall_table(graded: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Per query of queries(query_id): r_{k} for each cut, final, best, best_rank, ranking_loss, from graded(query_id, rank, r).

    Answers beyond the budget do not count; a query without answers has zeros."""
    within = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0.0)).alias(f"r_{k}") for k in cuts]
    per = queries.select("query_id").join(graded.where(F.col("rank") <= BUDGET), "query_id", "left").groupBy("query_id")
    out = per.agg(*within, F.coalesce(F.max("r"), F.lit(0.0)).alias("best"), F.min_by("rank", F.struct(-F.col("r"), F.col("rank"))).alias("best_rank"))
    final = sum((F.col(f"r_{k}") for k in cuts), F.lit(0.0)) / float(len(cuts))
    return out.withColumn("final", final).withColumn("ranking_loss", F.col("best") - F.col("final"))


def by_type(table: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Means by query type; type `all` is of all queries."""
    name = F.when(F.grouping("query_type") == 1, "all").otherwise(F.col("query_type"))
    means = [F.avg(f"r_{k}").alias(f"r_{k}") for k in cuts]
    return table.cube("query_type").agg(name.alias("kind"), F.count("*").alias("n"), *means, F.avg("final").alias("final")).drop("query_type").withColumnRenamed("kind", "query_type")


def shot_grade(relevance: Column, strict: bool) -> Column:
    """Relevance 2 is a full hit; 1 is half of one, unless strict."""
    return (relevance >= 2).cast("double") if strict else F.when(relevance >= 2, 1.0).when(relevance == 1, 0.5).otherwise(0.0)


def jitter_expectation(answers: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """Exact mean of the final score over a truth spread evenly over [lo, hi]: no random draws.

    answers(query_id, rank, video_id, frame_idx); windows(query_id, video_id, lo, hi). The truth's
    window is `length` frames around each place in turn."""
    half = (length - 1) // 2
    places = windows.select("query_id", F.col("video_id").alias("gt"), F.explode(F.sequence("lo", "hi")).alias("c"))
    met = places.join(answers.where(F.col("rank") <= BUDGET), "query_id", "left")
    hit = (F.col("video_id") == F.col("gt")) & F.col("frame_idx").between(F.col("c") - half, F.col("c") + half)
    rank = met.groupBy("query_id", "c").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))
    final = sum((F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)) for k in CUTS), F.lit(0.0)) / float(len(CUTS))
    return rank.groupBy("query_id").agg(F.avg(final).alias("final"))


#: A draw of 16 bits stands for as many copies of a query as it passes of these: the distribution of Poisson(1) (fixed values).
COPIES = (24109, 48219, 60273, 64291, 65296, 65497, 65531)


def copies(seed: int, query_id, rounds: int) -> np.ndarray:
    """How often a query comes in each round. A digest of seed, query and number tells eight rounds, so any engine draws alike."""
    digests = b"".join(md5(f"{seed}:{query_id}:{k}".encode()).digest() for k in range(-(-rounds // 8)))
    return np.searchsorted(COPIES, np.frombuffer(digests, ">u2")[:rounds], "right")


def bootstrap_difference(pairs: DataFrame, rounds: int = 4000, seed: int = 0) -> DataFrame:
    """mean, 2.5 and 97.5 percentiles of the mean, wins and losses of pairs(query_id, delta), by `arm`.

    Each query comes in each round a number of times of its own (the Poisson bootstrap), so nobody has to know the others: a task adds the weights of
    its queries up as arrays, a place for each round, and sends one row an arm. A round without any query has no mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for arm, query, delta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = copies(seed, query, rounds)
                sums.setdefault(arm, np.zeros((2, rounds)))
                sums[arm] += w, w * delta
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([x[i].tolist() for x in sums.values()], pa.list_(pa.float64())) for i in (0, 1))], ["arm", "weights", "totals"])

    sizes = pairs.groupBy("arm").agg(F.avg("delta").alias("mean"), F.sum((F.col("delta") > 0).cast("long")).alias("wins"), F.sum((F.col("delta") < 0).cast("long")).alias("losses"))
    parts = pairs.where("delta is not null").select(F.col("arm").cast("string").alias("arm"), F.col("query_id").cast("string").alias("query_id"), F.col("delta").cast("double").alias("delta")).mapInArrow(run, "arm string, weights array<double>, totals array<double>")
    means = parts.select("arm", F.posexplode(F.arrays_zip("weights", "totals")).alias("r", "x")).groupBy("arm", "r").agg((F.sum("x.totals") / F.nullif(F.sum("x.weights"), F.lit(0.0))).alias("m"))
    ends = means.groupBy("arm").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return sizes.join(ends, "arm").select("arm", "mean", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"), "wins", "losses")


def label_precision(ranked: DataFrame, prevalence: DataFrame, k: int) -> DataFrame:
    """p_at_1, p_at_k and lift over prevalence(class, prevalence), from ranked(class, rank, hit)."""
    per = ranked.where(F.col("rank") <= k).groupBy("class").agg(F.max(F.when(F.col("rank") == 1, F.col("hit").cast("double"))).alias("p_at_1"), (F.sum(F.col("hit").cast("double")) / F.count("*")).alias("p_at_k"))
    return per.join(prevalence, "class").withColumn("lift", F.col("p_at_k") / F.greatest("prevalence", F.lit(1e-9)))


def resolved_shots(truth: DataFrame, shots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, video_id, shot_id, relevance) of truth(query_id, shot_id, relevance) whose names are shots(video_id, shot_id), the
    greatest relevance of a shot; and (query_id, unresolved): how many of a query's rows name no shot there is."""
    video, number = shot_parts(F.col("shot_id"))
    named = truth.select("query_id", video.alias("video_id"), number.alias("number"), "relevance")
    met = named.join(shots.select("video_id", F.col("shot_id").alias("number"), F.lit(True).alias("known")).distinct(), ["video_id", "number"], "left")
    found = met.where("known").groupBy("query_id", "video_id", F.col("number").alias("shot_id")).agg(F.max("relevance").alias("relevance"))
    return found, met.groupBy("query_id").agg(F.sum(F.col("known").isNull().cast("long")).alias("unresolved"))


def sweep(parts: DataFrame, grid: list[dict[str, float]], grade: Callable[[DataFrame], DataFrame], by: list[str], limit: int = BUDGET) -> DataFrame:
    """Mean final score of each setting of weights: all in one job, with the setting as a column.

    parts(*by, row_id, source, z): normalised scores of the rows of each query's pool. grade takes ranked(setting, *by, row_id, rank)
    and gives graded(setting, *by, rank, r)."""
    weight = F.array(*[F.create_map(*[F.lit(x) for pair in sorted(w.items()) for x in pair]) for w in grid])
    each = parts.select(*by, "row_id", "source", "z", F.posexplode(weight).alias("setting", "w"))
    total = each.groupBy("setting", *by, "row_id").agg(F.sum(F.coalesce(F.col("w")[F.col("source")], F.lit(0.0)) * F.col("z")).alias("s"))
    order = Window.partitionBy("setting", *by).orderBy(F.round("s", 9).desc(), "row_id")
    ranked = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    hits = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0.0)) for k in CUTS]
    per = grade(ranked).groupBy("setting", *by).agg((sum(hits, F.lit(0.0)) / float(len(CUTS))).alias("final"))
    return per.groupBy("setting").agg(F.avg("final").alias("final"))


def funnel(nominated: DataFrame, pool: DataFrame, truth: DataFrame, budgets: tuple[int, ...] = (10, 50, 200)) -> DataFrame:
    """A row for each query of truth(query_id, row_id): hit_{b}, whether the first b rows of pool(query_id, row_id, pool_rank) hold a true
    one (with a perfect second stage its final score); best_rank of a true row; sources, how many nominated one; and only, the one source without
    which none would be nominated, if there is such a source."""
    found = pool.join(truth.select("query_id", "row_id"), ["query_id", "row_id"], "left_semi").groupBy("query_id").agg(F.min("pool_rank").alias("best_rank"))
    by_source = nominated.join(truth.select("query_id", "row_id"), ["query_id", "row_id"], "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("s"))
    out = truth.select("query_id").distinct().join(found, "query_id", "left").join(by_source, "query_id", "left")
    hits = [F.coalesce(F.col("best_rank") <= b, F.lit(False)).cast("double").alias(f"hit_{b}") for b in budgets]
    return out.select("query_id", *hits, "best_rank", F.coalesce(F.size("s"), F.lit(0)).alias("sources"), F.when(F.size("s") == 1, F.col("s")[0]).alias("only"))


def source_overlap(nominated: DataFrame) -> DataFrame:
    """(one, other, jaccard) of the rows that two sources nominate for the same queries."""
    rows = nominated.select("query_id", "row_id", "source").distinct()
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    sets = rows.groupBy("query_id", "row_id").agg(F.array_sort(F.collect_set("source")).alias("s"))
    pairs = sets.select(F.explode("s").alias("one"), "s").select("one", F.explode("s").alias("other")).where("one < other").groupBy("one", "other").agg(F.count("*").alias("both"))
    out = pairs.join(sizes.select(F.col("source").alias("one"), F.col("n").alias("a")), "one").join(sizes.select(F.col("source").alias("other"), F.col("n").alias("b")), "other")
    return out.select("one", "other", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("jaccard"))
