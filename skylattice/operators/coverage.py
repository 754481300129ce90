"""Placing answers in time: hit probability of a set of frames, and the best set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_widths


def hit_probability(placed: DataFrame, posterior: DataFrame, length: int, by: str = "case_id") -> DataFrame:
    """(by, p): the share of posterior(by, frame, weight) under the windows around placed(by, frame)."""
    before, after = half_widths(length)
    under = placed.select(by, F.explode(F.sequence(F.col("frame") - before, F.col("frame") + after)).alias("frame")).distinct().withColumn("hit", F.lit(True))
    met = posterior.join(under, [by, "frame"], "left").groupBy(by).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)).alias("got"))
    return met.select(by, F.when(F.col("total") > 0, F.col("got") / F.col("total")).otherwise(0.0).alias("p"))


def best_windows(posterior: DataFrame, m: int, length: int, by: str = "case_id") -> DataFrame:
    """(by, covered, starts): at most m windows of `length` frames that cover the greatest weight, and where they start.

    posterior(by, frame, weight) needs rows for frames with weight alone. A window that starts at a frame without weight can move
    on to the next one that it covers, and one that meets the window before it to the first one beyond, and neither
    loses anything: so windows start at rows, `length` or more apart. A row's best with j windows is its own
    window's weight and the best with j - 1 among the rows far enough before it: m windows over one sort of each case.
    Of equal sums the starts that are greater in order win."""
    if m < 1:
        raise ValueError(f"m must be positive: {m}")
    half_widths(length)
    weight = F.when(F.col("weight") < 0, F.raise_error("weights must not be negative").cast("double")).otherwise(F.col("weight"))
    rows = posterior.select(by, "frame", weight.alias("weight")).where("weight > 0")
    ahead = Window.partitionBy(by).orderBy("frame").rangeBetween(0, length - 1)
    behind = Window.partitionBy(by).orderBy("frame").rangeBetween(Window.unboundedPreceding, -length)
    now = rows.withColumn("own", F.sum("weight").over(ahead)).withColumn("e1", F.struct(F.col("own").alias("covered"), F.array("frame").alias("starts")))
    for j in range(2, m + 1):
        best = F.max(f"e{j - 1}").over(behind)
        now = now.withColumn("b", best).withColumn(f"e{j}", F.when(F.col("b").isNotNull(), F.struct((F.col("own") + F.col("b.covered")).alias("covered"), F.concat("b.starts", F.array("frame")).alias("starts"))).otherwise(F.col("e1"))).drop("b")
    top = F.max(F.array_max(F.array(*[f"e{j}" for j in range(1, m + 1)])))
    return now.groupBy(by).agg(top.alias("e")).select(by, "e.covered", "e.starts")


def optimal_placement(posterior: DataFrame, m: int, length: int, by: str = "case_id") -> DataFrame:
    """(by, frame): at most m frames whose windows cover the greatest weight of posterior(by, frame, weight); a case without weight has none."""
    before, _ = half_widths(length)
    return best_windows(posterior, m, length, by).select(by, F.explode(F.transform("starts", lambda f: (f + before).cast("long"))).alias("frame"))
